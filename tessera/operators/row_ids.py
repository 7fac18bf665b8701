"""Row ids of tables in files: the file and the row's place in it, which the Parquet reader knows without a shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RID = "_rid"


def with_rids(df: DataFrame) -> DataFrame:
    """df, read from files and not yet joined or aggregated, with a column of (file, row)."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias(RID))


def at_rid(df: DataFrame, file: str, row: int) -> DataFrame:
    """The row of that id; only its file is read."""
    return df.filter((F.col("_metadata.file_path") == file) & (F.col("_metadata.row_index") == row))
