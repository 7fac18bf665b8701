"""Shared plumbing: the folder all executors see, written tables, chunk counts."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local master may fall
    back on a temporary folder; elsewhere an unset folder is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path.rstrip("/")


#: Shuffle files go when the statement that made them has ended.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Folders of the workspaces that are open, the innermost last.
_WORKSPACES: list[str] = []


def write_table(df: DataFrame, name: str, partition_by: str | None = None, kept: bool = False) -> str:
    """Write df to the shared folder; nothing reads its shuffles again, so they are freed at once.

    Within a workspace the table goes with it, unless it is to be kept.
    """
    conf = df.sparkSession.conf
    folder = _WORKSPACES[-1] if _WORKSPACES and not kept else f"{shared_dir(df.sparkSession)}/tessera"
    path, before = f"{folder}/{name}-{uuid.uuid4().hex}", conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        (df.write.partitionBy(partition_by) if partition_by else df.write).parquet(path)
    finally:
        conf.set(_FREE_SHUFFLES, before) if before is not None else conf.unset(_FREE_SHUFFLES)
    return path


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once as a table in the shared folder and read it back, which cuts
    the lineage: a lost executor costs a re-read, not a recomputation."""
    return read_table(df.sparkSession, write_table(df, name), df.schema)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete files of the shared folder that nothing needs any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@contextmanager
def workspace(spark: SparkSession):
    """What operators write within goes at the end; by then their result must have been written."""
    _WORKSPACES.append(f"{shared_dir(spark)}/tessera/work-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        delete_path(spark, _WORKSPACES.pop())


@contextmanager
def scratch(spark: SparkSession):
    """A materialise() whose tables are deleted at the end."""
    paths: list[str] = []

    def keep(df: DataFrame, name: str) -> DataFrame:
        paths.append(write_table(df, name))
        return read_table(spark, paths[-1], df.schema)

    try:
        yield keep
    finally:
        for path in paths:
            delete_path(spark, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(df: DataFrame, text_col: str, chunk_bytes: int = 16 << 20) -> int:
    """Chunks of at most about chunk_bytes of text, at least four per shuffle partition."""
    size = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(4 * partitions(df.sparkSession), -(-size // chunk_bytes))


def packed(docs: DataFrame, text_col: str, *more) -> DataFrame:
    """row (a struct of all other columns), text, and the given extra columns; no name of docs can clash with them."""
    rest = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("struct<none:int>")
    return docs.select(row.alias("row"), F.col(text_col).cast("string").alias("text"), *more)


def unpacked(df: DataFrame, docs: DataFrame, text_col: str, *more) -> DataFrame:
    """The columns of docs again, in their order, and the given extra ones."""
    return df.select(*[F.col("text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns], *more)
