"""The keyed join of two (key, data) inputs, and the key partitioning it is named after."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def partition(df: DataFrame, n: int, key: str = "key") -> DataFrame:
    """df dealt into n partitions by key modulo n; `part` tells which.  Negative keys count from 0 too."""
    return df.withColumn("part", F.pmod(F.col(key), F.lit(n)).cast("int")).repartition(n, "part")


def hash_join(build: DataFrame, probe: DataFrame, build_key: str = "key", build_data: str = "data", probe_key: str = "key", probe_data: str = "data", build_last_wins: bool = False, order: str | None = None, sort: bool = True) -> DataFrame:
    """key and data = build data followed by probe data, ascending by key.

    A standard inner join: equal build keys all match.  With build_last_wins only the
    build row that is last by the column `order` counts for each key.  Which side is
    hashed or broadcast is left to the optimizer, which knows the sizes.
    """
    b = build.select(F.col(build_key).alias("key"), F.col(build_data).alias("b"), *([F.col(order).alias("_order")] if build_last_wins else []))
    if build_last_wins:
        if order is None:
            raise ValueError("build_last_wins needs the column that orders the build rows")
        b = b.groupBy("key").agg(F.max_by("b", "_order").alias("b"))
    p = probe.select(F.col(probe_key).alias("key"), F.col(probe_data).alias("p"))
    joined = b.join(p, "key").select("key", F.concat("b", "p").alias("data"))
    return joined.orderBy("key") if sort else joined


