"""Table statistics: records, blocks, and distinct values per column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.catalog import Layout

#: Relative error of the sketch-based distinct counts.
RSD = 0.008


@dataclass(frozen=True)
class Statistics:
    records: int
    blocks: int
    distinct: dict[str, int] = field(hash=False)


def block_count(records: int, layout: Layout, block_size: int) -> int:
    """Blocks that the records fill when none was deleted."""
    per_block = layout.slots_per_block(block_size)
    if per_block < 1:
        raise ValueError(f"a slot of {layout.slot_size} bytes does not fit a block of {block_size}")
    return -(-records // per_block)


def distinct_counts(df: DataFrame, exact: bool = False, rsd: float = RSD) -> DataFrame:
    """One row with the number of distinct values of every column."""
    return df.agg(*_counts(df, exact, rsd))


def _counts(df: DataFrame, exact: bool, rsd: float = RSD) -> list:
    count = F.count_distinct if exact else lambda c: F.approx_count_distinct(c, rsd)
    return [count(F.col(f"`{c}`")).alias(c) for c in df.columns]


def statistics(df: DataFrame, layout: Layout, block_size: int, exact: bool = False) -> Statistics:
    """One aggregate over the table; the result is one row."""
    names = [f"v{i}" for i in range(len(df.columns))]
    row = df.toDF(*names).agg(F.count(F.lit(1)).alias("records"), *_counts(df.toDF(*names), exact)).first()
    return Statistics(row["records"], block_count(row["records"], layout, block_size), {c: row[n] for c, n in zip(df.columns, names, strict=True)})
