"""Contiguous byte-balanced sharding by global prefix sums.

Documents are range-partitioned by id, each partition sums its own sizes, the
partition totals (one row per partition) are prefix-summed, and the byte line so
obtained is cut at equal targets.  A document belongs to the shard that holds the
middle of its bytes, so every cut is off by at most half a document.

Only id, size and checksum travel; texts are never shuffled.  Ties in the id are
ordered by checksum, size and input position, so repeated rows spread over
partitions and every row keeps its own slot.  Null texts have size 8 (no bytes) and
checksum 0; null ids sort first.  An empty table gives an empty result.  A document
larger than a shard's target may leave a neighbouring shard empty.

Under the law `bytes` only the sizes decide: equal texts are a group with one checksum, and a
group lies wherever its rows fall on the byte line, since a group of a third of all bytes kept
together could not fit shards of near equal size.  Only id and text are read, so the names of
other columns cannot clash; ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import documents, materialise, partitions

ROW_OVERHEAD = 8


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, size_before, rows_before = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        size = b.column("size").to_numpy()
        upto = np.cumsum(size, dtype=np.int64)
        n = len(size)
        yield pa.RecordBatch.from_arrays(
            [b.column("id"), b.column("size"), b.column("crc"), pa.array(np.full(n, part, np.int32)), pa.array(size_before + upto - size), pa.array(rows_before + np.arange(n, dtype=np.int64))],
            names=["id", "size", "crc", "part", "start", "idx"],
        )
        if n:
            size_before, rows_before = size_before + int(upto[-1]), rows_before + n


def byte_shards(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, size, crc, shard, slot and the global byte start."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        F.coalesce(F.crc32(text_col), F.lit(0)).cast("long").alias("crc"),
        F.monotonically_increasing_id().alias("tie"),
    )
    keys = ["id", "crc", "size", "tie"]
    local = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys).drop("tie")
    # The range bounds come from a sample, so the dealt rows are written once and both
    # later passes read the same partitions.
    local = materialise(local.mapInArrow(_running, "id long, size long, crc long, part int, start long, idx long"), "shards")
    totals = local.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # One row per partition: its size is the partition count, never the row count.
    totals = totals.select("part", (F.sum("bytes").over(upto) - F.col("bytes")).alias("bytes_before"), (F.sum("n").over(upto) - F.col("n")).alias("rows_before"), F.sum("bytes").over(Window.partitionBy(F.lit(0))).alias("total"))
    placed = local.join(F.broadcast(totals), "part").select(
        "id", "size", "crc", (F.col("start") + F.col("bytes_before")).alias("start"), (F.col("idx") + F.col("rows_before")).alias("idx"),
        F.expr(f"cast(((2 * (start + bytes_before) + size) * {int(shards)}) div (2 * total) as int)").alias("shard"),
    )
    firsts = placed.groupBy("shard").agg(F.min("idx").alias("first"))  # one row per shard
    return placed.join(F.broadcast(firsts), "shard").select("id", "size", "crc", "shard", (F.col("idx") - F.col("first")).alias("slot"), "start")


def op9_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 23 of documents under the law `bytes`."""
    return byte_shards(documents(spark, sf_dir), 24).select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("start").alias("byte_start")
    )


#: DuckDB has no CRC-32: the table is built by its rule (reflected polynomial 0xEDB88320) and each text's bytes are folded over it.
_SQL = """
WITH bits AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS crc_of),
docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
crcs AS (SELECT doc_id, CAST(length(h) // 2 + 8 AS BIGINT) AS size,
  CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(h, '..'), lambda b: CAST('0x' || b AS BIGINT))), lambda c, b: xor(c >> 8, crc_of[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM docs, bits),
line AS (SELECT *, sum(size) OVER w - size AS byte_start, row_number() OVER w AS idx, sum(size) OVER () AS total FROM crcs
  WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cut AS (SELECT *, CAST((2 * byte_start + size) * 24 // (2 * total) AS INTEGER) AS shard FROM line)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(idx - min(idx) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard, CAST(byte_start AS BIGINT) AS byte_start FROM cut
"""


QUERIES = {"op9_byte_shards": op9_byte_shards}
ORACLES = {"op9_byte_shards": _SQL}
