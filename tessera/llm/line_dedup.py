"""Line deduplication by probing sharded minimal perfect hashes.

1. Every document emits the 128-bit hashes of its distinct long lines; they are combined
   to one row per chunk of documents and line, so a line that a third of all documents
   hold is one row per chunk, not per document.
2. The rows are dealt by shard of the hash.  Each shard sums them and builds a minimal
   perfect hash over its distinct line hashes: levels of bit arrays in which a key's
   first collision-free position gives, by rank, its slot in three arrays (fingerprint,
   document count, largest document id).  The index is one row per shard.
3. Each chunk's line hashes probe the arrays of their shard; the lines to drop go back
   as one blob per shard and chunk, and every chunk's documents are cut with the blobs of
   their own chunk.  Lines are never joined with lines.

A line's key is the line without white space at both ends and with A-Z lower-cased.  Keys
of at least `least_chars` code points in at least `least_docs` documents stay only in the
document of the largest id.  Rows of one id are one document: they count once, and all rows
of the largest id keep the line.  Rows without an id count for nothing and keep all lines.
Null and empty texts are one empty line and stay as they are.  Ids must be integers.  Very
long texts are one slice each, at about 20 times their size of memory.  The other columns of
docs travel as one struct, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import chunk_count, delete_path, documents, materialise, packed, partitions, read_table, unpacked, write_table
from ._text import LOWER, SPACE, hash_spans, mix, slices, utf8

LEAST_CHARS, LEAST_DOCS = 40, 5
NO_ID = -(2**63)
#: Chunk of counts that belong to no chunk of documents.
OUTSIDE = -1
GAMMA, LEVELS = 2.0, 24


def line_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every line, in order; a text has one line more than it has newlines."""
    breaks = np.flatnonzero(buf == 10)
    n = len(offsets) - 1
    doc = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(doc[1:] != doc[:-1], True)
    end[last] = offsets[doc[last] + 1]
    return start, end, doc


def line_keys(buf: np.ndarray, start: np.ndarray, end: np.ndarray, least_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the lines with a long enough key, and the two hashes of their keys."""
    solid = np.flatnonzero(~SPACE[buf])
    points = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    full = np.flatnonzero(a <= b)
    s, e = solid[a[full]], solid[b[full]] + 1
    long = points[e] - points[s] >= least_chars
    full, s, e = full[long], s[long], e[long]
    low = LOWER[buf]
    return full, hash_spans(low, s, e - s), hash_spans(low, s, e - s, 1)


def _emit(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                buf, offsets = utf8(b.column(2))
                start, end, doc = line_spans(buf, offsets)
                which, h1, h2 = line_keys(buf, start, end, least_chars)
                rows = np.empty(len(which), dtype=[("d", "i8"), ("a", "u8"), ("b", "u8")])
                rows["d"], rows["a"], rows["b"] = doc[which], h1, h2
                rows = np.unique(rows)
                d = pa.array(rows["d"])
                yield pa.RecordBatch.from_arrays([b.column(0).take(d), b.column(1).take(d), pa.array(rows["a"].view(np.int64)), pa.array(rows["b"].view(np.int64))], names=["chunk", "id", "h1", "h2"])

    return run


class PerfectHash:
    """Minimal perfect hash over distinct 128-bit keys."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest  # rest: keys that no level could place, sorted
        self.rank, done = [], 0
        for level in bits:
            upto = np.cumsum(level, dtype=np.int64) + done
            self.rank.append(upto)
            done = int(upto[-1]) if len(upto) else done
        self.placed = done

    @staticmethod
    def _at(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(h1 ^ mix(h2 + np.uint64(level * 0x9E3779B9 + 7))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        bits = []
        while len(h1) and len(bits) < LEVELS:
            size = max(8, math.ceil(GAMMA * len(h1)))
            at = cls._at(h1, h2, len(bits), size)
            level = np.bincount(at, minlength=size) == 1
            bits.append(level)
            h1, h2 = h1[~level[at]], h2[~level[at]]
        rest = np.empty(len(h1), dtype=[("a", "u8"), ("b", "u8")])
        rest["a"], rest["b"] = h1, h2
        return cls(bits, np.sort(rest))

    def slots(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The slot of every key; keys outside the set get any slot, or -1."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for k, level in enumerate(self.bits):
            at = self._at(h1[left], h2[left], k, len(level))
            hit = level[at]
            out[left[hit]] = self.rank[k][at[hit]] - 1
            left = left[~hit]
        if len(self.rest) and len(left):
            keys = np.empty(len(left), dtype=self.rest.dtype)
            keys["a"], keys["b"] = h1[left], h2[left]
            at = np.minimum(np.searchsorted(self.rest, keys), len(self.rest) - 1)
            ok = self.rest[at] == keys
            out[left[ok]] = self.placed + at[ok]
        return out

    def dump(self) -> tuple[list[int], list[bytes], bytes]:
        return [len(x) for x in self.bits], [np.packbits(x).tobytes() for x in self.bits], self.rest.tobytes()

    @classmethod
    def load(cls, sizes: list[int], packed_bits: list[bytes], rest: bytes) -> PerfectHash:
        bits = [np.unpackbits(np.frombuffer(x, np.uint8), count=n).astype(bool) for n, x in zip(sizes, packed_bits, strict=True)]
        return cls(bits, np.frombuffer(rest, dtype=[("a", "u8"), ("b", "u8")]))


INDEX = "shard int, sizes array<int>, bits array<binary>, rest binary, fingerprints binary, counts binary, lasts binary"


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _build_shard(t: pa.Table) -> pa.Table:
    rows = np.empty(t.num_rows, dtype=[("a", "u8"), ("b", "u8")])
    rows["a"], rows["b"] = _column(t, "h1").view(np.uint64), _column(t, "h2").view(np.uint64)
    keys, inverse = np.unique(rows, return_inverse=True)
    counts = np.bincount(inverse, weights=_column(t, "n"), minlength=len(keys)).astype(np.int64)
    lasts = np.full(len(keys), NO_ID)
    np.maximum.at(lasts, inverse, _column(t, "last"))
    h1, h2 = keys["a"].copy(), keys["b"].copy()
    mph = PerfectHash.build(h1, h2)
    slot = mph.slots(h1, h2)
    out = [np.empty(len(keys), d) for d in (np.uint32, np.int64, np.int64)]
    for array, values in zip(out, ((h2 >> np.uint64(32)).astype(np.uint32), counts, lasts), strict=True):
        array[slot] = values
    sizes, bits, rest = mph.dump()
    values = [[int(t.column("shard")[0].as_py())], [sizes], [bits], [rest], *[[x.tobytes()] for x in out]]
    types = [pa.int32(), pa.list_(pa.int32()), pa.list_(pa.binary()), *[pa.binary()] * 4]
    names = ["shard", "sizes", "bits", "rest", "fingerprints", "counts", "lasts"]
    return pa.table([pa.array(v, k) for v, k in zip(values, types, strict=True)], names=names)


def build_index(lines: DataFrame) -> DataFrame:
    """One row per shard from rows (shard, h1, h2, n, last)."""
    return lines.groupBy("shard").applyInArrow(_build_shard, INDEX)


def lookup(index: pa.Table, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document count and largest id of every key, 0 and NO_ID for keys that the shard lacks."""
    row = index.slice(0, 1).to_pylist()[0]
    mph = PerfectHash.load(row["sizes"], row["bits"], row["rest"])
    fingerprints, counts, lasts = np.frombuffer(row["fingerprints"], np.uint32), np.frombuffer(row["counts"], np.int64), np.frombuffer(row["lasts"], np.int64)
    slot = mph.slots(h1, h2)
    known = slot >= 0
    known[known] = fingerprints[slot[known]] == (h2[known] >> np.uint64(32)).astype(np.uint32)
    n, last = np.zeros(len(h1), np.int64), np.full(len(h1), NO_ID)
    n[known], last[known] = counts[slot[known]], lasts[slot[known]]
    return n, last


def _probe_shard(least_docs: int):
    def run(lines: pa.Table, index: pa.Table) -> pa.Table:
        chunk, h1, h2 = _column(lines, "chunk"), _column(lines, "h1").view(np.uint64), _column(lines, "h2").view(np.uint64)
        hits = np.zeros(0, np.int64)
        if lines.num_rows and index.num_rows:
            n, last = lookup(index, h1, h2)
            hits = np.flatnonzero(n >= least_docs)
        hits = hits[np.argsort(chunk[hits], kind="stable")]
        parts = np.split(hits, np.flatnonzero(np.diff(chunk[hits])) + 1) if len(hits) else []
        blob = lambda x: pa.array([x[p].tobytes() for p in parts], pa.binary())
        return pa.table([pa.array([int(chunk[p[0]]) for p in parts], pa.int32()), blob(h1), blob(h2), blob(last if parts else h1)], names=["chunk", "h1", "h2", "last"])

    return run


def _cut(least_chars: int, out_types: list[tuple[str, pa.DataType]]):
    def run(docs: pa.Table, drops: pa.Table) -> pa.Table:
        keys = np.empty(sum(len(x.as_py()) // 8 for x in drops.column("h1")), dtype=[("a", "u8"), ("b", "u8")])
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in drops.column(name)), kind)
        keys["a"], keys["b"], last = join("h1", np.uint64), join("h2", np.uint64), join("last", np.int64)
        order = np.argsort(keys)
        keys, last = keys[order], last[order]
        made: list[pa.RecordBatch] = []
        for batch in docs.combine_chunks().to_batches():
            for b in slices(batch, "text"):
                column = b.column(b.schema.get_field_index("text"))
                named = b.column(b.schema.get_field_index("id")).is_valid().to_numpy(zero_copy_only=False)
                ids = b.column(b.schema.get_field_index("id")).fill_null(NO_ID).to_numpy()
                buf, offsets = utf8(column)
                start, end, doc = line_spans(buf, offsets)
                gone = np.zeros(len(start), dtype=bool)
                if len(keys):
                    which, h1, h2 = line_keys(buf, start, end, least_chars)
                    probe = np.empty(len(which), dtype=keys.dtype)
                    probe["a"], probe["b"] = h1, h2
                    at = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
                    gone[which] = (keys[at] == probe) & (ids[doc[which]] != last[at]) & named[doc[which]]
                n = len(column)
                n_lines, n_gone = np.bincount(doc, minlength=n), np.bincount(doc[gone], minlength=n)
                texts, first = column.to_pylist(), np.cumsum(n_lines) - n_lines
                for d in np.flatnonzero(n_gone):
                    own = np.flatnonzero(~gone[first[d] : first[d] + n_lines[d]]) + first[d]
                    texts[d] = b"\n".join(buf[start[i] : end[i]].tobytes() for i in own).decode()
                made.append(pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), pa.array(texts, pa.string()), pa.array(n_lines.astype(np.int64)), pa.array(n_gone.astype(np.int64))], names=[x for x, _ in out_types]))
        schema = pa.schema([("row", docs.schema.field("row").type), *out_types[1:]])
        return pa.Table.from_batches([m.cast(schema) if m.schema != schema else m for m in made], schema)

    return run


def _documents_of(emitted: DataFrame, ids: DataFrame) -> DataFrame:
    """(chunk, h1, h2, n, last): by chunk and line the documents that hold it, and the largest id."""
    count = lambda df: df.groupBy("chunk", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    again = materialise(ids.groupBy("id").count().filter("count > 1").select("id"), "repeated-ids")
    if again.isEmpty():
        return count(emitted)
    # The rows of an id may lie in several chunks: there they only ask (n = 0), and count once outside of all.
    emitted = materialise(emitted, "line-rows")
    rows = emitted.join(again, "id", "left_semi")
    asked = rows.select("chunk", "h1", "h2").distinct().select("*", F.lit(0).cast("long").alias("n"), F.lit(NO_ID).alias("last"))
    once = count(rows.select(F.lit(OUTSIDE).alias("chunk"), "id", "h1", "h2").distinct())
    return count(emitted.join(again, "id", "left_anti")).unionByName(asked).unionByName(once)


def dedup_lines(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", shard_rows: int = 1 << 20) -> DataFrame:
    """row, text (kept lines), n_lines and n_dropped of every row of docs."""
    spark = docs.sparkSession
    chunks = chunk_count(docs, text_col)
    # By id and text, so that many rows of one id, or without one, do not meet in one chunk.
    chunk = F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(chunks)).cast("int").alias("chunk")
    named = docs.filter(F.col(id_col).isNotNull())
    emitted = named.select(chunk, F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_emit(least_chars), "chunk int, id long, h1 long, h2 long")
    written = write_table(_documents_of(emitted, named.select(F.col(id_col).cast("long").alias("id"))), "lines")
    lines = read_table(spark, written, "chunk int, h1 long, h2 long, n long, last long")
    shards = max(4 * partitions(spark), -(-lines.count() // shard_rows))
    lines = lines.withColumn("shard", F.pmod(F.col("h1"), F.lit(shards)).cast("int"))
    index_written = write_table(build_index(lines), "line-index")
    index = read_table(spark, index_written, INDEX)
    drops = lines.filter(F.col("chunk") != OUTSIDE).select("shard", "chunk", "h1", "h2").groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_probe_shard(least_docs), "chunk int, h1 binary, h2 binary, last binary")
    drops = materialise(drops, "line-drops")
    for path in (written, index_written):
        delete_path(spark, path)
    rows = packed(docs, text_col, chunk, F.col(id_col).cast("long").alias("id"))
    out = [("row", None), ("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())]
    return rows.groupBy("chunk").cogroup(drops.groupBy("chunk")).applyInArrow(_cut(least_chars, out), f"row {rows.schema['row'].dataType.simpleString()}, text string, n_lines long, n_dropped long")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, with the kept lines as text."""
    return unpacked(dedup_lines(docs), docs, "text")


def op8_line_mph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document after line deduplication."""
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_STRIPPED = r"regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')"
_ORACLE = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT doc_id, pos, line, translate({_STRIPPED}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= {LEAST_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST_DOCS}),
judged AS (SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUERIES = {"op8_line_mph": op8_line_mph}
ORACLES = {"op8_line_mph": _ORACLE}
