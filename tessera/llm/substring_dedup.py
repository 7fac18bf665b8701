"""Substring deduplication against a log-structured fingerprint index.

The documents come in batches of rising ids.  A batch's windows (runs of `width` words)
are hashed and dealt by bucket of the hash; in each bucket they are merge-joined with the
index, which is a few immutable runs of sorted fingerprints of all earlier batches, and
with each other.  A key that meets is verified by a second, independent 32-bit hash.  A
window met in an earlier batch, or in a smaller id of its own batch, is a repeat.  The
batch's own fingerprints become a new run; once there are more than `most_runs` runs, the
same pass writes one compacted run in their stead and the old ones are deleted.

A bucket has log2(buckets) + 64 bits of fingerprint, so with n windows about
n^2 / (buckets * 2^65) pairs are mistaken (under one in 10^9 windows at 30 GB).

Hot windows: a slice of a map task sends each of its windows once, with the smallest id
that holds it; the slice itself knows the others to be repeats.  A bucket therefore gets at
most one entry per window and slice, however many documents share it.  Fingerprints travel
as sorted deltas in byte planes.  Repeats go back as one blob per bucket and chunk of
documents, and every chunk's texts are cut with its own blobs.

An index can be saved and opened again, so that a later session goes on with the next batch.

Null and empty texts have no words.  Documents of fewer than `width` words keep all.  Rows
of one id are one document and never make each other repeats; they meet in one chunk.  Rows
without an id make nothing a repeat and keep all words.  Ids must be integers.  A very long
text takes about ten times its size of memory.  The other columns of docs travel as one
struct, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete_path, documents, packed, partitions, read_table, write_table
from ._text import hashed_words, mix, slices, utf8, windows

WIDTH, BATCHES, MOST_RUNS = 13, 4, 2
#: Stands for a missing id where texts are cut; no repeat carries it.
NO_ID = -(2**63)
BUCKET_BYTES = 16 << 20
#: Bytes of text fingerprinted at a time; the arrays take about 40 times as much memory.
SLICE = 3 << 20
#: Bytes of text cut at a time; smaller than SLICE, as a chunk's texts are held beside the arrays.
CUT = 1 << 20
_LOW = np.uint64(0xFFFFFFFF)


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, lowest first, without the planes above the largest value."""
    v = np.ascontiguousarray(values, dtype="<u8")
    planes = (int(v.max()).bit_length() + 7) // 8 if len(v) else 0
    return bytes([planes]) + v.view(np.uint8).reshape(-1, 8).T[:planes].tobytes()


def unpack(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    planes = blob[0]
    if planes:
        out[:, :planes] = np.frombuffer(blob, np.uint8, offset=1).reshape(planes, n).T
    return out.reshape(-1).view("<u8")


def spark_hash(ids: np.ndarray) -> np.ndarray:
    """What the SQL function hash() gives for a bigint: 32-bit Murmur 3 with seed 42."""
    with np.errstate(over="ignore"):
        h = np.full(len(ids), 42, dtype=np.uint32)
        rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
        for k in (ids.view(np.uint64) & _LOW, ids.view(np.uint64) >> np.uint64(32)):
            k = rot(k.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
            h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            h = (h ^ (h >> np.uint32(shift))) * np.uint32(factor)
        return (h ^ (h >> np.uint32(16))).view(np.int32)


def _marks(buf: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Of every window: first word, text number, bucket hash, token (32-bit key, 32-bit check); and the words."""
    starts, lens, doc, (h1, h2) = hashed_words(buf, offsets, seeds=(0, 1))
    first, w = windows(h1, doc, width)
    _, check = windows(h2, doc, width, 1)
    return first, doc[first] if len(first) else first, w >> np.uint64(32), (w << np.uint64(32)) | (check & _LOW), starts, lens, doc


def _replies(ids: np.ndarray, tokens: np.ndarray, chunks: int) -> list[tuple[int, bytes, bytes]]:
    """(chunk, ids, tokens) of the given repeats."""
    if not len(ids):
        return []
    chunk = spark_hash(ids).astype(np.int64) % chunks
    order = np.argsort(chunk, kind="stable")
    cuts = np.flatnonzero(np.diff(chunk[order])) + 1
    return [(int(chunk[p[0]]), ids[p].tobytes(), tokens[p].tobytes()) for p in np.split(order, cuts)]


ENTRY = "bucket int, n long, base long, keys binary, checks binary, ids binary"


def _emit(width: int, buckets: int):
    """For every slice and bucket the distinct windows and the smallest id of each.

    Rows with n = -1 hold what the slice itself knows to repeat: ids and tokens.
    """

    def entries(b: pa.RecordBatch) -> pa.RecordBatch | None:
        ids = b.column(0).to_numpy().astype(np.int64)
        doc, high, token = _marks(*utf8(b.column(1)), width)[1:4]
        if not len(token):
            return None
        own, bucket = ids[doc], (high % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((own, token, bucket))
        bucket, token, own = bucket[order], token[order], own[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (bucket[1:] != bucket[:-1])
        again = own != own[new][np.cumsum(new) - 1]
        out = []
        if again.any():
            out.append((int(spark_hash(ids[:1])[0]) % buckets, -1, 0, own[again].tobytes(), token[again].tobytes(), b""))
        bucket, token, own = bucket[new], token[new], own[new]
        base = int(own.min())
        for p in np.split(np.arange(len(own)), np.flatnonzero(np.diff(bucket)) + 1):
            keys = pack(np.diff(token[p] >> np.uint64(32), prepend=np.uint64(0)))
            out.append((int(bucket[p[0]]), len(p), base, keys, (token[p] & _LOW).astype("<u4").tobytes(), pack((own[p] - base).view(np.uint64))))
        types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=["bucket", "n", "base", "keys", "checks", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The arrays of a slice end with its call, before those of the next one are made.
        for batch in batches:
            yield from (e for e in map(entries, slices(batch, "text", SLICE)) if e is not None)

    return run


def _tokens(keys: bytes, checks: bytes, n: int) -> np.ndarray:
    """The sorted fingerprints of a run, or of an entry."""
    return (np.cumsum(unpack(keys, n), dtype=np.uint64) << np.uint64(32)) | np.frombuffer(checks, "<u4").astype(np.uint64)


def _rows(table: pa.Table) -> Iterator[dict]:
    """One row at a time, so that its blobs are not held beside what is made of them."""
    for batch in table.to_batches():
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


OUT = "kind int, place int, n long, first binary, second binary"


def _merge(chunks: int, compact: bool, keep: bool):
    """One bucket: merge-join the batch's entries with the runs; replies (kind 0) and, to keep, the new run (kind 1)."""

    def run(entries: pa.Table, runs: pa.Table) -> pa.Table:
        history = [_tokens(r["first"], r["second"], r["n"]) for r in _rows(runs)]
        replies: list[tuple[int, bytes, bytes]] = []
        tokens, ids = [], []
        bucket = None
        for e in _rows(entries):
            bucket = e["bucket"]
            if e["n"] < 0:
                replies += _replies(np.frombuffer(e["keys"], np.int64), np.frombuffer(e["checks"], np.uint64), chunks)
            else:
                tokens.append(_tokens(e["keys"], e["checks"], e["n"]))
                ids.append((unpack(e["ids"], e["n"]) + np.uint64(e["base"] % 2**64)).view(np.int64))
        fresh = np.zeros(0, np.uint64)
        if tokens:
            token, own = np.concatenate(tokens), np.concatenate(ids)
            tokens, ids = [], []
            order = np.lexsort((own, token))
            token, own = token[order], own[order]
            new = np.ones(len(token), dtype=bool)
            new[1:] = token[1:] != token[:-1]
            fresh = token[new]
            group = np.cumsum(new) - 1
            repeat = own != own[new][group]
            for old in history:
                at = np.minimum(np.searchsorted(old, fresh), len(old) - 1)
                repeat |= (old[at] == fresh)[group] if len(old) else False
            replies += _replies(own[repeat], token[repeat], chunks)
        if compact:
            fresh = np.unique(np.concatenate([fresh, *history]))
        if bucket is None and runs.num_rows:
            bucket = runs.column("place")[0].as_py()
        out = [(0, c, len(a) // 8, a, b) for c, a, b in replies]
        if len(fresh) and keep:
            out.append((1, bucket, len(fresh), pack(np.diff(fresh >> np.uint64(32), prepend=np.uint64(0))), (fresh & _LOW).astype("<u4").tobytes()))
        types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = zip(*out, strict=True) if out else [[]] * 5
        return pa.table([pa.array(list(v), t) for v, t in zip(columns, types, strict=True)], names=["kind", "place", "n", "first", "second"])

    return run


META = "buckets int, chunks int, width int, most_runs int, runs int"


class FingerprintIndex:
    """The runs of all batches so far."""

    def __init__(self, spark: SparkSession, buckets: int, chunks: int, width: int = WIDTH, most_runs: int = MOST_RUNS):
        self.spark, self.buckets, self.chunks, self.width, self.most_runs = spark, buckets, chunks, width, most_runs
        self.runs: list[DataFrame] = []
        self.run_paths: list[str] = []
        self.repeats: list[DataFrame] = []

    def add(self, batch: DataFrame, keep: bool = True) -> DataFrame:
        """Take in (id long, text), all of larger ids than before; returns the repeats (chunk, first, second).

        keep=False leaves the index as it was, for a batch that nothing will follow.
        """
        entries = batch.mapInArrow(_emit(self.width, self.buckets), ENTRY)
        runs = self.spark.createDataFrame([], OUT)
        for r in self.runs:
            runs = runs.unionByName(r)
        compact = keep and len(self.runs) + 1 > self.most_runs
        merged = entries.groupBy("bucket").cogroup(runs.groupBy("place")).applyInArrow(_merge(self.chunks, compact, keep), OUT)
        # Written as two tables in one pass, so that replaced runs can be deleted.
        path = write_table(merged, "substring", partition_by="kind")
        tables = read_table(self.spark, path, OUT)
        if compact:
            self.close()
        if keep:
            self.runs.append(tables.filter("kind = 1"))
            self.run_paths.append(f"{path}/kind=1")
        found = tables.filter("kind = 0").select(F.col("place").alias("chunk"), "first", "second")
        self.repeats.append(found)
        return found

    def save(self, path: str) -> None:
        """Keep the runs and what is needed to go on with them."""
        self.spark.createDataFrame([(self.buckets, self.chunks, self.width, self.most_runs, len(self.runs))], META).write.parquet(f"{path}/meta")
        for k, run in enumerate(self.runs):
            run.write.parquet(f"{path}/run-{k}")

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """A saved index; the saved files stay as they are."""
        *settings, n = spark.read.schema(META).parquet(f"{path}/meta").first()
        index = cls(spark, *settings)
        index.runs = [read_table(spark, f"{path}/run-{k}", OUT) for k in range(n)]
        return index

    def close(self) -> None:
        """Delete the runs."""
        for old in self.run_paths:
            delete_path(self.spark, old)
        self.runs, self.run_paths = [], []


def _cut(width: int):
    def run(docs: pa.Table, repeats: pa.Table) -> pa.Table:
        join = lambda name, kind: np.frombuffer(b"".join(x.as_py() for x in repeats.column(name)), kind)
        known = np.sort(mix(join("first", np.uint64) ^ mix(join("second", np.uint64))))
        schema = pa.schema([("row", docs.schema.field("row").type), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64())])

        def one(b: pa.RecordBatch) -> pa.RecordBatch:
            column = b.column(b.schema.get_field_index("text"))
            ids = b.column(b.schema.get_field_index("id")).to_numpy().astype(np.int64)
            buf, offsets = utf8(column)
            first, of, _, token, starts, _, doc = _marks(buf, offsets, width)
            n_words = np.bincount(doc, minlength=len(ids))
            covered = np.zeros(len(starts) + 1, dtype=np.int64)
            if len(known) and len(first):
                probe = mix(ids[of].view(np.uint64) ^ mix(token))
                hit = first[known[np.minimum(np.searchsorted(known, probe), len(known) - 1)] == probe]
                np.add.at(covered, hit, 1)
                np.add.at(covered, hit + width, -1)
            gone = np.cumsum(covered[:-1]) > 0
            n_gone = np.bincount(doc[gone], minlength=len(ids))
            begin = np.cumsum(n_words) - n_words
            texts = []
            for d in range(len(ids)):
                own = buf[offsets[d] : offsets[d + 1]].tobytes().split()
                if n_gone[d]:
                    own = [w for w, g in zip(own, gone[begin[d] : begin[d] + n_words[d]].tolist(), strict=True) if not g]
                texts.append(b" ".join(own).decode())
            return pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("row")), pa.array(texts, pa.string()), pa.array(n_words.astype(np.int64)), pa.array(n_gone.astype(np.int64))], schema=schema)

        made = [one(b) for batch in docs.to_batches() for b in slices(batch, "text", CUT)]
        return pa.Table.from_batches(made, schema)

    return run


def dedup_substrings(docs: DataFrame, width: int = WIDTH, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, text (the kept words, joined by blanks), n_words and n_removed of every row of docs."""
    spark = docs.sparkSession
    id_ = F.col(id_col).cast("long")
    shares = [k / batches for k in range(1, batches)]
    size, *cuts = docs.agg(F.sum(F.octet_length(text_col)), *([F.percentile_approx(id_, F.array(*map(F.lit, shares)), F.lit(10_000))] if shares else [])).first()
    cuts = (cuts or [None])[0]
    buckets = max(partitions(spark), -(-(size or 0) // BUCKET_BYTES))
    chunks = buckets  # a bucket answers each chunk with one row
    index = FingerprintIndex(spark, buckets, chunks, width)
    plain = docs.select(id_.alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    edges = [None, *sorted(set(cuts or [])), None]
    for low, high in zip(edges, edges[1:], strict=False):
        part = plain
        if low is not None:
            part = part.filter(F.col("id") > low)
        if high is not None:
            part = part.filter(F.col("id") <= high)
        index.add(part, keep=high is not None)
    index.close()
    repeats = index.repeats[0]
    for r in index.repeats[1:]:
        repeats = repeats.unionByName(r)
    rows = packed(docs, text_col, F.coalesce(id_, F.lit(NO_ID)).alias("id"), F.pmod(F.hash(F.coalesce(id_, F.xxhash64(F.col(text_col)))), F.lit(chunks)).alias("chunk"))
    return rows.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(_cut(width), f"row {rows.schema['row'].dataType.simpleString()}, text string, n_words long, n_removed long")


def op3_window_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of repeated 13-word windows."""
    kept = dedup_substrings(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select(F.col("row.doc_id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_ORACLE = """
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS k, ws FROM split WHERE len(ws) >= 13),
wins AS (SELECT doc_id, k, array_to_string(list_slice(ws, k, k + 12), ' ') AS s FROM placed),
firsts AS (SELECT s, min(doc_id) AS first FROM wins GROUP BY s),
hits AS (SELECT w.doc_id, w.k FROM wins w JOIN firsts f ON w.s = f.s WHERE f.first < w.doc_id),
gone AS (SELECT DISTINCT doc_id, k + j AS k FROM hits, range(13) t(j)),
word AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM split),
kept AS (SELECT w.doc_id, count(*) AS n_words, count(g.k) AS n_removed, string_agg(w.w, ' ' ORDER BY w.k) FILTER (WHERE g.k IS NULL) AS text FROM word w LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k GROUP BY w.doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

QUERIES = {"op3_window_index": op3_window_index}
ORACLES = {"op3_window_index": _ORACLE}
