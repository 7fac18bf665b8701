"""Byte-level BPE encoding and decoding on length-bucketed padded matrices.

A text is cut into pieces with array operations that give the same cuts as the
tokenizers' pattern.  Distinct pieces of a slice are encoded once: pieces of similar
byte length form a padded matrix of token ids; every round each row merges its leftmost
pair of minimum rank, found by a hashed pair lookup, and the matrix is compacted (one
column fewer, finished rows leave).  A piece over LONG_PIECE bytes is a row of its own, in
which a round merges, from the left, all pairs of the minimum rank up to the first merge that
makes a pair of lower rank: just those that single merges would take next.  Its columns lie in
blocks of BLOCK columns with their least rank each, and a round touches only the blocks that
hold the minimum.

A null text is empty; an empty text has no ids and decodes to no bytes.  Other columns
are not read, so clashing names do not matter.  Repeated rows and null ids each keep
their row; an empty table gives an empty result.  A text is encoded as a whole, so a very
long one takes about 60 times its size of memory.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents
from ._text import hash_spans, mix, slices, utf8

NONE = np.iinfo(np.int32).max
LONG_PIECE, BLOCK = 2048, 512
#: Bytes of text encoded at a time; the arrays take about 60 times as much memory.
SLICE = 1 << 20
OTHER, LETTER, NUMBER, WHITE = 0, 1, 2, 3


@dataclass
class Vocabulary:
    """Arrays shipped to the executors; their size is that of the vocabulary file."""

    tokens: list[bytes]
    byte_ids: np.ndarray
    pair_keys: np.ndarray
    pair_ids: np.ndarray
    probes: int
    whole: np.ndarray
    whole_check: np.ndarray
    whole_ids: np.ndarray
    class_starts: np.ndarray
    class_values: np.ndarray


def _class_ranges() -> tuple[np.ndarray, np.ndarray]:
    """Runs of code points of one class, as the tokenizer library's own regex engine sees them."""
    import tiktoken

    cps = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    text = "".join(map(chr, cps))
    table = np.zeros(0x110000, dtype=np.uint8)
    for value, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (WHITE, r"\s")):
        plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        found = bytes(plain.encode_ordinary(text)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = value
    starts = np.flatnonzero(np.r_[True, table[1:] != table[:-1]])
    return starts.astype(np.int32), table[starts]


def load_vocabulary(path: str) -> Vocabulary:
    """Read a rank file (base64 token, space, rank).  The driver reads it; executors get arrays."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, map(bytes.strip, f)))}
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    pairs = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    a, b, merged = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    keys = (a << 32 | b).astype(np.uint64)
    size = 1 << (len(keys) * 3).bit_length()
    table, ids = np.full(size, np.uint64(2**64 - 1)), np.full(size, NONE, dtype=np.int32)
    left, probes = np.arange(len(keys)), 0
    while len(left):
        slot = (mix(keys[left]) + np.uint64(probes)).astype(np.int64) & (size - 1)
        free = ids[slot] == NONE
        table[slot[free]], ids[slot[free]] = keys[left[free]], merged[left[free]]
        left = left[table[slot] != keys[left]]
        probes += 1
    lens = np.array([len(t) for t in tokens], dtype=np.int64)
    flat = np.frombuffer(b"".join(tokens), dtype=np.uint8)
    starts = np.cumsum(lens) - lens
    h, check = hash_spans(flat, starts, lens), hash_spans(flat, starts, lens, 1)
    order = np.argsort(h[lens > 0])
    real = np.flatnonzero(lens > 0)[order]
    return Vocabulary(tokens, np.array([ranks[bytes([x])] for x in range(256)], dtype=np.int32), table, ids, probes, h[real], check[real], real.astype(np.int32), *_class_ranges())


def piece_starts(points: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Positions where the pattern's matches begin.

    points: code points of all texts end to end; first: where each non-empty text begins.
    """
    n = len(points)
    kind = classes[points]
    opens = np.zeros(n + 1, dtype=bool)
    opens[first] = True
    opens[n] = True
    run = opens.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    starts = run.copy()
    white_end = np.flatnonzero(run[1:] & (kind == WHITE)) + 1  # one past each run of white space
    inner = white_end[~opens[white_end]]  # runs with something after them in the text
    starts[inner - 1] = True  # all but the last character stand alone ...
    joined = inner[points[inner - 1] == 0x20]
    starts[joined] = False  # ... and a last blank begins the next piece
    # Contractions: an apostrophe that begins a match, and what may follow it.
    quote = np.flatnonzero((points == 0x27) & starts[:n])
    quote = quote[quote + 1 < n]
    quote = quote[~opens[quote + 1]]
    one = points[quote + 1]
    two = np.where(quote + 2 < n, points[np.minimum(quote + 2, n - 1)], 0)
    two[opens[np.minimum(quote + 2, n)]] = 0
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    starts[quote[short | long] + 1] = False
    after = np.concatenate([quote[short] + 2, quote[long] + 3])
    # A blank after the contraction keeps its own rule; anything else starts a piece here.
    starts[after] = True
    return np.flatnonzero(starts[:n])


def _lookup(v: Vocabulary, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rank, which is also the id, of the token that each pair merges into."""
    keys = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    mask = len(v.pair_keys) - 1
    slot = mix(keys).astype(np.int64) & mask
    out = v.pair_ids[slot]
    wrong = np.flatnonzero((v.pair_keys[slot] != keys) & (out != NONE))
    out[(v.pair_keys[slot] != keys)] = NONE
    for _ in range(v.probes):
        if not len(wrong):
            break
        slot_w = slot[wrong] = (slot[wrong] + 1) & mask
        hit = v.pair_keys[slot_w] == keys[wrong]
        out[wrong[hit]] = v.pair_ids[slot_w[hit]]
        wrong = wrong[~hit & (v.pair_ids[slot_w] != NONE)]
    return out


def _rank(v: Vocabulary, ids: np.ndarray) -> np.ndarray:
    a, b = ids[:, :-1], ids[:, 1:]
    out = np.full(a.shape, NONE, dtype=np.int32)
    real = b >= 0
    out[real] = _lookup(v, a[real], b[real])
    return out


def merge_rows(v: Vocabulary, ids: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge every row of a matrix padded with -1 to its end; (ids row after row, count of each row)."""
    n, width = ids.shape
    done = np.full((n, width), -1, dtype=np.int32)
    rows, lens = np.arange(n), lens.copy()
    counts = lens.copy()
    rank = _rank(v, ids)
    while len(rows) and rank.shape[1]:
        at = rank.argmin(axis=1)
        least = rank[np.arange(len(rows)), at]
        over = least == NONE
        if over.any():
            done[rows[over], : ids.shape[1]] = ids[over]
            go = ~over
            rows, ids, rank, at, least = rows[go], ids[go], rank[go], at[go], least[go]
            if not len(rows):
                break
        k = np.arange(len(rows))
        keep = np.arange(ids.shape[1] - 1) <= at[:, None]
        ids = np.where(keep, ids[:, :-1], ids[:, 1:])
        ids[k, at] = least
        rank = np.where(keep[:, :-1], rank[:, :-1], rank[:, 1:])
        counts[rows] -= 1
        if rank.shape[1]:
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                b = ids[ok, side[ok] + 1]
                new = np.full(len(ok), NONE, dtype=np.int32)
                new[b >= 0] = _lookup(v, ids[ok[b >= 0], side[ok[b >= 0]]], b[b >= 0])
                rank[ok, side[ok]] = new
    if len(rows):
        done[rows, : ids.shape[1]] = ids
    return done[done >= 0], counts


def _merge_long(v: Vocabulary, piece: np.ndarray) -> np.ndarray:
    """The same merges for one long piece, many a round."""
    ids = v.byte_ids[piece].astype(np.int64)
    n = len(ids)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # neighbours among the columns still in use
    rank = np.full(-(-n // BLOCK) * BLOCK, NONE, dtype=np.int64)
    rank[: n - 1] = _lookup(v, ids[:-1], ids[1:])
    blocks = rank.reshape(-1, BLOCK)
    least = blocks.min(axis=1)

    def joined(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> np.ndarray:
        out = np.full(len(ok), NONE, dtype=np.int64)
        out[ok] = _lookup(v, a[ok], b[ok])
        return out

    while (r := int(least.min())) != NONE:
        # The pairs of that rank; of a chain that overlaps, every second one.
        where = np.flatnonzero(least == r)
        row, column = np.nonzero(blocks[where] == r)
        at = where[row] * BLOCK + column
        chained = np.zeros(len(at), dtype=bool)
        chained[1:] = after[at[:-1]] == at[1:]
        heads = np.flatnonzero(~chained)
        at = at[(np.arange(len(at)) - np.repeat(heads, np.diff(np.append(heads, len(at))))) % 2 == 0]
        right = after[at]  # the second column of each pair
        follow, lead = np.where(right < n, after[np.minimum(right, n - 1)], n), before[at]
        # What stands to the left once the merges before this one are done.
        left_id = np.where(lead >= 0, ids[lead], -1)
        touching = np.zeros(len(at), dtype=bool)
        touching[1:] = right[:-1] == lead[1:]
        left_id[touching] = r
        made = np.full(len(at), r, dtype=np.int64)
        low = np.minimum(joined(left_id, made, lead >= 0), joined(made, ids[np.minimum(follow, n - 1)], follow < n))
        stop = np.flatnonzero(low < r)
        if len(stop):
            keep = slice(0, int(stop[0]) + 1)
            at, right, follow = at[keep], right[keep], follow[keep]
        ids[at], ids[right] = r, -1
        after[at] = follow
        inside = follow < n
        before[follow[inside]] = at[inside]
        changed = np.unique(np.concatenate([at, before[at][before[at] >= 0]]))
        next_ = after[changed]
        rank[right] = NONE
        rank[changed] = joined(ids[changed], ids[np.minimum(next_, n - 1)], next_ < n)
        dirty = np.unique(np.concatenate([changed, right]) // BLOCK)
        least[dirty] = blocks[dirty].min(axis=1)
    return ids[ids >= 0].astype(np.int32)


def _ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """values[start:start+count] of every span, end to end."""
    ends = np.cumsum(counts)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)]


def encode_pieces(v: Vocabulary, buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of every piece end to end, and the count of each."""
    out: list[np.ndarray] = []
    counts = np.ones(len(starts), dtype=np.int64)
    order: list[np.ndarray] = []
    h, check = hash_spans(buf, starts, lens), hash_spans(buf, starts, lens, 1)
    at = np.minimum(np.searchsorted(v.whole, h), len(v.whole) - 1)
    known = (v.whole[at] == h) & (v.whole_check[at] == check)
    order.append(np.flatnonzero(known))
    out.append(v.whole_ids[at[known]])
    rest = np.flatnonzero(~known)
    bucket = np.where(lens[rest] <= 16, lens[rest], 1 << np.ceil(np.log2(np.maximum(lens[rest], 1)) * 2).astype(np.int64).clip(0, 60) // 2 + 5)
    bucket[lens[rest] > LONG_PIECE] = -1
    for width in np.unique(bucket):
        group = rest[bucket == width]
        if width < 0:
            for g in group:
                ids = _merge_long(v, buf[starts[g] : starts[g] + lens[g]])
                out.append(ids)
                counts[g] = len(ids)
            order.append(group)
            continue
        wide = int(lens[group].max())
        step = max(1, (1 << 18) // wide)
        for part in (group[i : i + step] for i in range(0, len(group), step)):
            cols = np.arange(wide)
            real = cols < lens[part][:, None]
            ids = np.full(real.shape, -1, dtype=np.int32)
            ids[real] = v.byte_ids[buf[(starts[part][:, None] + cols)[real]]]
            merged, n = merge_rows(v, ids, lens[part])
            out.append(merged)
            counts[part] = n
            order.append(part)
    order_all, flat = np.concatenate(order), np.concatenate(out)
    begins = np.empty(len(starts), dtype=np.int64)
    run = counts[order_all]
    begins[order_all] = np.cumsum(run) - run
    return _ragged(flat, begins, counts), counts


def encode_texts(v: Vocabulary, classes: np.ndarray, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, and the n + 1 offsets into them."""
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), dtype=np.uint32)
    at_byte = np.append(np.flatnonzero((buf & 0xC0) != 0x80), len(buf))
    first = np.searchsorted(at_byte, np.unique(offsets[offsets < len(buf)]))
    starts = at_byte[piece_starts(points, first, classes)]
    lens = np.diff(np.append(starts, len(buf)))
    h = hash_spans(buf, starts, lens)
    _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    if (hash_spans(buf, starts, lens, 1) != hash_spans(buf, starts[rep], lens[rep], 1)[inverse]).any():  # equal first hashes of different pieces
        rep, inverse = np.arange(len(starts)), np.arange(len(starts))
    ids, counts = encode_pieces(v, buf, starts[rep], lens[rep])
    begins = np.cumsum(counts) - counts
    upto = np.concatenate([[0], np.cumsum(counts[inverse])])
    return _ragged(ids, begins[inverse], counts[inverse]), upto[np.searchsorted(starts, offsets)]


def class_table(v: Vocabulary) -> np.ndarray:
    return np.repeat(v.class_values, np.diff(np.append(v.class_starts, 0x110000)))


def _decoded(tokens: list[bytes], ids: np.ndarray) -> bytes:
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def bpe_encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        classes = class_table(v)
        for batch in batches:
            for b in slices(batch, "text", SLICE):
                ids, offsets = encode_texts(v, classes, *utf8(b.column(1)))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))], names=["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>").withColumnRenamed("id", id_col)


def bpe_decode(encoded: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id") -> DataFrame:
    """id_col, ids, decoded binary.  A null list decodes to no bytes; an id that the vocabulary lacks fails."""
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for b in batches:
            lists = b.column(1)
            texts = [_decoded(tokens, x.values.to_numpy()) if x.is_valid else b"" for x in lists]
            yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(texts, pa.binary())], names=["id", "ids", "decoded"])

    rows = encoded.select(F.col(id_col).alias("id"), "ids")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    vocabulary = load_vocabulary(path)
    decoded = bpe_decode(bpe_encode(docs, vocabulary), vocabulary)
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the byte_bpe_50k ranks, and decoded again."""
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"))


QUERIES = {"op2_byte_bpe": op2_byte_bpe}
ORACLES: dict[str, str] = {}
