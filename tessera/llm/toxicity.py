"""Toxic passages by maximum-scoring segments over token log-odds.

Tokens are runs of ASCII letters and digits and of non-ASCII bytes, A-Z lower-cased; a
token's features are itself and its first 6, 5 and 4 bytes, which catches inflected forms.
From a bounded sample of labelled documents, of near copies one each, each feature gets the
log-odds ratio of the documents that hold it, with an informative Dirichlet prior (its
pseudo-counts follow the feature's overall frequency).  A token scores the ratio of its
longest feature whose ratio is significant; any other token scores a small penalty, so
long clean text scores negative.  A linear scan (Ruzzo and Tompa) finds all maximal segments
of every whole text.  Extreme-value theory gives the expected number of chance segments
of at least a segment's score, K n exp(-lambda S); segments expected less than
MAX_EXPECTED times are toxic passages.  The sum of -ln of those expectations is turned
into a probability.  Three quarters of the sample teach the ratios; the other quarter, for
which they are not made to fit, teaches the extreme-value law and the logistic curve.

Null and empty texts have no passages and get the score of such a text.  Repeated rows
keep their rows and score alike.  Null labels teach nothing.  With no labelled document of
one of the classes the score is the share of toxic labels, or 0 without labels.  A very long
text is one slice, at about 40 times its size of memory.  The other columns travel as one
struct, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, packed, scratch, unpacked
from ._text import LOWER, hash_spans, mix, slices, utf8, windows, words

#: The model is fitted on at most so many labelled documents, those of the smallest hashed ids.
SAMPLE_DOCS = 20_000
#: Pseudo-count mass of the prior, least z-score and count of a scored token, penalty of any other.
PRIOR, LEAST_Z, LEAST_COUNT, PENALTY = 1_000.0, 3.0, 4, 0.1
PREFIXES = (6, 5, 4)
MAX_EXPECTED = 0.05
TOKEN = np.zeros(256, dtype=bool)
TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True

PASSAGES = "array<struct<start:long,end:long,score:double,expected:double>>"


@dataclass
class Model:
    """Scores by sorted token hash, and the calibration."""

    hashes: np.ndarray
    scores: np.ndarray
    decay: float = 1.0
    rate: float = 1.0
    slope: float = 0.0
    intercept: float = -30.0


def tokens(buf: np.ndarray, offsets: np.ndarray):
    """Start, length and text number of the tokens, and the hashes of their features, longest first."""
    starts, lens, doc = words(buf, offsets, TOKEN)
    low = LOWER[buf]
    return starts, lens, doc, [hash_spans(low, starts, lens), *(hash_spans(low, starts, np.minimum(lens, k), k) for k in PREFIXES)]


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments [first, last] by the linear-time scan."""
    stack: list[tuple[int, int, float, float]] = []  # first, last, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        first, left, right = i, before, total
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            first, left = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, i, left, right))
    return [(a, b, r - l) for a, b, l, r in stack]


def _passages(m: Model, buf: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, float, float]]], list[float], np.ndarray]:
    """By text: significant segments (byte span, score, expectation), the best score; and the token counts."""
    starts, lens, doc, h = tokens(buf, offsets)
    n = len(offsets) - 1
    size = np.bincount(doc, minlength=n)
    score = np.full(len(starts), -PENALTY)
    for feature in h[::-1] if len(m.hashes) else []:  # the longest known feature comes last and stays
        at = np.minimum(np.searchsorted(m.hashes, feature), len(m.hashes) - 1)
        known = m.hashes[at] == feature
        score[known] = m.scores[at[known]]
    good = np.flatnonzero(score > 0)
    upto = np.concatenate([[0.0], np.cumsum(score)])
    found: list[list[tuple[int, int, float, float]]] = [[] for _ in range(n)]
    best = [0.0] * n
    for group in np.split(good, np.flatnonzero(np.diff(doc[good])) + 1) if len(good) else []:
        d = int(doc[group[0]])
        # What lies between two positive tokens counts as one negative step.
        gaps = upto[group[1:]] - upto[group[:-1] + 1]
        steps = np.empty(2 * len(group) - 1)
        steps[::2], steps[1::2] = score[group], gaps
        for a, b, s in maximal_segments(steps.tolist()):
            best[d] = max(best[d], s)
            expected = m.rate * float(size[d]) * np.exp(-m.decay * s)
            if expected < MAX_EXPECTED:
                x, y = group[a // 2], group[b // 2]
                found[d].append((int(starts[x] - offsets[d]), int(starts[y] + lens[y] - offsets[d]), float(s), float(expected)))
    return found, best, size


def _evidence(found: list[tuple[int, int, float, float]]) -> float:
    return float(min(200.0, sum(-np.log(max(x[3], 1e-80)) for x in found)))


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            _, _, doc, h = tokens(*utf8(b.column(0)))
            pairs = np.unique(np.stack([np.tile(doc, len(h)).astype(np.uint64), np.concatenate(h)], axis=1).view("u8,u8"))
            toxic = np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)[pairs["f0"].astype(np.int64)]
            keys, inverse = np.unique(pairs["f1"], return_inverse=True)
            bad = np.bincount(inverse, weights=toxic, minlength=len(keys)).astype(np.int64)
            all_ = np.bincount(inverse, minlength=len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(bad), pa.array(all_ - bad)], names=["token", "bad", "good"])


def _minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Three min-hashes over the 5-word windows of every text; of a shorter text three hashes of it all."""
    for batch in batches:
        for b in slices(batch, "text"):
            buf, offsets = utf8(b.column(2))
            starts, lens, doc = words(buf, offsets)
            first, h = windows(hash_spans(LOWER[buf], starts, lens), doc, 5)
            out = np.stack([hash_spans(buf, offsets[:-1], np.diff(offsets), k) for k in range(3)])
            if len(h):
                full, begin = np.unique(doc[first], return_index=True)
                for k in range(3):
                    out[k, full] = np.minimum.reduceat(mix(h ^ np.uint64(k + 1)), begin)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(m.view(np.int64)) for m in out)], names=["id", "toxic", "m0", "m1", "m2"])


def learn_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, keep=materialise, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text, toxic and part (0 to 3) of at most `most` labelled documents that are not held out; of near copies one."""
    marked = labels.filter(F.col("toxic").isNotNull() & ~_held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    marked = marked.orderBy(F.xxhash64("id"), "id").limit(most)  # bounded, so it may be broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashes = texts.join(F.broadcast(marked), "id").select("id", "toxic", "text").mapInArrow(_minima, "id long, toxic int, m0 long, m1 long, m2 long")
    for m in ("m0", "m1", "m2"):
        hashes = hashes.groupBy(m).agg(F.min_by(F.struct(*hashes.columns), "id").alias("one")).select("one.*")
    chosen = keep(hashes.select("id", "toxic").distinct(), "toxic-ids")
    found = texts.join(F.broadcast(chosen), "id").groupBy("id", "toxic").agg(F.min("text").alias("text"))
    return found.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)).cast("int").alias("part"))


def _held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _solve_decay(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum p exp(x s) = 1."""
    p = weights / weights.sum()
    if (p * scores).sum() >= 0 or scores.max() <= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(high * scores)).sum() < 1 and high < 50:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * scores)).sum() < 1 else (low, mid)
    return max(high, 1e-3)


def _fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a weak ridge."""
    w = np.zeros(2)
    a = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + 1e-2 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(hess, g), -2, 2)
    return float(max(w[0], 0.0)), float(w[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    with scratch(docs.sparkSession) as keep:
        return _fit(keep(learn_sample(docs, labels, most, keep, id_col, text_col), "toxic-sample"), keep)


def _fit(sample: DataFrame, keep) -> Model:
    taught, fresh = sample.filter("part < 3"), sample.filter("part = 3")
    counts = keep(taught.mapInArrow(_count_tokens, "token long, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "toxic-counts")
    totals = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not totals[0] or not totals[1]:
        share = sample.agg(F.avg("toxic")).first()[0]
        odds = np.clip(share or 0.0, 1e-12, 1 - 1e-12)
        return Model(np.zeros(0, np.uint64), np.zeros(0), intercept=float(np.log(odds / (1 - odds))))
    n1, n0 = map(float, totals)
    bad, good = F.col("bad"), F.col("good")
    prior = 0.5 + (bad + good) * (PRIOR / (n1 + n0))
    odds = lambda y, n: F.log((y + prior) / (F.lit(n + PRIOR) - y - prior))
    ratio = odds(bad, n1) - odds(good, n0)
    z = ratio / F.sqrt(1 / (bad + prior) + 1 / (good + prior))
    # The sample bounds this: every scored token occurs LEAST_COUNT times in it.
    rows = counts.filter(bad + good >= LEAST_COUNT).withColumns({"ratio": ratio, "z": z}).filter(F.abs("z") >= LEAST_Z).select("token", "ratio", "good").toPandas()
    h = rows["token"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    s, g = rows["ratio"].to_numpy(dtype=float)[order], rows["good"].to_numpy(dtype=float)[order]
    m = Model(h[order], s)
    m.decay = _solve_decay(np.append(s, -PENALTY), np.append(g, max(n0 / (1 + len(PREFIXES)) - g.sum(), 1.0)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                found, best, size = _passages(m, *utf8(b.column(0)))
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(size, 1).astype(np.int64)), pa.array(best, pa.float64()), pa.array([_evidence(x) for x in found], pa.float64()), b.column(1)], names=["n", "best", "evidence", "toxic"])

    shape = "n long, best double, evidence double, toxic int"
    clean = fresh.filter("toxic = 0").mapInArrow(measure, shape).agg(F.count(F.lit(1)), F.sum(F.expr(f"n * exp(-{m.decay!r} * best)"))).first()
    m.rate = float(clean[0] / max(clean[1], 1e-9))  # maximum likelihood of the extreme-value law's K
    # Which segments are significant depends on the rate, so the evidence takes a pass of its own.
    seen = fresh.mapInArrow(measure, shape).select("evidence", "toxic").toPandas()  # at most `most` rows of two numbers
    m.slope, m.intercept = _fit_logistic(np.sqrt(seen["evidence"].to_numpy(dtype=float)), seen["toxic"].to_numpy(dtype=float))
    return m


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row, text, score and passages (byte spans of the text) of every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            for b in slices(batch, "text"):
                found, _, _ = _passages(m, *utf8(b.column(1)))
                x = np.sqrt([_evidence(f) for f in found])
                score = 1 / (1 + np.exp(-np.clip(m.slope * x + m.intercept, -30, 30)))
                rows = pa.array([[dict(zip(("start", "end", "score", "expected"), p, strict=True)) for p in f] for f in found], kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), rows], names=["row", "text", "score", "passages"])

    rows = packed(docs, text_col)
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, text string, score double, passages {PASSAGES}")


def remove_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows that score at least threshold."""
    return unpacked(score_toxicity(docs, fit_toxicity(docs, labels)).filter(F.col("score") < threshold), docs, "text")


def op1_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_toxicity(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    doc_id = F.col("row.doc_id")
    return scored.select(doc_id.alias("doc_id"), _held_out(doc_id).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


QUERIES = {"op1_toxic_segments": op1_toxic_segments}
ORACLES: dict[str, str] = {}
