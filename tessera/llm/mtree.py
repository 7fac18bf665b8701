"""Exact top-k inner products by best-first search of M-trees.

Inner products are no metric, so every vector x gets one more component
sqrt(M - |x|^2), M the largest squared norm of its tree, and a query q gets 0; then
d(q, x)^2 = |q|^2 + M - 2 q.x, and the nearest vectors are those of the largest products.

Rows are dealt into blocks by hash of the id; each block builds one tree of paged nodes,
once, and the trees are written as a table of one row each.  An inner entry has a routing
vector, a covering radius and its distance to the parent's routing vector; a leaf entry has
that distance too.  A search takes the node of least lower bound d(q, o) - radius first; the
queries of a block share the queue.  Within a page, entries whose stored parent distance
already rules them out (|d(q, parent) - d(entry, parent)| - radius beyond the k-th distance)
are skipped without computing their distance.  Equal bounds are followed, so ties are
complete.  Equal vectors share one entry, which lists the smallest k + 1 ids of them: no query
needs more.

The queries are sent to the trees, in blocks of at most QUERY_ROWS and QUERY_BYTES; a task
takes its trees one after another, and what it has found so far bounds the search of the next.
A block of queries is therefore one pass over the table of trees without a shuffle; only each
task's best k of a query are dealt by query and merged.  Products are exact integers: doubles
hold them up to 2^53.

Vectors that are null or hold null or non-finite components take no part, nor do null
ids.  Rows that repeat an id count once, with the smallest vector.  A shorter vector is
filled up with zeros.  Columns other than the two named are not read.  An empty table gives
an empty result.
"""

from __future__ import annotations

import heapq
import itertools
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import materialise, partitions

PAGE, FANOUT, BLOCK_ROWS = 128, 32, 1 << 15
#: Bounds of a block of queries that is broadcast.
QUERY_ROWS, QUERY_BYTES = 1 << 15, 32 << 20
#: Queries that share a queue.
TOGETHER = 512
SLACK = 1e-6


class MTree:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        order = np.lexsort((ids, *vectors.T[::-1])) if vectors.shape[1] else np.argsort(ids)
        ids, vectors = ids[order], vectors[order]
        new = np.ones(len(ids), dtype=bool)
        new[1:] = (vectors[1:] != vectors[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.ids, self.begin = ids, first
        self.count = np.minimum(np.diff(np.append(first, len(ids))), k + 1)
        self.x = vectors[first]
        norms = (self.x**2).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.extra = np.sqrt(self.top - norms)
        self.norms, self.k = norms, k
        self.nodes: list[tuple] = []  # leaf: (points, parent distances); inner: (routing points, parent distances, radii, children)
        self.rng = np.random.default_rng(7)
        self.root = self._grow(np.arange(len(first)), None) if len(first) else -1

    def _distance(self, points: np.ndarray, to: np.ndarray) -> np.ndarray:
        square = self.norms[points][:, None] + self.norms[to] - 2 * (self.x[points] @ self.x[to].T) + (self.extra[points][:, None] - self.extra[to]) ** 2
        return np.sqrt(np.maximum(square, 0))

    def _grow(self, points: np.ndarray, parent: int | None) -> int:
        far = self._distance(points, np.array([parent]))[:, 0] if parent is not None else np.zeros(len(points))
        if len(points) <= PAGE:
            order = np.argsort(far)
            self.nodes.append((points[order], far[order]))
            return len(self.nodes) - 1
        centres = self.rng.choice(points, min(FANOUT, -(-len(points) // (PAGE // 2))), replace=False)
        near = self._distance(points, centres)
        own = near.argmin(axis=1)
        if len(np.unique(own)) < 2:
            own = np.arange(len(points)) % len(centres)
        used = np.unique(own)
        radii = np.array([near[own == c, c].max() for c in used])
        children = [self._grow(points[own == c], int(centres[c])) for c in used]
        up = self._distance(centres[used], np.array([parent]))[:, 0] if parent is not None else np.zeros(len(used))
        self.nodes.append((centres[used], up, radii, children))
        return len(self.nodes) - 1

    def search(self, queries: np.ndarray, own: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query number, score, id) of the k best of every query, ties to the smaller id; and the number of distances computed.

        held: what other trees have given, which counts among the best.  The queries share one queue: a node's bound is the least of those of the queries
        that may still need it, and a page is computed for just these queries at once.
        """
        n = len(queries)
        reference = (queries**2).sum(axis=1) + self.top
        worst, reach = np.full(n, -np.inf), np.full(n, np.inf)
        held = held or (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = computed = 0

        def settle() -> None:
            nonlocal held, pending, waiting
            who, score, ids = (np.concatenate(c) for c in zip(held, *pending, strict=True))
            order = np.lexsort((ids, -score, who))
            who, score, ids = who[order], score[order], ids[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            keep = rank < self.k
            last = rank == self.k - 1
            worst[who[last]] = score[last]
            reach[who[last]] = np.sqrt(np.maximum(reference[who[last]] - 2 * score[last], 0.0))
            held, pending, waiting = (who[keep], score[keep], ids[keep]), [], 0

        if len(held[0]):
            settle()
        order = itertools.count()
        queue = [(0.0, next(order), self.root, np.zeros(n), np.zeros(n))] if self.root >= 0 else []
        while queue:
            _, _, node, bounds, to_parent = heapq.heappop(queue)
            who = np.flatnonzero(bounds <= reach + SLACK)
            if not len(who):
                continue
            page, limit = self.nodes[node], reach[who, None] + SLACK
            radii = page[2] if len(page) == 4 else 0.0
            near = np.abs(to_parent[who, None] - page[1]) - radii <= limit if node != self.root else np.ones((len(who), len(page[0])), dtype=bool)
            entries = np.flatnonzero(near.any(axis=0))
            if not len(entries):
                continue
            score = queries[who] @ self.x[page[0][entries]].T
            computed += score.size
            if len(page) == 4:
                d = np.sqrt(np.maximum(reference[who, None] - 2 * score, 0))
                low = np.where(near[:, entries], np.maximum(d - page[2][entries], 0.0), np.inf)
                low[low > limit] = np.inf
                for c in np.flatnonzero(np.isfinite(low).any(axis=0)):
                    bound, dist = np.full(n, np.inf), np.zeros(n)
                    bound[who], dist[who] = low[:, c], d[:, c]
                    heapq.heappush(queue, (float(low[:, c].min()), next(order), page[3][entries[c]], bound, dist))
                continue
            a, b = np.nonzero(score >= worst[who, None])
            if not len(a):
                continue
            points, copies = page[0][entries[b]], self.count[page[0][entries[b]]]
            ids = self.ids[np.repeat(self.begin[points] - (np.cumsum(copies) - copies), copies) + np.arange(copies.sum())]
            asker, score = np.repeat(who[a], copies), np.repeat(score[a, b], copies)
            other = ids != own[asker]
            pending.append((asker[other], score[other], ids[other]))
            waiting += len(asker)
            if waiting >= 4 * n:
                settle()
        if pending:
            settle()
        return held[0], held[1].astype(np.int64), held[2], computed


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column("vec_id").combine_chunks().to_numpy()
    lists = t.column("x").combine_chunks()
    lens = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), int(lens.max()) if len(lens) else 0))
    real = np.arange(out.shape[1]) < lens[:, None]
    out[real] = lists.flatten().to_numpy()
    return ids, out


TREE = "block int, tree binary"


def _grow_block(k: int):
    """The tree of one block of vectors, as one row."""

    def run(t: pa.Table) -> pa.Table:
        tree = MTree(*_matrix(t), k)
        kind = next((c for c in ("int8", "int16", "int32") if not tree.x.size or (tree.x.min() >= np.iinfo(c).min and tree.x.max() <= np.iinfo(c).max)), "int64")
        tree.x, tree.rng = tree.x.astype(kind), None
        return pa.table({"block": pa.array([t.column("block")[0].as_py()], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


FOUND = "query_id long, vec_id long, score long"


def _search(shared, k: int):
    """The k best of every query of the block in the trees of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        parts = [slice(i, i + TOGETHER) for i in range(0, len(own), TOGETHER)]
        best: list = [None] * len(parts)
        for batch in batches:
            for row in batch.column("tree"):
                tree = pickle.loads(row.as_buffer())
                tree.x = tree.x.astype(float)
                wide = max(queries.shape[1], tree.x.shape[1])
                tree.x = np.pad(tree.x, ((0, 0), (0, wide - tree.x.shape[1])))
                for n, part in enumerate(parts):
                    q = queries[part].astype(float)
                    *best[n], _ = tree.search(np.pad(q, ((0, 0), (0, wide - q.shape[1]))), own[part], best[n])
        for part, found in zip(parts, best, strict=True):
            if found is not None:
                who, score, ids = found
                yield pa.RecordBatch.from_arrays([pa.array(own[part][who].astype(np.int64)), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.int64))], names=["query_id", "vec_id", "score"])

    return run


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the queries, in blocks; one block at a time is on the driver."""
    ids: list[int] = []
    rows: list[list[int]] = []

    def block() -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(rows), max(map(len, rows))), dtype=np.int64)
        for i, r in enumerate(rows):
            out[i, : len(r)] = r
        return np.array(ids, dtype=np.int64), out

    widest = 0
    for row in queries.select("vec_id", "x").toLocalIterator(prefetchPartitions=True):
        ids.append(row[0])
        rows.append(row[1])
        widest = max(widest, len(row[1]))
        if len(rows) >= QUERY_ROWS or 8 * widest * len(rows) >= QUERY_BYTES:
            yield block()
            ids, rows, widest = [], [], 0
    if rows:
        yield block()


def top_k(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "x") -> DataFrame:
    """query_id, rank, vec_id, score for all rows of vectors (integer components) where is_query holds."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<long>").alias("x")).filter(F.col("vec_id").isNotNull())
    rows = materialise(rows.groupBy("vec_id").agg(F.min("x").alias("x")), "vectors")
    n = rows.count()
    # Every core gets trees; more than BLOCK_ROWS rows in one would not make its search better.
    blocks = max(1, -(-n // BLOCK_ROWS), min(2 * partitions(spark), n // 1024))
    trees = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).groupBy("block").applyInArrow(_grow_block(k), TREE)
    trees = materialise(trees, "trees").repartition(max(1, min(blocks, 4 * partitions(spark))), "block")
    found = None
    for block in query_blocks(rows.filter(is_query(F.col("vec_id")))):
        part = materialise(trees.mapInArrow(_search(spark.sparkContext.broadcast(block), k), FOUND), "nearest")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # at most k rows of each task
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all embeddings for every vec_id divisible by 20."""
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter(F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * 64).cast("long"))
    return top_k(rows.select("vec_id", x.alias("x")), lambda i: i % 20 == 0)


QUERIES = {"op6_mtree": op6_mtree}
ORACLES = {"op6_mtree": """
WITH rows AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(64 * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score FROM rows q JOIN rows c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""}
