"""Exact n-gram Jaccard self-join by PartEnum signatures, and the components of its links.

A document's set holds the 64-bit hashes of its distinct 5-word shingles.  Two sets of sizes
a and b link when their Jaccard similarity is at least 3/4, so they differ in at most
(a + b) / 7 elements, and their sizes fall into the same or neighbouring bands [l, r] with
r = floor(l / 0.75).  Every set takes part in its own band and in the next; in a band of
largest size r a linked pair differs in at most k = floor(2 r / 7) elements.

The two levels of PartEnum: the band cuts the element domain by hash into n1 partitions, and
each partition into 3 parts.  A partition in which a pair differs in at most one part has a
subset of 2 parts in which the two sets are equal, so every set enumerates the three such
subsets of each partition as signatures (partition, subset, hash of the set's elements in
it).  k differences cost two signatures each while they fall into different partitions and
one more each after that; with n1 = floor(k / 2) + 1 + floor(k / 8) a linked pair always
shares q = 3 n1 - 2 min(k, n1) - max(0, k - n1) >= 1 of its 3 n1 signatures.

Which signatures have to be named is settled by one total order over them, by the number of
sets that hold the rarest element: a linked pair's lowest common signature has at most
3 n1 - q others below it in either set, so the 3 n1 - q + 1 lowest of each set suffice.  A
signature with an element of its own set alone cannot be shared and is counted but not sent;
a set with too many of those, or with under 3/4 of its elements found elsewhere, has no
partner and sends nothing.  Empty signatures come last in the order; a set that would have
to name one sends its rarest elements instead (enough that a partner shares one), and so
does any partner that needs it.

Links are found in two passes, neither of which pairs a group with itself.

The first sends only SKETCH of the signatures of each set and compares each node with one
other: of those that share one of them, the one with most elements in common with anyone.
Its verified links already join most near copies into components.

The second is exact.  "Holders" are now components instead of sets: a signature with an
element of its own component alone cannot be shared with another one, so only what may still
join two components is sent.  Members of a group that lie in several components are compared
with one centre; all groups of one centre form its court.  A group's centre is its member in
most groups, or twice in turn (HOPS) the best centre that a member has in any of its groups.
Groups that overlap so come to share a centre: with each a centre of its own, every member
of a family of sets that are alike, but not enough to link, would sit in courts that grow in
number and in size with the family.

What is then left to find are links between two components of a court, and comparing all
with all is not needed for that.  The symmetric difference with the centre keeps distances:
with D(x) = x ^ centre, two sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| elements.  If
|D(x)| + |D(y)| <= (a + b) / 7, both are linked to the centre already (each size exceeds the
centre's by |D| at most, so neither |D| can exceed its own bound), so two components of a
court can only be joined by sets whose differences have at least
t = (|D(x)| + |D(y)| - (a + b) / 7) / 2 > 0 elements in common.  Ordered by the number of
members that hold them, the |D(x)| - t + 1 rarest elements of each difference suffice, and
those that one component alone holds are counted but not sent.  At most (a + b) / 7 + 1 are
sent for each member of a court.  Near copies of one text differ from it in elements that few
others share; sets further from it lack the same parts of it, and the pairs of those that
have to be verified can still grow with the square of such a family.

Every candidate is verified on the whole sets.

Equal sets within a chunk of documents are one node.  Null, empty and wordless texts have
an empty set and link with nothing.  Rows with the same id are one document for linking;
rows without an id are told apart by their texts, and a class has no component_id if none of
its rows has an id.  Ids must be integers under 2^62.  A very long text takes memory for its
words, not for a multiple of its bytes.  Only id and text are read, so other columns may have
any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import delete_path, documents, materialise, partitions, read_table, write_table
from ._text import hashed_words, mix, utf8, windows
from .substring_dedup import pack, unpack

SHINGLE = 5
#: Similarity as a fraction: linked when DEN * intersection >= NUM * union.
NUM, DEN = 3, 4
#: Signatures of a set and band in the first pass.
SKETCH = 6
#: How often groups of the second pass take over a better centre of a group that they share a member with.
HOPS = 2
#: Bytes of text to a bucket of elements, and to a chunk of documents.
BUCKET_BYTES, CHUNK_BYTES = 16 << 20, 4 << 20
#: Rows without an id get one from here on, by their text; so such classes come after all others.
NO_ID = 1 << 62
_KEY = np.uint64((1 << 40) - 1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Elements of all sets end to end, sorted within each, and the n + 1 offsets."""
    n = len(offsets) - 1
    _, _, doc, (h,) = hashed_words(buf, offsets, lower=True)
    first, element = windows(h, doc, SHINGLE)
    of = doc[first]
    count = np.bincount(doc, minlength=n)
    begin = np.cumsum(count) - count
    for width in range(1, SHINGLE):  # shorter texts: the whole sequence is the one element
        short = np.flatnonzero(count == width)
        if len(short):
            whole = np.full(len(short), np.uint64(width), dtype=np.uint64)
            for j in range(width):
                whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) ^ h[begin[short] + j])
            of, element = np.concatenate([of, short]), np.concatenate([element, whole])
    order = np.lexsort((element, of))
    of, element = of[order], element[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (element[1:] != element[:-1])
    of, element = of[new], element[new]
    return element, np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int64)


def _chunk_nodes(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one chunk: ids, set sizes, node of every row, and the elements and offsets of the distinct sets with their nodes."""
    ids = t.column("id").combine_chunks().to_numpy().astype(np.int64)
    element, offsets = shingle_sets(*utf8(t.column("text")))
    size = np.diff(offsets)
    sums = np.zeros((2, len(ids)), dtype=np.uint64)
    full = np.flatnonzero(size)
    if len(full):
        for k in (0, 1):
            sums[k, full] = np.add.reduceat(mix(element ^ np.uint64(k * 0xABCDEF + 1)), offsets[full])
    order = np.lexsort((ids, sums[1], sums[0], size))
    key = np.stack([size[order].astype(np.uint64), sums[0][order], sums[1][order]])
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (key[:, 1:] != key[:, :-1]).any(axis=0)
    node = np.empty(len(ids), dtype=np.int64)
    node[order] = ids[order][new][np.cumsum(new) - 1] if len(ids) else ids
    node[size == 0] = ids[size == 0]
    heads = order[new]
    heads = np.sort(heads[size[heads] > 0])
    keep = np.repeat(np.isin(np.arange(len(ids)), heads), size)
    return ids, size, node, element[keep], np.concatenate([[0], np.cumsum(size[heads])]), ids[heads]


COUNTS = "bucket int, chunk int, n long, keys binary, counts binary"


def _count_chunk(buckets: int):
    def run(t: pa.Table) -> pa.Table:
        element, count = np.unique(_chunk_nodes(t)[3], return_counts=True)
        bucket, key = (element >> np.uint64(40)) % np.uint64(buckets), element & _KEY
        order = np.lexsort((key, bucket))
        bucket, key, count = bucket[order], key[order], count[order].astype(np.uint64)
        parts = np.split(np.arange(len(key)), np.flatnonzero(np.diff(bucket)) + 1) if len(key) else []
        chunk = t.column("chunk")[0].as_py()
        rows = [(int(bucket[p[0]]), chunk, len(p), pack(np.diff(key[p], prepend=np.uint64(0))), pack(count[p])) for p in parts]
        return _table(rows, COUNTS)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.table([pa.array(list(c), _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


SHARED = "chunk int, n long, keys binary, counts binary"


def _sum_bucket(t: pa.Table) -> pa.Table:
    """For every chunk the elements of this bucket that other sets hold too, and how many sets do."""
    rows = t.to_pylist()
    keys = [np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64) for r in rows]
    distinct, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(inverse, weights=np.concatenate([unpack(r["counts"], r["n"]) for r in rows]))
    out, at = [], 0
    for r, k in zip(rows, keys, strict=True):
        n = total[inverse[at : at + len(k)]]
        at += len(k)
        common = n > 1
        if common.any():
            token = k[common] | np.uint64(r["bucket"] << 40)
            out.append((r["chunk"], len(token), pack(np.diff(token, prepend=np.uint64(0))), pack(np.minimum(n[common], 2**32).astype(np.uint64))))
    return _table(out, SHARED)


def bands(most: int) -> np.ndarray:
    """Largest sizes r of the bands, up to two beyond the one that holds `most`."""
    out = [0]
    while len(out) < 3 or out[-3] < most:
        out.append((out[-1] + 1) * DEN // NUM)
    return np.array(out, dtype=np.int64)


def plan(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For bands of largest size r: partitions of three parts, and how many of a set's lowest signatures it has to name."""
    k = np.maximum(1, 2 * r // (NUM + DEN))
    n1 = k // 2 + 1 + k // 8
    shared = 3 * n1 - 2 * np.minimum(k, n1) - np.maximum(0, k - n1)
    return n1, 3 * n1 - shared + 1


def signatures(element: np.ndarray, offsets: np.ndarray, holders: np.ndarray, sketch: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) pairs to send; holders: how many sets, or components, hold each element.

    With `sketch` at most so many for each set and band, those of the smallest hash.
    """
    size = np.diff(offsets)
    n = len(size)
    of = np.repeat(np.arange(n), size)
    common = np.bincount(of[holders > 1], minlength=n)
    possible = DEN * common >= NUM * size
    keep = possible[of]
    element, holders, of = element[keep], holders[keep], of[keep]
    ends = bands(int(size.max()) if n else 1)
    band = np.searchsorted(ends, size)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    short = np.zeros(n, dtype=bool)
    for step in (0, 1):
        r = ends[band + step]
        # The smallest partner in this band, and what a link with it takes.
        smallest = np.maximum(-(-NUM * size // DEN), ends[np.maximum(band - 2, 0)] + 1) if step == 0 else ends[band] + 1
        alive = possible & ((NUM + DEN) * common >= NUM * (size + smallest))
        n1, name = plan(r)
        m = np.where(alive, 3 * n1, 0)
        base = np.cumsum(m) - m
        salt = mix(r.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(17))
        here = alive[of]
        own_element, own_holders, own_of = element[here], holders[here], of[here]
        cell = base[own_of] + (mix(own_element ^ salt[own_of]) % (3 * n1)[own_of].astype(np.uint64)).astype(np.int64)
        cells = int(m.sum())
        rarest = np.full(cells, np.iinfo(np.int64).max)
        np.minimum.at(rarest, cell, own_holders)
        total = np.zeros(cells, dtype=np.uint64)
        np.add.at(total, cell, mix(own_element + np.uint64(0x5BF03635)))
        # Signature j of a partition leaves out its part j.
        rarest, total = rarest.reshape(-1, 3), total.reshape(-1, 3)
        rarest = np.minimum(rarest[:, [1, 0, 0]], rarest[:, [2, 2, 1]]).reshape(-1)
        total = (total[:, [1, 0, 0]] + total[:, [2, 2, 1]]).reshape(-1)
        owner = np.repeat(np.arange(n), m)
        number = np.arange(cells) - base[owner]
        filled = rarest < np.iinfo(np.int64).max
        own = np.bincount(owner[rarest == 1], minlength=n)
        short |= alive & (np.bincount(owner[filled], minlength=n) < name)
        c = np.flatnonzero(filled & (rarest > 1) & (own < name)[owner])
        sig = mix(total[c] ^ mix(number[c].astype(np.uint64) ^ salt[owner[c]]))
        order = np.lexsort((sig, rarest[c], owner[c]))
        who = owner[c][order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        pick = rank < (name - own)[who]
        who, sig = who[pick], sig[order][pick]
        if sketch is not None:
            order = np.lexsort((sig, who))
            who, sig = who[order], sig[order]
            pick = np.arange(len(who)) - np.searchsorted(who, who) < sketch
            who, sig = who[pick], sig[pick]
        found.append((who, sig))
    if short.any():
        e = np.flatnonzero(short[of])
        order = e[np.lexsort((element[e], holders[e], of[e]))]
        who = of[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        need = size - -(-NUM * size // DEN) + 1
        pick = (rank < need[who]) & (holders[order] > 1)
        found.append((who[pick], mix(element[order][pick] ^ np.uint64(0xE1E2E3E4))))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


PARTS = "kind int, a long, b long, n int, blob binary"


def _holders(element: np.ndarray, shared: pa.Table, buckets: int) -> np.ndarray:
    """How many hold each element; 1 where the table has nothing."""
    holders = np.ones(len(element), dtype=np.int64)
    rows = shared.to_pylist()
    if rows and len(element):
        token = np.concatenate([np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
        count = np.concatenate([unpack(r["counts"], r["n"]) for r in rows]).astype(np.int64)
        order = np.argsort(token)
        token, count = token[order], count[order]
        own = ((element >> np.uint64(40)) % np.uint64(buckets)) << np.uint64(40) | (element & _KEY)
        at = np.minimum(np.searchsorted(token, own), len(token) - 1)
        hit = token[at] == own
        holders[hit] = count[at[hit]]
    return holders


def _common(offsets: np.ndarray, holders: np.ndarray) -> np.ndarray:
    """How many elements of each set others hold too."""
    n = len(offsets) - 1
    return np.bincount(np.repeat(np.arange(n), np.diff(offsets))[holders > 1], minlength=n)


def _slack(offsets: np.ndarray, common: np.ndarray) -> np.ndarray:
    """How much more a set has in common than a link with one of its own size takes, times 7."""
    return (NUM + DEN) * common - 2 * NUM * np.diff(offsets)


def _sign_chunk(buckets: int):
    """kind 0: document, node, size; kind 1: signature, node, slack; kind 2: node and its set, if it may have a partner."""

    def run(t: pa.Table, shared: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], PARTS)
        ids, size, node, element, offsets, heads = _chunk_nodes(t)
        holders = _holders(element, shared, buckets)
        who, sig = signatures(element, offsets, holders, SKETCH) if len(heads) else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        slack = _slack(offsets, _common(offsets, holders))
        sets = np.unique(who)
        n0, n1, n2 = len(ids), len(sig), len(sets)
        blobs = [element[offsets[i] : offsets[i + 1]].tobytes() for i in sets]
        columns = [
            np.repeat([0, 1, 2], [n0, n1, n2]).astype(np.int32), np.concatenate([ids, sig.view(np.int64), heads[sets]]), np.concatenate([node, heads[who], heads[sets]]),
            np.concatenate([size, slack[who], np.diff(offsets)[sets]]).astype(np.int32),
        ]
        return pa.table([*map(pa.array, columns), pa.array([None] * (n0 + n1) + blobs, pa.binary())], names=["kind", "a", "b", "n", "blob"])

    return run


def _sets(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Nodes, components, and the elements and offsets of the sets of a chunk."""
    blobs = t.column("blob").to_pylist()
    offsets = np.concatenate([[0], np.cumsum([len(b) // 8 for b in blobs])]).astype(np.int64)
    return t.column("node").to_numpy().astype(np.int64), t.column("component").to_numpy().astype(np.int64), np.frombuffer(b"".join(blobs), np.uint64), offsets


HELD = "bucket int, chunk int, n long, base long, keys binary, components binary, counts binary"


def _held_by(buckets: int):
    """The distinct (element, component) pairs of a chunk and how many sets each stands for, by bucket."""

    def run(t: pa.Table) -> pa.Table:
        _, component, element, offsets = _sets(t)
        if "centre" in t.column_names:  # elements of different courts have nothing to do with each other
            element = _of_court(element, np.repeat(t.column("centre").to_numpy(), np.diff(offsets)))
        rows = np.empty(len(element), dtype=[("b", "u8"), ("k", "u8"), ("c", "i8")])
        rows["b"], rows["k"], rows["c"] = (element >> np.uint64(40)) % np.uint64(buckets), element & _KEY, np.repeat(component, np.diff(offsets))
        if not len(rows):
            return _table([], HELD)
        rows, count = np.unique(rows, return_counts=True)
        base, chunk = int(rows["c"].min()), t.column("chunk")[0].as_py()
        parts = np.split(np.arange(len(rows)), np.flatnonzero(np.diff(rows["b"])) + 1)
        packed = lambda p: (pack(np.diff(rows["k"][p], prepend=np.uint64(0))), pack((rows["c"][p] - base).view(np.uint64)), pack(count[p].astype(np.uint64)))
        return _table([(int(rows["b"][p[0]]), chunk, len(p), base, *packed(p)) for p in parts], HELD)

    return run


def _sum_components(sets: bool):
    """For every chunk the elements of this bucket that several components hold, and how many do; or how many sets."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        keys = [np.cumsum(unpack(r["keys"], r["n"]), dtype=np.uint64) for r in rows]
        pairs = np.empty(sum(map(len, keys)), dtype=[("k", "u8"), ("c", "i8")])
        pairs["k"] = np.concatenate(keys)
        pairs["c"] = np.concatenate([(unpack(r["components"], r["n"]) + np.uint64(r["base"] % 2**64)).view(np.int64) for r in rows])
        distinct, holders = np.unique(np.unique(pairs)["k"], return_counts=True)
        total = holders
        if sets:
            total = np.zeros(len(distinct), dtype=np.int64)
            np.add.at(total, np.searchsorted(distinct, pairs["k"]), np.concatenate([unpack(r["counts"], r["n"]) for r in rows]).astype(np.int64))
        out = []
        for r, k in zip(rows, keys, strict=True):
            k = np.unique(k)
            at = np.searchsorted(distinct, k)
            at, k = at[holders[at] > 1], k[holders[at] > 1]
            if len(k):
                out.append((r["chunk"], len(k), pack(np.diff(k | np.uint64(r["bucket"] << 40), prepend=np.uint64(0))), pack(total[at].astype(np.uint64))))
        return _table(out, SHARED)

    return run


OPEN = "sig long, node long, size long, common long"


def _sign_components(buckets: int):
    """Signatures that may join components, and how many elements of the set other components hold too."""

    def run(t: pa.Table, shared: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], OPEN)
        node, _, element, offsets = _sets(t)
        holders = _holders(element, shared, buckets)
        who, sig = signatures(element, offsets, holders)
        columns = [sig.view(np.int64), node[who], np.diff(offsets)[who], _common(offsets, holders)[who]]
        return pa.table([pa.array(c) for c in columns], names=["sig", "node", "size", "common"])

    return run


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = []
        for x, y in zip(b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]))
            common = int((both[1:] == both[:-1]).sum())
            ok.append(DEN * common >= NUM * (len(both) - common))
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column("u").filter(keep), b.column("v").filter(keep)], names=["u", "v"])


COURT = "centre long, node long, size long, d long, linked boolean, delta binary"


def _centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symmetric difference of each node's set with its centre's, and whether the two link."""
    for b in batches:
        out: list[tuple] = []
        for centre, node, x, y in zip(b.column("centre").to_pylist(), b.column("node").to_pylist(), b.column("x"), b.column("y"), strict=True):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = np.sort(np.concatenate([p, q]))
            again = np.zeros(len(both) + 1, dtype=bool)
            again[1:-1] = both[1:] == both[:-1]
            common = int(again.sum())
            alone = both[~(again[1:] | again[:-1])]
            out.append((centre, node, len(q), len(alone), DEN * common >= NUM * (len(both) - common), alone.tobytes()))
        columns = zip(*out, strict=True) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in COURT.split(", ")])


def _of_court(element: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return mix(element ^ mix(centre.view(np.uint64)))


PREFIX = "token long, centre long, node long, component long, size long, d long, after long"


def _prefixes(buckets: int):
    """Of each difference the elements of its prefix that other components of the court hold too.

    after: how many such elements come no earlier in the order of rarity than this one.
    """

    def run(t: pa.Table, shared: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _table([], PREFIX)
        node, component, element, offsets = _sets(t)
        centre, size, d, need = (t.column(c).to_numpy() for c in ("centre", "size", "d", "need"))
        of = np.repeat(np.arange(len(node)), np.diff(offsets))
        token = _of_court(element, centre[of])
        n = _holders(token, shared, buckets)
        token, n, of = token[n > 1], n[n > 1], of[n > 1]
        order = np.lexsort((token, n, of))
        token, of = token[order], of[order]
        after = np.searchsorted(of, of, "right") - np.arange(len(of))
        pick = after > (d - need)[of]
        token, of, after = token[pick], of[pick], after[pick]
        return pa.table([pa.array(x) for x in (token.view(np.int64), centre[of], node[of], component[of], size[of], d[of], after)], names=[f.split()[0] for f in PREFIX.split(", ")])

    return run


class _Tables:
    """Written tables of one run; under one name a new table replaces the last, whose files go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
        path = write_table(df, f"ngram-{name}", partition_by)
        if name in self.paths:
            delete_path(self.spark, self.paths[name])
        self.paths[name] = path
        return read_table(self.spark, path, df.schema)

    def finish(self, *needed: str) -> None:
        """Delete what the result does not read; of the parts it reads the documents."""
        for kind in (1, 2):
            delete_path(self.spark, f"{self.paths['parts']}/kind={kind}")
        self.drop(*(n for n in list(self.paths) if n not in (*needed, "parts")))

    def drop(self, *names: str) -> None:
        for name in names:
            delete_path(self.spark, self.paths.pop(name))


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs u < v whose sets link; the sizes alone rule some out."""
    u, v = sets.select(F.col("b").alias("u"), F.col("n").alias("nu"), F.col("blob").alias("x")), sets.select(F.col("b").alias("v"), F.col("n").alias("nv"), F.col("blob").alias("y"))
    near = (DEN * F.col("nu").cast("long") >= NUM * F.col("nv").cast("long")) & (DEN * F.col("nv").cast("long") >= NUM * F.col("nu").cast("long"))
    return pairs.join(v, "v").join(u, "u").filter(near).select("u", "v", "x", "y").mapInArrow(_similar, "u long, v long")


def components(links: DataFrame, put) -> DataFrame:
    """(node, component) of every node with a link: alternating large and small stars until nothing changes."""
    ordered = lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    edges, seen = put(ordered(links), "edges"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = put(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        edges = put(ordered(both.join(least, "u").filter("v > u").select(F.col("m").alias("u"), "v")), "edges")
        least = put(edges.groupBy("v").agg(F.min("u").alias("m")), "least")
        edges = put(ordered(edges.join(least, "v").select("m", "u", "v").selectExpr("stack(2, m, u, m, v) as (u, v)")), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))
        seen = now


def _placed(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """nodes with their present component."""
    return nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _courts(member: DataFrame, found: DataFrame, sets: DataFrame, put) -> tuple[DataFrame, DataFrame]:
    """The courts of all groups that lie in several components (COURT), and the links to their centres."""
    link = lambda other: (NUM + DEN) * F.col("common") >= NUM * (F.col("size") + F.col(other))
    apart = lambda df, *more: df.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), *more).filter("low < high").drop("low", "high")
    now = put(_placed(member, found), "members")
    now = put(now.join(apart(now, F.min("size").alias("least")), "sig").filter(link("least")).drop("least"), "members")
    groups = now.join(apart(now), "sig").groupBy("node").agg(F.count(F.lit(1)).alias("groups"))
    rank = F.struct("groups", (F.lit(NUM + DEN) * F.col("common") - F.lit(2 * NUM) * F.col("size")).alias("slack"), "node")
    lead = put(apart(now.join(groups, "node"), F.max(rank).alias("lead")), "lead")
    for _ in range(HOPS):
        best = now.join(lead, "sig").groupBy("node").agg(F.max("lead").alias("best"))
        # Summed up before the join with what it came from, so that a large group is not dealt to one task.
        lead = put(now.join(best, "node").groupBy("sig").agg(F.max("best").alias("lead")).join(lead.select("sig"), "sig", "left_semi"), "lead")
    pairs = put(now.join(lead, "sig").select(F.col("lead.node").alias("centre"), "node").distinct(), "pairs")
    x, y = (sets.select(F.col("b").alias(who), F.col("blob").alias(blob)) for who, blob in (("centre", "x"), ("node", "y")))
    court = put(pairs.join(y, "node").join(x, "centre").select("centre", "node", "x", "y").mapInArrow(_centred, COURT), "court")
    return court, court.filter("linked and centre <> node").select(F.least("centre", "node").alias("u"), F.greatest("centre", "node").alias("v"))


def _between_components(court: DataFrame, found: DataFrame, chunk, buckets: int, put) -> DataFrame:
    """Candidate pairs u < v of one court and different components."""
    row = _placed(court.drop("linked"), found)
    # The least difference within a court, and the least among the components other than that one's.
    nearest = row.filter("d > 0").groupBy("centre", "component").agg(F.min("d").alias("d"), F.max("size").alias("size"))
    first = nearest.groupBy("centre").agg(F.min(F.struct("d", "component")).alias("first"), F.max("size").alias("largest"), F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").drop("low", "high")
    second = nearest.join(first, "centre").filter(F.col("component") != F.col("first.component")).groupBy("centre").agg(F.min("d").alias("second"))
    bounds = put(first.join(second, "centre").select("centre", "first", "second", "largest"), "bounds")
    row = row.join(bounds, "centre")
    partner = F.when(F.col("component") == F.col("first.component"), F.col("second")).otherwise(F.col("first.d"))
    # 2 t >= |D(x)| + |D(y)| - (a + b) / 7, with the largest b and the least |D(y)| that a partner may have;
    # as the differences have at most |D(y)| elements in common, |D(y)| >= |D(x)| - (a + b) / 7.
    most = F.floor((F.col("size") + F.least("largest", F.floor(F.col("size") * DEN / NUM))) / (NUM + DEN))
    over = F.col("d") + F.greatest(partner, F.col("d") - most) - most
    row = row.withColumn("need", F.col("d") + 1 - F.greatest(F.lit(1), F.ceil(over / 2))).filter("need > 0")
    row = put(row.select(chunk("centre", "node"), "centre", "node", "component", "size", "d", "need", F.col("delta").alias("blob")), "placed")
    shared = row.groupBy("chunk").applyInArrow(_held_by(buckets), HELD).groupBy("bucket").applyInArrow(_sum_components(True), SHARED)
    token = put(row.groupBy("chunk").cogroup(put(shared, "shared").groupBy("chunk")).applyInArrow(_prefixes(buckets), PREFIX), "tokens")
    other = token.select("token", "centre", *(F.col(c).alias(f"{c}2") for c in ("node", "component", "size", "d", "after")))
    # A pair's lowest common element has all t of them at or after it, in either difference.
    fits = (F.col("component") != F.col("component2")) & (F.col("node") < F.col("node2")) & ((NUM + DEN) * (F.col("d") + F.col("d2") - 2 * F.least("after", "after2")) <= F.col("size") + F.col("size2"))
    return put(token.join(other, ["token", "centre"]).filter(fits).select(F.col("node").alias("u"), F.col("node2").alias("v")).distinct(), "pairs")


def _ids(id_col: str, text_col: str):
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64(text), 2))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_shingles and component_id (the smallest id reachable by links) of every row of docs."""
    spark = docs.sparkSession
    tables = _Tables(spark)
    put = tables.put
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets, chunks = max(partitions(spark), -(-size // BUCKET_BYTES)), max(partitions(spark), -(-size // CHUNK_BYTES))
    chunk = lambda *c: F.pmod(F.xxhash64(*c), F.lit(chunks)).cast("int").alias("chunk")
    text = F.col(text_col).cast("string")
    id_ = _ids(id_col, text_col)
    # By id and text, so that many rows of one id, or of one text, do not meet in one chunk.
    rows = docs.select(F.pmod(F.xxhash64(id_, text), F.lit(chunks)).cast("int").alias("chunk"), id_.alias("id"), text.alias("text"))
    counted = rows.groupBy("chunk").applyInArrow(_count_chunk(buckets), COUNTS)
    shared = put(counted.groupBy("bucket").applyInArrow(_sum_bucket, SHARED), "shared")
    signed = rows.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_sign_chunk(buckets), PARTS)
    parts = put(signed, "parts", partition_by="kind")
    tables.drop("shared")
    nodes, named, sets = parts.filter("kind = 0"), parts.filter("kind = 1").select(F.col("a").alias("sig"), F.struct(F.col("n").alias("slack"), F.col("b").alias("node")).alias("own")), parts.filter("kind = 2").select("b", "n", "blob")

    # First pass: one comparison for each node.
    best = named.groupBy("sig").agg(F.max("own").alias("best"))
    pairs = named.join(best, "sig").groupBy("own.node").agg(F.max("best").alias("best")).select(F.least("node", "best.node").alias("u"), F.greatest("node", "best.node").alias("v"))
    pairs = put(pairs.filter("u < v").distinct(), "pairs")
    links = put(_verify(pairs, sets), "links-first")
    found = components(links, put)

    # Second pass: what may join components.
    placed = sets.withColumnRenamed("b", "node").join(found, "node", "left").select(chunk("node"), "node", F.coalesce("component", "node").alias("component"), "blob")
    placed = put(placed, "placed")
    held = placed.groupBy("chunk").applyInArrow(_held_by(buckets), HELD)
    shared = put(held.groupBy("bucket").applyInArrow(_sum_components(False), SHARED), "shared")
    member = put(placed.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(_sign_components(buckets), OPEN), "open")
    tables.drop("placed", "shared")
    court, more = _courts(member, found, sets, put)
    tables.drop("open")
    if not more.isEmpty():
        links = links.unionByName(more)
        found = components(links, put)
    more = put(_verify(_between_components(court, found, chunk, buckets, put), sets), "links-last")
    if not more.isEmpty():
        found = components(links.unionByName(more), put)
    tables.finish("edges")
    real = lambda c: F.when(c < NO_ID, c)
    return nodes.select(F.col("a").alias("key"), F.col("b").alias("node"), "n").join(found, "node", "left").select(
        real(F.col("key")).alias("id"), F.col("n").cast("long").alias("n_shingles"), real(F.coalesce("component", "node")).alias("component_id"), "key", F.coalesce("component", "node").alias("component_key")
    )


def op7_partenum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    return jaccard_classes(documents(spark, sf_dir)).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component: that of the smallest id; of its repeated rows one stays.

    Rows of one id are one document: those with the same text are copies, of which one stays,
    those with another text stay too.  So does one row of each text that has no id.
    """
    classes = materialise(jaccard_classes(docs, id_col, text_col).select("key", "component_key"), "ngram-classes")
    gone = classes.filter("key <> component_key").select(F.col("key").alias("_gone")).distinct()
    key = F.struct(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _ids(id_col, text_col).alias("key"))
    rows = docs.select(key.alias("x")).select("x.*")
    kept = rows.join(gone, rows["key"] == gone["_gone"], "left_anti")
    # Few ids repeat, if any: only their rows are compared by text.
    again = classes.groupBy("key").count().filter("count > 1").select(F.col("key").alias("_again"))
    if not again.isEmpty():
        once = kept.join(again, kept["key"] == again["_again"], "left_anti")
        kept = kept.join(again, kept["key"] == again["_again"], "left_semi").withColumn("text", F.xxhash64(F.col(f"row.`{text_col}`"), F.lit(1))).dropDuplicates(["key", "text"]).drop("text").unionByName(once)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


_ORACLE = """
WITH RECURSIVE split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
placed AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS k FROM split WHERE len(ws) > 0),
elements AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, k, k + 4), ' ') AS s FROM placed),
sizes AS (SELECT doc_id, count(*) AS n FROM elements GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM elements a JOIN elements b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN both_ways e ON r.y = e.x)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) r ON r.x = d.doc_id
"""

QUERIES = {"op7_partenum": op7_partenum}
ORACLES = {"op7_partenum": _ORACLE}
