"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: lower case, words (runs of letters, digits and _)
joined by single blanks.  An item of length L is found in a text if a stretch of the text
is within e = floor(L * RATE) edits of it.  The item is split into e + 1 pieces; at most e
edits leave one of them intact, so the exact hits of all pieces (one Aho-Corasick pass)
are the only places to look at.

A hit is verified by Myers' bit-parallel distance, first on small groups: any group of m
neighbouring pieces that holds its share of the edits has at most m - 1, so a hit climbs
from its piece to pairs, fours and so on with that budget, and only what survives is
compared as a whole with budget e.  No match is lost.

The items are a stated query set.  They are read in blocks of at most BLOCK_CHARS
characters, each sent to the executors and run over all whole texts.  An item of fewer than
LEAST_WORDS words has no error budget and must stand between word ends; it is found and
reported like any other, but a document that holds only such an item is not thrown out by
`decontaminate`, as clean text holds phrases that short.  Null items and items without words
are found nowhere; null and empty texts hold no item.  Repeated rows are found each; repeated
items once, items that share an id each with the least distance of them.  Of equally good
matches the first counts.  A very long text takes about ten times its size of memory.  Only
the named columns are read, or the others travel as one struct; their names cannot clash.
Ids must be integers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents, materialise, packed, unpacked

RATE, LEAST_WORDS, BLOCK_CHARS = 0.1, 8, 1 << 20
_WORD = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def best_match(peq: dict[str, int], length: int, text: str) -> tuple[int, int]:
    """Least edit distance between the pattern and any stretch of text, and where the first such stretch ends."""
    full, high = (1 << length) - 1, 1 << (length - 1)
    up, down, score = full, 0, length
    best, end = score, 0
    for i, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(xh | up) & full, up & xh
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
            if score < best:
                best, end = score, i
        plus, minus = plus << 1, minus << 1
        up, down = (minus | ~(xv | plus)) & full, plus & xv & full
    return best, end


class Item:
    """A test item cut into error-budget-plus-one pieces, and the groups above them."""

    def __init__(self, item_id: int, text: str, rate: float = RATE):
        self.id, self.text = item_id, text
        self.short = text.count(" ") + 1 < LEAST_WORDS
        self.budget = 0 if self.short else int(len(text) * rate + 1e-9)
        n = self.budget + 1
        self.cuts = [len(text) * i // n for i in range(n + 1)]
        self._groups: dict[tuple[int, int], tuple[dict[str, int], int]] = {}

    def pieces(self) -> Iterator[tuple[int, str]]:
        for i, (a, b) in enumerate(zip(self.cuts, self.cuts[1:], strict=False)):
            yield i, self.text[a:b]

    def _group(self, first: int, last: int) -> tuple[dict[str, int], int]:
        if (first, last) not in self._groups:
            part = self.text[self.cuts[first] : self.cuts[last]]
            self._groups[first, last] = masks(part), len(part)
        return self._groups[first, last]

    def verify(self, piece: int, begin: int, text: str) -> tuple[int, int, int] | None:
        """(distance, search start, end) if the piece's hit at `begin` extends to the whole item within the budget."""
        if self.short:
            end = begin + len(self.text)
            return (0, begin, end) if f" {text[max(0, begin - 1) : end + 1]} ".find(f" {self.text} ") >= 0 else None
        n, width = self.budget + 1, 2
        start = begin - self.cuts[piece]  # where the item would begin without edits
        other = piece ^ 1
        if other < n:
            # The pair's one edit, if any, is in the neighbour, so one half of that is intact.
            a, b = self.cuts[other], self.cuts[other + 1]
            middle = (a + b) // 2
            around = text[max(0, start + a - 1) : start + b + 1]
            if self.text[a:middle] not in around and self.text[middle:b] not in around:
                return None
        while True:
            first = piece // width * width
            last = min(n, first + width)
            whole = first == 0 and last == n
            budget = last - first - 1
            # Edits between the hit and the group's ends shift them by at most the budget.
            low = max(0, start + self.cuts[first] - budget)
            peq, length = self._group(first, last)
            best, end = best_match(peq, length, text[low : start + self.cuts[last] + budget])
            if best > budget:
                return None
            if whole:
                return best, low, low + end
            width *= 2


class Matcher:
    def __init__(self, items: Iterable[tuple[int, str]], rate: float = RATE):
        import ahocorasick

        self.items = [Item(i, t, rate) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, item in enumerate(self.items):
            for p, piece in item.pieces():
                where.setdefault(piece, []).append((k, p))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> dict[int, tuple[int, int]]:
        """item id -> least (distance, end in the normalised text)."""
        found: dict[int, tuple[int, int]] = {}
        if not self.items or not text:
            return found
        seen: set[tuple[int, int, int]] = set()
        for last, (length, places) in self.automaton.iter(text):
            for k, p in places:
                item, begin = self.items[k], last + 1 - length
                if found.get(item.id, (1,))[0] == 0 or (k, p, begin) in seen:
                    continue
                seen.add((k, p, begin))
                hit = item.verify(p, begin, text)
                if hit and (hit[0], hit[2]) < found.get(item.id, (item.budget + 1, 0)):
                    found[item.id] = hit[0], hit[2]
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str, least_words: int = 1, most: int | None = None) -> Iterator[list[tuple[int, str]]]:
    """The items of at least so many words, in blocks of at most `most` characters; one block at a time is on the driver."""
    most = most or BLOCK_CHARS
    block: list[tuple[int, str]] = []
    size = 0
    for row in items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).filter(F.col(id_col).isNotNull()).distinct().toLocalIterator():
        text = normalised(row[1])
        if text.count(" ") + 1 < least_words or not text:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row[0], text))
        size += len(text)
    if block:
        yield block


def find_items(docs: DataFrame, items: DataFrame, rate: float = RATE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, distance and end_char (in the normalised text) of every item found in every row of docs."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id long, item_id long, distance int, end_char long"
    found = None
    for block in item_blocks(items, item_col, item_text):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                out = [(i, item, d, end) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True) for item, (d, end) in sorted(matcher.find(normalised(t.as_py())).items())]
                columns = zip(*out, strict=True) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "item_id", "distance", "end_char"])

        part = materialise(rows.mapInArrow(run, schema), "leaks")
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, rate: float = RATE, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs without the rows that hold an item of at least so many words; rows are dropped where they lie, without a join."""
    spark = docs.sparkSession
    rows = packed(docs, "text")
    schema = rows.schema
    for block in item_blocks(items, "item_id", "text", least_words):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for b in batches:
                yield b.filter(pa.array([not matcher.find(normalised(t.as_py())) for t in b.column(1)], pa.bool_()))

        rows = rows.mapInArrow(run, schema)
    return unpacked(rows, docs, "text")


def op5_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return find_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op5_pigeonhole": op5_pigeonhole}
ORACLES: dict[str, str] = {}
