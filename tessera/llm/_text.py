"""Vectorised text primitives over Arrow string columns.

Words are runs of bytes other than 0x20 and 0x09-0x0D; all of those are ASCII, so
cutting UTF-8 bytes there never splits a code point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)
_S32 = np.uint64(32)
#: Masks that keep the first n bytes of a little-endian 8-byte load.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 8 << 20):
    """Cut a batch into pieces of about `most` bytes of the text column."""
    _, offsets = utf8(batch.column(batch.schema.get_field_index(name)))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + most, "right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S32)) * _M1
    x = (x ^ (x >> _S32)) * _M1
    return x ^ (x >> _S32)


def hash_spans(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of buf[start:start+len] for every span, eight bytes a round."""
    padded = np.zeros(len(buf) + 8, dtype=np.uint8)
    padded[: len(buf)] = buf
    loads = np.ndarray((len(buf) + 1,), dtype=np.uint64, buffer=padded.data, strides=(1,))
    h = mix(lens.astype(np.uint64) * _M2 + np.uint64(seed * 0x51ED2701 + 1))
    alive, at, left = None, starts.astype(np.int64), lens.astype(np.int64)
    while len(at):
        part = h if alive is None else h[alive]
        part = mix((part + _M2) ^ (loads[at] & _MASK[np.minimum(left, 8)]))
        if alive is None:
            h = part
        else:
            h[alive] = part
        go = np.flatnonzero(left > 8)
        alive = go if alive is None else alive[go]
        at, left = at[go] + 8, left[go] - 8
    return h


def words(buf: np.ndarray, offsets: np.ndarray, within: np.ndarray = ~SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and text number of every word, a run of bytes that `within` marks."""
    solid = within[buf]
    n = len(buf)
    before = np.zeros(n, dtype=bool)
    before[1:] = solid[:-1]
    after = np.zeros(n, dtype=bool)
    after[:-1] = solid[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends - starts, np.searchsorted(offsets, starts, "right") - 1


#: Bytes of text whose words are found and hashed at a time; the arrays for that take about 30 times as much memory.
BLOCK = 2 << 20


def hashed_words(buf: np.ndarray, offsets: np.ndarray, lower: bool = False, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Start, length and text number of every word, and its hash for each seed.

    Works through the bytes in blocks cut before white space, also inside a text, so that a
    very long text takes only the memory of its words.
    """
    cuts = [0]
    while len(buf) - cuts[-1] > 2 * BLOCK:
        at = cuts[-1] + BLOCK
        while at < len(buf):
            space = np.flatnonzero(SPACE[buf[at : at + BLOCK]])
            if len(space):
                at += int(space[0])
                break
            at = min(len(buf), at + BLOCK)  # one word of more than a block stays whole
        cuts.append(at)
    cuts.append(len(buf))
    found = []
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = offsets[np.searchsorted(offsets, a, "right") : np.searchsorted(offsets, b, "left")]
        part = LOWER[buf[a:b]] if lower else buf[a:b]
        starts, lens, _ = words(part, np.concatenate([[0], own - a, [b - a]]))
        found.append((starts + a, lens, *(hash_spans(part, starts, lens, seed) for seed in seeds)))
    starts, lens, *hashes = (np.concatenate(c) for c in zip(*found, strict=True))
    return starts, lens, np.searchsorted(offsets, starts, "right") - 1, hashes


def windows(word_hash: np.ndarray, doc: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """First word number and 64-bit hash of every run of `width` words of one text."""
    n = len(word_hash) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(doc[:n] == doc[width - 1 :])
    h = np.full(len(first), np.uint64(seed * 0x2545F491 + width), dtype=np.uint64)
    for j in range(width):
        h = mix((h + _M2) ^ word_hash[first + j])
    return first, h
