"""Vectorised words and hashes over Arrow text columns.

A batch of texts is one byte buffer with offsets, so splitting into words, hashing words and hashing
every rolling window of words are a handful of numpy passes over that buffer, without a Python object
per word.  A word is hashed by lanes of eight bytes, each mixed with its place before they are added up;
windows of words are hashed by doubling, each step mixed.  No step is linear over a whole word or window,
so no pattern of letters or words makes different ones meet more often than chance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
ODD = U(0x9E3779B97F4A7C15)
LEFT, RIGHT, JOINED = U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
#: The first 0 to 8 bytes of a little-endian lane.
LANES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)
#: The separators of the word pattern [^\x20\x09-\x0D]+ .
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
CHUNK_BYTES = 2 << 20

IS_WORD = np.ones(256, bool)
IS_WORD[list(SPACES)] = False


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (first one 0) of a text column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``limit`` bytes of ``column`` (a longer single text is a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes.astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    word = is_word[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    edge = offsets[:-1]
    before[edge[edge < len(data)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    edge = offsets[1:] - 1
    after[edge[edge >= 0]] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, each of at least one byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    lane = np.ndarray(len(data) + 1, "<u8", padded, 0, (1,))
    size = ends - starts
    total = mix64((lane[starts] & LANES[np.minimum(size, 8)]) + ODD)
    long = np.flatnonzero(size > 8)
    if len(long):
        n = (size[long] + 7) >> 3
        edge = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(edge, n)
        at = np.repeat(starts[long], n) + 8 * k
        left = np.minimum(np.repeat(ends[long], n) - at, 8)
        total[long] = np.add.reduceat(mix64((lane[at] & LANES[left]) + ODD * (k + 1).astype(U)), edge)
    total ^= size.astype(U) * RIGHT
    return mix64(total)


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of a followed by b."""
    h = a * LEFT
    h += b * RIGHT
    h ^= h >> U(32)
    h *= JOINED
    h ^= h >> U(29)
    return h


def runs(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive hashes, by doubling."""
    if len(hashes) < width:
        return np.empty(0, U)
    out, covered, power = None, 0, 1
    while True:
        if width & power:
            out = hashes if out is None else joined(out[: len(hashes) - covered], hashes[covered:])
            covered += power
        if covered == width:
            return out
        hashes = joined(hashes[:-power], hashes[power:])
        power *= 2


def window_hashes(hashes: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Every window of ``width`` words inside one text: index of its first word, and its hash."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.int64), np.empty(0, U)
    last = np.repeat(firsts[1:], np.diff(firsts))
    at = np.flatnonzero(np.arange(width, n + width) <= last)
    return at, runs(hashes, width)[at]


def text_hashes(hashes: np.ndarray, firsts: np.ndarray, salt: int) -> np.ndarray:
    """A hash of all words of each text, in order, and their number."""
    size = np.diff(firsts)
    place = np.arange(len(hashes)) - np.repeat(firsts[:-1], size)
    total = np.zeros(len(hashes) + 1, U)
    np.cumsum(mix64((hashes ^ U(salt)) + ODD * (place + 1).astype(U)), out=total[1:])
    return mix64((total[firsts[1:]] - total[firsts[:-1]]) ^ (size.astype(U) * RIGHT + U(salt)))


class Slots:
    """An open-addressing table of known words: 64-bit hash and a tag of length and outer bytes name a word's slot."""

    def __init__(self, size: int):
        """``size`` is a power of two; callers empty the table before more than half of it is ``held``."""
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.keys, self.tags, self.held = np.zeros(self.size, U), np.zeros(self.size, np.uint32), 0

    def _start(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U(20)).astype(np.int64) & (self.size - 1)

    def find(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Slot of each word, -1 where there is none.  No key is 0."""
        out = np.full(len(keys), -1, np.int64)
        todo, slot = np.arange(len(keys)), self._start(keys)
        while len(todo):
            there = self.keys[slot]
            same = (there == keys[todo]) & (self.tags[slot] == tags[todo])
            out[todo[same]] = slot[same]
            go = ~same & (there != 0)
            todo, slot = todo[go], (slot[go] + 1) & (self.size - 1)
        return out

    def put(self, keys: np.ndarray, tags: np.ndarray) -> np.ndarray:
        """Slots for distinct words that have none yet."""
        out = np.empty(len(keys), np.int64)
        todo, slot = np.arange(len(keys)), self._start(keys)
        while len(todo):
            free = np.flatnonzero(self.keys[slot] == 0)
            s, one = np.unique(slot[free], return_index=True)
            k = todo[free[one]]
            self.keys[s], self.tags[s], out[k] = keys[k], tags[k], s
            stay = np.ones(len(todo), bool)
            stay[free[one]] = False
            todo, slot = todo[stay], slot[stay]
            slot = np.where(self.keys[slot] != 0, (slot + 1) & (self.size - 1), slot)
        self.held += len(keys)
        return out


def named(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Key (never 0) and tag of each byte span, for ``Slots``."""
    keys = word_hashes(data, starts, ends)
    keys[keys == 0] = U(1)
    return keys, ((ends - starts).astype(np.uint32) << np.uint32(16)) ^ (data[starts].astype(np.uint32) << np.uint32(8)) ^ data[ends - 1]
