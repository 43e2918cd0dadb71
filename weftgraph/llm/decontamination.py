"""Benchmark decontamination by spaced-seed hashing.

A seed compares the words at fixed places of a short span and ignores those between, so a substituted
word spoils only the seeds that look at it.  The two masks hit every 13 words of which at most two
differ.  Benchmark items go through in blocks of bounded size; each block's seed hashes are a small table
that every task probes with the hashes at each word position of its documents.  A hit fixes the
alignment of item and document; it counts only if some WINDOW consecutive aligned words hold enough
equal ones.

Words are runs of ASCII letters, digits and non-ASCII characters; ASCII and Latin-1 capitals are lowered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import in_arrow
from weftgraph.llm.words import U, buffers, chunks, mix64, spans, word_hashes

WINDOW = 13
SIMILARITY = 0.8
MASKS = ((0, 2, 3, 4, 7, 8), (0, 1, 2, 5, 7, 8))
#: Items of fewer words must stand whole.
LEAST_WORDS = 9
#: A block of items ends after so many items, or so many characters.
BLOCK_ITEMS = 20_000
BLOCK_CHARS = 16 << 20
#: Seed hits, and alignments, that a task looks at at a time.
AT_ONCE, ALIGNMENTS = 1 << 20, 1 << 12
HITS = "doc_id long, item_id long, doc_word long, n_equal int, n_compared int"

IS_WORD = np.zeros(256, bool)
for _low, _high in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    IS_WORD[_low:_high] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z and the Latin-1 capitals (C3 80 to C3 9E, but for the sign C3 97) in lower case."""
    out = LOWER[data]
    if len(out) > 1:
        tail = out[1:]
        tail[(data[:-1] == 0xC3) & (tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] += 0x20
    return out


def normal_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all normalised words, and each text's first one (one more at the end)."""
    data, offsets = buffers(column)
    data = lowered(data)
    starts, ends, firsts = spans(data, offsets, IS_WORD)
    return word_hashes(data, starts, ends), firsts


def seeds(words: np.ndarray, firsts: np.ndarray, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of ``mask`` at every word from which it fits in its text."""
    span = mask[-1] + 1
    if len(words) < span:
        return np.empty(0, np.int64), np.empty(0, U)
    n = len(words) - span + 1
    h = np.zeros(n, U)
    for j, at in enumerate(mask):
        h += words[at : at + n] * U((0x9E3779B97F4A7C15 * (2 * j + 1)) & ((1 << 64) - 1) | 1)
    at = np.flatnonzero(np.arange(span, n + span) <= np.repeat(firsts[1:], np.diff(firsts))[:n])
    return at, mix64(h[at] ^ U(span * 0x51ED27 + sum(1 << x for x in mask)))


def needed(width: int, window: int, similarity: float) -> int:
    """Equal words that a window of ``width`` needs: an item shorter than LEAST_WORDS (and than ``window``) all of them."""
    return math.ceil(similarity * width) if width >= min(LEAST_WORDS, window) else width


def short_masks(width: int, bad: int) -> list[tuple[int, ...]]:
    """Masks over an item of ``width`` words of which one at least sees only equal words if ``bad`` differ.

    The words are cut in bad + 2 runs, of which two at least are untouched: each mask takes two.
    """
    if not bad:
        return [tuple(range(width))]
    if width < bad + 2:
        raise ValueError(f"of {width} words {bad} may differ, which leaves no two for a seed")
    cuts = [width * i // (bad + 2) for i in range(bad + 3)]
    return [tuple(x for i in two for x in range(cuts[i], cuts[i + 1])) for two in combinations(range(bad + 2), 2)]


def masks_of(window: int, bad: int) -> list[tuple[int, ...]] | tuple[tuple[int, ...], ...]:
    """MASKS, if they hit every ``window`` words of which ``bad`` differ, else masks made for these."""
    if math.comb(window, min(bad, window)) <= 10_000 and all(any(not {o + x for x in m} & set(gone) for m in MASKS for o in range(window - m[-1])) for gone in combinations(range(window), min(bad, window))):
        return MASKS
    return short_masks(window, bad)


@dataclass
class Index:
    """Seeds of one block of items.  Items of fewer words than ``window`` have masks of their own, from their first word."""

    ids: np.ndarray
    words: np.ndarray
    firsts: np.ndarray
    masks: list[tuple[int, ...]]
    hashes: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    window: int
    similarity: float

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None], window: int, similarity: float) -> Index:
        words, firsts = normal_words(pa.array(texts, pa.string()))
        size = np.diff(firsts)
        item = np.repeat(np.arange(len(ids)), size)
        short = sorted(set(size[(size > 0) & (size < window)].tolist()))
        widths = [(m, 0) for m in masks_of(window, window - needed(window, window, similarity))] + [(m, n) for n in short for m in short_masks(n, n - needed(n, window, similarity))]
        masks = [m for m, _ in widths]
        hashes, items, places = [], [], []
        for mask, width in widths:
            at, h = seeds(words, firsts, mask)
            fits = (size[item[at]] == width) & (at == firsts[item[at]]) if width else size[item[at]] >= window
            at, h = at[fits], h[fits]
            order = np.argsort(h, kind="stable")
            hashes.append(h[order])
            items.append(item[at][order])
            places.append((at - firsts[item[at]])[order])
        return cls(np.array(ids, np.int64), words, firsts, masks, hashes, items, places, window, similarity)

    def find(self, words: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(document, item, first document word, equal words, compared words): the best window of each pair.

        Seeds that many items or positions share are looked at AT_ONCE at a time.
        """
        doc_of = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        found = [np.empty((3, 0), np.int64)]
        for mask, known, items, places in zip(self.masks, self.hashes, self.items, self.places, strict=True):
            if not len(known):
                continue
            at, h = seeds(words, firsts, mask)
            bits = max(16, (16 * len(known)).bit_length())
            seen = np.zeros(1 << bits, bool)
            seen[known >> U(64 - bits)] = True
            some = seen[h >> U(64 - bits)]
            at, h = at[some], h[some]
            low, high = np.searchsorted(known, h, "left"), np.searchsorted(known, h, "right")
            for first, size in _spread(low, high - low):
                rows = np.repeat(at[first], size[first])
                entry = np.arange(len(rows)) - np.repeat(np.cumsum(size[first]) - size[first], size[first]) + np.repeat(low[first], size[first])
                doc = doc_of[rows]
                # the document word against which the item's first word stands
                found.append(np.unique(np.stack([doc, items[entry], rows - firsts[doc] - places[entry]]), axis=1))
        found = np.unique(np.concatenate(found, 1), axis=1)
        best: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
        for a in range(0, found.shape[1], ALIGNMENTS):
            for new in self._windows(words, firsts, *found[:, a : a + ALIGNMENTS]):
                old = best.get(new[:2])
                if old is None or (new[3], -new[2]) > (old[3], -old[2]):
                    best[new[:2]] = new
        return sorted(best.values())

    def _windows(self, words: np.ndarray, firsts: np.ndarray, doc: np.ndarray, item: np.ndarray, lag: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """The best window of each alignment that holds enough equal words, the earliest of equal ones."""
        size = np.diff(self.firsts)[item]
        low, high = np.maximum(0, -lag), np.minimum(size, np.diff(firsts)[doc] - lag)
        width = np.minimum(self.window, size)
        good = high - low >= width
        doc, item, lag, low, high, width = (x[good] for x in (doc, item, lag, low, high, width))
        if not len(doc):
            return
        need = np.array([needed(w, self.window, self.similarity) for w in range(self.window + 1)])[width]
        n = high - low
        edge = np.cumsum(n) - n
        inner = np.arange(n.sum()) - np.repeat(edge, n)
        at = np.repeat(low, n) + inner
        equal = self.words[np.repeat(self.firsts[item], n) + at] == words[np.repeat(firsts[doc] + lag, n) + at]
        seen = np.concatenate([[0], np.cumsum(equal)])
        wide = np.repeat(width, n)
        here = np.arange(len(inner))
        fits = inner + wide <= np.repeat(n, n)
        runs = np.where(fits, seen[np.minimum(here + wide, len(inner))] - seen[here], -1)
        # the most equal words first, then the earliest place
        rank = runs.astype(np.int64) * (1 << 32) + ((1 << 32) - 1 - inner)
        top = np.maximum.reduceat(rank, edge)
        most, place = top >> 32, (1 << 32) - 1 - (top & ((1 << 32) - 1))
        for k in np.flatnonzero(most >= need).tolist():
            yield int(doc[k]), int(item[k]), int(low[k] + lag[k] + place[k]), int(most[k]), int(width[k])


def _spread(low: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of the entries with any size in runs of about AT_ONCE in all; one larger than that is a run by itself."""
    some = np.flatnonzero(size)
    ends = np.cumsum(size[some])
    at = 0
    while at < len(some):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        yield some[at:to], size
        at = to


def blocks(benchmark: DataFrame) -> Iterator[tuple[list[int], list[str | None]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    ids: list[int] = []
    texts: list[str | None] = []
    chars = 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        if ids and (len(ids) >= BLOCK_ITEMS or chars + len(text) > BLOCK_CHARS):
            yield ids, texts
            ids, texts, chars = [], [], 0
        ids.append(-1 if item is None else item)
        texts.append(text)
        chars += len(text)
    if ids:
        yield ids, texts


def _indexes(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float) -> list:
    return [docs.sparkSession.sparkContext.broadcast(Index.of(*block, window, similarity)) for block in blocks(benchmark)]


def _hits(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in chunks(batches, "text"):
            rows = known.find(*normal_words(batch.column("text")))
            if rows:
                doc, item, at, equal, compared = (np.array(x) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(doc)), pa.array(known.ids[item]), pa.array(at), pa.array(equal, pa.int32()), pa.array(compared, pa.int32())],
                    names=["doc_id", "item_id", "doc_word", "n_equal", "n_compared"],
                )

    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs of a row of ``docs(doc_id, text)`` and a ``benchmark(item_id, text)`` item that overlap.

    ``n_equal`` of ``n_compared`` consecutive aligned words agree, from document word ``doc_word`` on: the
    best such window of the pair, the earliest of equal ones.  An item of at least ``window`` words needs a
    share of ``similarity`` in a window; a shorter one of LEAST_WORDS or more that share of its words, one
    shorter still must stand whole.  Null texts and items without words
    match nothing; repeated rows give repeated pairs; an empty benchmark gives no pairs; a null item_id
    is -1; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in _indexes(docs, benchmark, window, similarity):
        some = in_arrow(docs, _hits(index), HITS)
        out = some if out is None else out.unionByName(some)
    return out if out is not None else docs.sparkSession.createDataFrame([], HITS)


def _clean(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = index.value
        for batch in chunks(batches, "text"):
            keep = np.ones(batch.num_rows, bool)
            keep[[row[0] for row in known.find(*normal_words(batch.column("text")))]] = False
            yield batch.filter(pc.fill_null(pa.array(keep), True))

    return run


def without_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that overlap with any item; all columns and all other rows stay as they are."""
    for index in _indexes(docs, benchmark, window, similarity):
        docs = in_arrow(docs, _clean(index), docs.schema)
    return docs
