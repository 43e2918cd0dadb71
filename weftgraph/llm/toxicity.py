"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features are the character n-grams of each lowered word with a space on both sides, hashed to BUCKETS
slots; a document's value is the number of its distinct words that hold the n-gram.  The values' sums over
the training rows of either label, smoothed, give each n-gram's log-count ratio, which scales it, and an
L2-regularised logistic regression over all n-grams gives the weights.

Both steps use that a document's features are the sum of its words': the training rows are kept as lists of
distinct words, and every distinct word once as its list of slots, so no n-gram has to be left out for
memory.  For the same reason a word's score is the same wherever it stands: tasks keep the scores of words
they have met in a table and add up per document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.decontamination import lowered
from weftgraph.llm.labelled import TRAIN_ROWS, held_out, training_rows
from weftgraph.llm.shared import in_arrow, partitions, trim
from weftgraph.llm.words import ODD, U, Slots, buffers, chunks, mix64, named, spans

LENGTHS = (2, 3, 4, 5, 6)
BUCKETS = 1 << 19
SMOOTHING = 1.0
PENALTY = 2.0
#: The fit ends after so many steps, or when one lowers the mean loss by less than TOLERANCE.
STEPS, TOLERANCE = 60, 1e-5
REJECT = 0.5
#: Slots of a task's table of words with known scores; it starts anew when half full.
KNOWN = 1 << 20
#: Rows that the fit goes through at a time.
BLOCK_ROWS = 1000
#: Bytes of text whose n-grams a task holds at a time (a longer single text is held whole).
SLICE_BYTES = 1 << 20


@dataclass
class Words:
    """Distinct words of a batch's texts: ``doc`` and ``word`` (an index) of each pair; place, key and tag of each distinct word."""

    low: np.ndarray
    doc: np.ndarray
    word: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    keys: np.ndarray
    tags: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Words:
        data, offsets = buffers(column)
        low = lowered(data)
        starts, ends, firsts = spans(low, offsets)
        keys, tags = named(low, starts, ends)
        doc = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        pair = mix64(keys ^ (doc.astype(U) * ODD))
        order = np.argsort(pair)
        edge = np.ones(len(pair), bool)
        edge[1:] = pair[order[1:]] != pair[order[:-1]]
        # each pair's first place, in the texts' order, so that sums do not depend on the batch
        some = np.sort(np.minimum.reduceat(order, np.flatnonzero(edge))) if len(order) else order
        _, first, word = np.unique(keys[some], return_index=True, return_inverse=True)
        first = some[first]
        return cls(low, doc[some], word, starts[first], ends[first], keys[first], tags[first])

    def texts(self, some: np.ndarray) -> list[bytes]:
        raw = self.low.tobytes()
        return [raw[a:b] for a, b in zip(self.starts[some].tolist(), self.ends[some].tolist(), strict=True)]


def ngrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word and hashed slot of every n-gram of `` word ``, each once a word, in order."""
    # other white space inside a word stays a character; lowering never adds or removes a space
    said = b" ".join(words).decode("utf-8", "replace").lower()
    points = np.frombuffer(f" {said} ".encode("utf-32-le", "replace"), "<u4").astype(U)
    gap = points == U(0x20)
    word = np.cumsum(gap) - 1
    before = np.concatenate([[0], np.cumsum(gap)])
    found = []
    for n in LENGTHS:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.zeros(m, U)
        for j in range(n):
            h = h * U(0x100000001B3) + points[j : j + m] + U(1)
        # a space may only stand at either end
        inner = before[n - 1 : n - 1 + m] - before[1 : 1 + m]
        good = (inner == 0) & ~(gap[:m] & gap[n - 1 : n - 1 + m])
        found.append((word[:m][good] << 32) | (mix64(h[good] ^ U(n << 56)) % U(BUCKETS)).astype(np.int64))
    packed = np.sort(np.concatenate(found)) if found else np.empty(0, np.int64)
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])] if len(packed) else packed
    return packed >> 32, packed & 0xFFFFFFFF


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text", SLICE_BYTES):
        w = Words.of(batch.column("text"))
        sizes = np.bincount(w.doc, minlength=batch.num_rows)
        yield _packed(batch.column("id").to_numpy(), batch.column("y").to_numpy().astype(np.int64), sizes, w.keys[w.word])


def _packed(*arrays: np.ndarray) -> pa.RecordBatch:
    """A batch's arrays as one row of bytes each, so that the driver takes in a partition at a time."""
    return pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for x in arrays], names=[f"a{i}" for i in range(len(arrays))])


def _unpacked(df: DataFrame) -> Iterator[list[bytes]]:
    return (list(row) for row in df.toLocalIterator())


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = Slots(KNOWN)
    for batch in chunks(batches, "text", SLICE_BYTES):
        w = Words.of(batch.column("text"))
        if seen.held + len(w.keys) > KNOWN // 2:
            seen.clear()
        new = np.flatnonzero(seen.find(w.keys, w.tags) < 0)
        if len(new) <= KNOWN // 2:
            seen.put(w.keys[new], w.tags[new])
        if len(new):
            yield pa.RecordBatch.from_arrays([pa.array(w.keys[new].view(np.int64)), pa.array(w.texts(new), pa.binary())], names=["key", "word"])


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys, and for each run of 2 ** 16 slots how many each word has there, and which."""
    for batch in chunks(batches, "word", 1 << 18):
        at, slot = ngrams(batch.column("word").to_pylist())
        run = slot >> 16
        arrays = [batch.column("key").to_numpy()]
        for k in range(BUCKETS >> 16):
            mine = run == k
            arrays += [_small(np.bincount(at[mine], minlength=batch.num_rows)), (slot[mine] & 0xFFFF).astype(np.uint16)]
        yield _packed(*arrays)


def _small(sizes: np.ndarray) -> np.ndarray:
    return sizes.astype(np.uint8 if sizes.max(initial=0) < 256 else np.uint32)


class Lists:
    """Sums over lists of indices: ``up`` adds up each list's values, ``down`` spreads a value to each list's indices.

    A block holds a run of lists as parts, each with a first index, the lists' sizes, and their indices from
    the first one on.  Parts keep indices in 16 bits and their values in the processor's cache.
    """

    def __init__(self, n: int):
        self.n, self.held = n, 0
        self.blocks: list[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]]]] = []

    def add(self, n_lists: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.blocks.append((self.held, self.held + n_lists, parts))
        self.held += n_lists

    def up(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.held)
        for a, b, parts in self.blocks:
            for first, sizes, index in parts:
                ends = np.cumsum(sizes, dtype=np.int64)
                # one more item, as an empty list at the end has no place to begin at
                run = np.zeros(len(index) + 1)
                np.take(values[first:], index, out=run[:-1], mode="clip")
                sums = np.add.reduceat(run, ends - sizes)
                sums[sizes == 0] = 0
                out[a:b] += sums
        return out

    def down(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.n)
        for a, b, parts in self.blocks:
            for first, sizes, index in parts:
                found = np.bincount(index, np.repeat(values[a:b], sizes))
                out[first : first + len(found)] += found
        return out


def logistic(y: np.ndarray, docs: Lists, words: Lists, scale: np.ndarray, penalty: float = PENALTY, steps: int = STEPS, memory: int = 5) -> tuple[np.ndarray, float]:
    """Weights and bias of an L2-regularised logistic regression on the scaled sums of the words' lists, by limited-memory BFGS."""
    n = len(scale)
    theta = np.zeros(n + 1)
    theta[n] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        z = docs.up(words.up(t[:n] * scale)) + t[n]
        g = 1 / (1 + np.exp(-np.clip(z, -35, 35))) - y
        slope = np.empty(n + 1)
        slope[:n] = words.down(docs.down(g)) * scale + penalty * t[:n]
        slope[n] = g.sum()
        return float((np.logaddexp(0, z) - y * z).sum() + penalty / 2 * (t[:n] @ t[:n])), slope

    value, slope = loss(theta)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        way, kept = -slope, []
        for s, d, r in reversed(moves):
            a = r * (s @ way)
            kept.append(a)
            way -= a * d
        way *= 1 / (moves[-1][2] * (moves[-1][1] @ moves[-1][1])) if moves else 1 / max(1.0, np.linalg.norm(slope))
        for (s, d, r), a in zip(moves, reversed(kept), strict=True):
            way += (a - r * (d @ way)) * s
        rate, down = 1.0, slope @ way
        while True:
            new = theta + rate * way
            new_value, new_slope = loss(new)
            if new_value <= value + 1e-4 * rate * down or rate < 1e-6:
                break
            rate /= 2
        s, d = new - theta, new_slope - slope
        done = value - new_value < TOLERANCE * len(y)
        theta, value, slope = new, new_value, new_slope
        if done:
            break
        if s @ d > 1e-12:
            moves = [*moves[1 - memory :], (s, d, 1 / (s @ d))]
    return theta[:n], float(theta[n])


@dataclass
class Model:
    """``weights`` of all slots (ratio and regression weight multiplied) and the bias."""

    weights: np.ndarray
    bias: float
    table: tuple[Slots, np.ndarray] | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def of_words(self, w: Words) -> np.ndarray:
        """The distinct words' scores: those met before from the table, others by their n-grams."""
        if self.table is None or self.table[0].held + len(w.keys) > KNOWN // 2:
            self.table = Slots(KNOWN), np.zeros(KNOWN)
        known, scores = self.table
        slot = known.find(w.keys, w.tags)
        new = np.flatnonzero(slot < 0)
        out = scores[slot]
        if len(new):
            at, found = ngrams(w.texts(new))
            out[new] = np.bincount(at, self.weights[found], len(new))
            if len(new) <= KNOWN // 2:
                scores[known.put(w.keys[new], w.tags[new])] = out[new]
        return out

    def scores(self, column: pa.Array) -> np.ndarray:
        w = Words.of(column)
        total = np.bincount(w.doc, self.of_words(w)[w.word], len(column)) + self.bias
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", limit: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows outside the held-out fold.

    The driver receives eight bytes for each distinct word of each sampled row and, for each distinct word
    of the sample, its slots (at most BUCKETS).  All n-grams enter the fit.  Rows are put in order first, so
    the model does not depend on how they were dealt to tasks; repeated rows count as often as they stand.
    Without any labelled row, or with one label only, every document has the smoothed rate of toxic rows,
    (toxic + 1) / (rows + 3), so nothing is rejected where nothing was learnt.
    """
    rows = training_rows(docs, labels, label, limit)
    toxic, clean = rows.agg(F.sum((F.col("y") > 0).cast("long")), F.sum((F.col("y") <= 0).cast("long"))).first()
    if not toxic or not clean:
        toxic, clean = toxic or 0, clean or 0
        return Model(np.zeros(BUCKETS), float(np.log((toxic + 1) / (clean + 2))))
    keys, of_words = _word_lists(rows, partitions(docs.sparkSession))
    y, of_docs = _row_lists(rows, keys)
    del keys
    trim()
    toxic, all_ = (of_words.down(of_docs.down(x)) for x in (y, np.ones(len(y))))
    p, q = toxic + SMOOTHING, all_ - toxic + SMOOTHING
    ratio = np.where(all_ > 0, np.log(p / p.sum()) - np.log(q / q.sum()), 0)
    w, b = logistic(y, of_docs, of_words, ratio)
    del of_words, of_docs
    trim()
    return Model(w * ratio, b)


def _word_lists(rows: DataFrame, n: int) -> tuple[np.ndarray, Lists]:
    """Keys of all distinct words, and their slots."""
    known = in_arrow(rows, _words, "key long, word binary").groupBy("key").agg(F.first("word").alias("word"))
    runs = BUCKETS >> 16
    # partitions come in order and so do their rows, however many tasks made them
    known = in_arrow(known.repartition(n, "key").sortWithinPartitions("key"), _slots, ", ".join(f"a{i} binary" for i in range(2 * runs + 1)))
    keys, lists = [], Lists(BUCKETS)
    for raw in _unpacked(known):
        key = np.frombuffer(raw[0], np.int64)
        keys.append(key)
        sizes = [np.frombuffer(x, np.uint8 if len(x) == len(key) else np.uint32) for x in raw[1::2]]
        lists.add(len(key), [(k << 16, x, np.frombuffer(y, np.uint16)) for k, x, y in zip(range(runs), sizes, raw[2::2], strict=True)])
    return np.concatenate(keys), lists


def _row_lists(rows: DataFrame, keys: np.ndarray) -> tuple[np.ndarray, Lists]:
    """Labels and words (places in ``keys``) of all rows, by doc_id, those of one doc_id by label and words."""
    order = np.argsort(keys)
    keys = keys[order]
    ids, y, sizes, sums, words = [], [], [], [], []
    for raw in _unpacked(in_arrow(rows, _rows, "a0 binary, a1 binary, a2 binary, a3 binary")):
        id_, label, size, key = (np.frombuffer(x, np.int64) for x in raw)
        ids.append(id_)
        y.append(label)
        sizes.append(size)
        sums.append(np.diff(np.concatenate([[0], np.cumsum(key)])[np.concatenate([[0], np.cumsum(size)])]))
        words.append(order[np.searchsorted(keys, key)].astype(np.int32))
    ids, y, sizes, sums, words = (np.concatenate(x) for x in (ids, y, sizes, sums, words))
    rank = np.lexsort((sums, y, ids))
    edge = np.concatenate([[0], np.cumsum(sizes)])
    lists = Lists(len(keys))
    for a in range(0, len(rank), BLOCK_ROWS):
        some = rank[a : a + BLOCK_ROWS]
        lists.add(len(some), [(0, sizes[some], np.concatenate([words[edge[i] : edge[i + 1]] for i in some.tolist()]))])
    return (y[rank] > 0).astype(float), lists


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(batch.column("text")))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null and empty texts score the model's bias.

    Repeated rows give repeated results, a score of just ``threshold`` is predicted 1, a null doc_id counts as
    held out, other columns are ignored; a single text is held whole, some 46 times its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scores(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def _accepted(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", SLICE_BYTES):
            yield batch.filter(pa.array(model.value.scores(batch.column("text")) < threshold))

    return run


def without_toxic(docs: DataFrame, model: Model, threshold: float = REJECT) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all columns stay."""
    return in_arrow(docs, _accepted(docs.sparkSession.sparkContext.broadcast(model), threshold), docs.schema)
