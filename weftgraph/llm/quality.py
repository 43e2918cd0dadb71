"""Quality: a generalised additive model with pairwise interactions, fitted by cyclic boosting.

Features are shares and rates of a text's bytes, words and lines, computed for a whole batch in numpy.
Each is cut into bins at training quantiles.  Boosting goes round the features, each time adding a
shallow tree over one feature's bins to that feature's lookup table; then round the strongest pairs,
with trees over two features' coarse bins.  A document's score is the sum of the tables' entries at its
bins, so every table shows what its feature adds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.labelled import TRAIN_ROWS, held_out, training_rows
from weftgraph.llm.shared import in_arrow
from weftgraph.llm.words import buffers, chunks, spans, word_hashes

BINS = 32
PAIR_BINS = 8
PAIRS = 6
ROUNDS, PAIR_ROUNDS = 120, 60
RATE = 0.1
LEAST_ROWS = 5
RIDGE = 1.0
ACCEPT = 0.3

CLASSES = {"upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "space": (0x20, 0x09), "line": (0x0A, 0x0D), "stop": b".?,;:'\"-()", "mark": b"!#$%&*+/<=>@[\\]^_`{|}~", "high": range(0x80, 0x100)}
NAMES = [*CLASSES, "log_words", "word_bytes", "distinct", "short_words", "long_words", "top_word", "marked_words", "shouted_words", "line_words", "repeated_lines", "vowels", "repeated_bytes"]
_KIND = np.full(256, len(CLASSES), np.uint8)
for _k, _bytes in enumerate(CLASSES.values()):
    _KIND[list(_bytes)] = _k
_LINE = np.ones(256, bool)
_LINE[[0x0A, 0x0D]] = False
_VOWEL = np.zeros(256, bool)
_VOWEL[list(b"aeiouAEIOU")] = True


def features(column: pa.Array) -> np.ndarray:
    """One row of NAMES for each text; an empty text has zeros."""
    data, offsets = buffers(column)
    n = len(offsets) - 1
    doc_of_byte = np.repeat(np.arange(n), np.diff(offsets))
    size = np.maximum(np.diff(offsets), 1).astype(float)
    out = np.zeros((n, len(NAMES)))
    kinds = np.bincount(doc_of_byte * (len(CLASSES) + 1) + _KIND[data], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)
    out[:, : len(CLASSES)] = kinds[:, :-1] / size[:, None]
    starts, ends, firsts = spans(data, offsets)
    if not len(starts):
        return out
    hashes = word_hashes(data, starts, ends)
    count = np.diff(firsts)
    words = np.maximum(count, 1).astype(float)
    doc = np.repeat(np.arange(n), count)
    length = ends - starts
    share = lambda some: np.bincount(doc, some, n) / words
    packed = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
    edge = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]]))
    times = np.diff(np.append(edge, len(packed)))
    owner = (packed[edge] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(n)
    np.maximum.at(top, owner, times)
    seen = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    inside = lambda run: run[ends] - run[starts]
    kind = _KIND[data]
    upper, lower, mark = (inside(seen(kind == list(CLASSES).index(k))) for k in ("upper", "lower", "mark"))
    line_starts, line_ends, line_firsts = spans(data, offsets, _LINE)
    lines = np.diff(line_firsts)
    line_doc = np.repeat(np.arange(n), lines)
    line_packed = np.unique((line_doc.astype(np.uint64) << np.uint64(40)) | (word_hashes(data, line_starts, line_ends) >> np.uint64(24)))
    distinct_lines = np.bincount((line_packed >> np.uint64(40)).astype(np.int64), minlength=n)
    same = np.concatenate([[False], data[1:] == data[:-1]])
    rest = [
        np.log1p(count),
        share(length),
        np.bincount(owner, minlength=n) / words,
        share(length <= 3),
        share(length >= 12),
        top / words,
        share(mark > 0),
        share((upper > 1) & (lower == 0)),
        count / np.maximum(lines, 1),
        1 - distinct_lines / np.maximum(lines, 1),
        np.bincount(doc_of_byte, _VOWEL[data], n) / size,
        np.bincount(doc_of_byte, same, n) / size,
    ]
    out[:, len(CLASSES) :] = np.stack(rest, 1)
    out[count == 0, len(CLASSES) :] = 0
    return out


@dataclass
class Model:
    """Bin edges and lookup tables; ``pair_cuts`` maps a feature's fine bins to its coarse ones."""

    edges: list[np.ndarray] = field(default_factory=list)
    bias: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_cuts: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        if not self.tables:
            return total
        at = self.bins(x)
        for j, t in enumerate(self.tables):
            total += t[at[:, j]]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[self.pair_cuts[a][at[:, a]], self.pair_cuts[b][at[:, b]]]
        return total

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -35, 35)))


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A step function over ordered bins: the best cut, then the best one inside either side."""
    out = np.zeros(len(g))
    value = lambda a, b: g[a:b].sum() / (h[a:b].sum() + RIDGE)

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, a
        gs, hs, ns = np.cumsum(g[a:b]), np.cumsum(h[a:b]), np.cumsum(n[a:b])
        gain = gs[:-1] ** 2 / (hs[:-1] + RIDGE) + (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + RIDGE) - gs[-1] ** 2 / (hs[-1] + RIDGE)
        gain[(ns[:-1] < LEAST_ROWS) | (ns[-1] - ns[:-1] < LEAST_ROWS)] = 0
        k = int(gain.argmax())
        return float(gain[k]), a + k + 1

    parts = [(0, len(g))]
    while len(parts) < leaves:
        found = [(*best(a, b), a, b) for a, b in parts]
        gain, cut, a, b = max(found)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    if len(parts) > 1:
        for a, b in parts:
            out[a:b] = value(a, b)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of each axis of a two-way table into four quadrants."""
    total = lambda t: np.pad(t.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    gs, hs = total(g), total(h)
    i, j = np.arange(1, g.shape[0])[:, None], np.arange(1, g.shape[1])[None, :]
    area = lambda s: (s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j])
    gain = sum(a**2 / (b + RIDGE) for a, b in zip(area(gs), area(hs), strict=True)) - gs[-1, -1] ** 2 / (hs[-1, -1] + RIDGE)
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    a, b = k[0] + 1, k[1] + 1
    out = np.empty_like(g)
    for rows in (slice(0, a), slice(a, None)):
        for cols in (slice(0, b), slice(b, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + RIDGE)
    return float(gain[k]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Fit on rows ``x`` with labels ``y``; without both labels the model is the smoothed rate alone."""
    rate = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < len(y):
        return Model(bias=bias)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, BINS) / BINS)) for j in range(x.shape[1])]
    model = Model(edges, bias, [np.zeros(len(e) + 1) for e in edges])
    at = model.bins(x)
    total = np.full(len(y), bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
        return y - p, p * (1 - p)

    rows = [np.bincount(at[:, j], minlength=len(t)) for j, t in enumerate(model.tables)]
    for _ in range(ROUNDS):
        for j, t in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(at[:, j], g, len(t)), np.bincount(at[:, j], h, len(t)), rows[j])
            t += step
            total += step[at[:, j]]
    model.pair_cuts = [np.minimum(np.arange(len(t)) * PAIR_BINS // len(t), PAIR_BINS - 1) for t in model.tables]
    coarse = np.stack([c[at[:, j]] for j, c in enumerate(model.pair_cuts)], 1)
    g, h = slopes()
    cells = lambda a, b, v: np.bincount(coarse[:, a] * PAIR_BINS + coarse[:, b], v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    gains = sorted(((_quadrants(cells(a, b, g), cells(a, b, h))[0], a, b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:PAIRS]]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _quadrants(cells(a, b, g), cells(a, b, h))[1]
            t += step
            total += step[coarse[:, a], coarse[:, b]]
    return model


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "text"):
        x = features(batch.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([batch.column("y"), lists], names=["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``limit`` labelled rows outside the held-out fold; the driver receives their features only."""
    rows = in_arrow(training_rows(docs, labels, label, limit), _features, "y int, x array<double>").toArrow()
    y = (rows.column("y").to_numpy() > 0).astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), len(NAMES))
    # one order of rows whatever the tasks' order, so that sums come out the same
    order = np.lexsort(np.concatenate([x.T, y[None]]))
    return train(x[order], y[order])


def _scores(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.value.scores(features(batch.column("text"))))], names=["doc_id", "score"])

    return run


def scored(docs: DataFrame, model: Model, threshold: float = ACCEPT) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row; null text is empty, other columns are ignored.

    Repeated rows give repeated results, a score of just ``threshold`` is predicted 1, a null doc_id counts as
    held out; a single text is held whole, some 37 times its size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = in_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _scores(shared), "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
