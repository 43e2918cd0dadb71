"""Removal of passages that repeat across documents: fixed-block anchors, rolling probes, exact extension.

Every document of at least WINDOW words is cut into non-overlapping reference blocks of WINDOW // 2 words.
Any WINDOW words hold a whole block of each document they stand in, so two documents that share a window
meet when every rolling window of a block's length is probed against the blocks.

1. Probes are dealt by the leading bits of their hash.  A probe costs a few bytes on the way (the next 24
   bits, its position as a difference, its document once a batch); what comes back are the positions
   whose block stands in a document with another, matching order.  This only nominates.
2. Around the hits each document extends: all full windows that hold a hit are hashed (96 bits) and
   dealt by hash; the least doc_id of each window decides, which also joins overlapping windows into
   maximal repeats.
3. Covered words are removed in the documents that had hits; all others keep every word.

No step emits pairs, so a passage that stands in a third of all documents costs a few bytes for each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import in_arrow, partitions, written
from weftgraph.llm.words import U, buffers, chunks, mix64, runs, spans, window_hashes, word_hashes

WINDOW = 50
#: Doc ids of at most this many documents with hits are broadcast; beyond it the join shuffles.
BROADCAST_IDS = 1_000_000
#: Stands for a null doc_id: below all others.
NULL_ID = -(1 << 63)
#: Windows around hits that one task sorts at a time; a few per cent of the probes ever come so far.
BUCKET_WINDOWS = 2_000_000
SECOND = 0xD6E8FEB86659FD93
DEALT = "bucket int, docs binary, keys binary, firsts binary, places binary, rest binary, more binary"
OUT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
BATCH = 1 << 16


def planes(values: np.ndarray) -> bytes:
    """Fixed-width numbers byte plane by byte plane: differences are mostly zero bytes, which compress away."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes()


def unplanes(raw: bytes, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).reshape(-1).view(kind)


def _deltas(values: np.ndarray, kind: str) -> bytes:
    return planes(np.diff(values, prepend=values.dtype.type(0)).astype(kind))


def _deal(buckets: np.ndarray, docs: np.ndarray, keys: np.ndarray | None, firsts: np.ndarray, at: np.ndarray, rest: list[np.ndarray], widths: list[int]) -> Iterator[tuple]:
    """One row for each bucket that occurs: the batch's documents, and its entries in order of position."""
    order = np.argsort(buckets, kind="stable")
    buckets = buckets[order]
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1]])) if len(buckets) else np.empty(0, np.int64)
    ends = np.append(edges[1:], len(buckets))
    doc_raw, key_raw, first_raw = _deltas(docs, "<i8"), None if keys is None else planes(keys.astype("<i8")), _deltas(firsts.astype(np.int64), "<u4")
    at, rest = at[order], [r[order] for r in rest]
    for a, b in zip(edges.tolist(), ends.tolist(), strict=True):
        cut = [np.ascontiguousarray(r[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes() for r, w in zip(rest, widths, strict=True)]
        yield int(buckets[a]), doc_raw, key_raw, first_raw, _deltas(at[a:b], "<u4"), *cut, *[None] * (2 - len(cut))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), *[pa.binary()] * 6]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=["bucket", "docs", "keys", "firsts", "places", "rest", "more"])


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)


def _widen(raw: bytes, width: int) -> np.ndarray:
    got = np.frombuffer(raw, np.uint8).reshape(width, -1)
    out = np.zeros((got.shape[1], 8), np.uint8)
    out[:, :width] = got.T
    return out.reshape(-1).view("<u8")


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """One of n buckets by the leading 32 bits of a hash."""
    bucket = ((h >> U(32)) * U(n)) >> U(32)
    return bucket.astype(np.uint16 if n <= 1 << 16 else np.uint32)


def _probes(block: int, window: int, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            starts, ends, firsts = spans(data, offsets)
            at, h = window_hashes(word_hashes(data, starts, ends), firsts, block)
            long = np.repeat(np.diff(firsts) >= window, np.diff(firsts))[at]
            at, h = at[long], h[long]
            if not len(at):
                continue
            yield _rows(list(_deal(_bucket(h, n), _ids(batch), None, firsts, at, [h & U(0xFFFFFF)], [3])))

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one bucket at a time, from rows sorted by bucket."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and rows:
                yield now, rows
                rows = []
            now = row["bucket"]
            rows.append(row)
    if rows:
        yield now, rows


def _entries(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray, np.ndarray | None]:
    """doc, position in the document, key, first and second hash part of all entries of a bucket."""
    docs, places, keys, rest, more = [], [], [], [], []
    for r in rows:
        ids = np.cumsum(unplanes(r["docs"], "<i8"))
        firsts = np.cumsum(unplanes(r["firsts"], "<u4"), dtype=np.int64)
        at = np.cumsum(unplanes(r["places"], "<u4"), dtype=np.int64)
        d = np.searchsorted(firsts, at, "right") - 1
        docs.append(ids[d])
        places.append(at - firsts[d])
        if r["keys"] is not None:
            keys.append(unplanes(r["keys"], "<i8")[d])
        width = len(r["rest"]) // len(at)
        rest.append(_widen(r["rest"], width))
        if r["more"] is not None:
            more.append(_widen(r["more"], 4))
    join = lambda x: np.concatenate(x) if x else None
    return join(docs), join(places), join(keys), join(rest), join(more)


def _hits(block: int):
    """Positions of probes whose block also stands in a lesser document, and of blocks that a greater one probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            docs, places, _, rest, _ = _entries(rows)
            anchor = places % block == 0
            known = np.zeros(1 << 24, bool)
            known[rest[anchor]] = True
            some = np.flatnonzero(known[rest])
            some = some[np.argsort(rest[some], kind="stable")]
            r, d, p, a = rest[some], docs[some], places[some], anchor[some]
            edge = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.empty(0, np.int64)
            if not len(edge):
                continue
            group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(r))))
            least = np.minimum.reduceat(np.where(a, d, np.iinfo(np.int64).max), edge)[group]
            most = np.maximum.reduceat(d, edge)[group]
            hit = (least < d) | (a & (most > d))
            d, p = d[hit], p[hit]
            for i in range(0, len(d), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(d[i : i + BATCH]), pa.array(p[i : i + BATCH].astype(np.int32))], names=["id", "place"])

    return run


def _second(hashes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """32 more bits of a window's hash, over another mixing of its words."""
    return runs(mix64(hashes ^ U(SECOND)), width)[at] >> U(32)


def _windows(block: int, window: int, n: int):
    """All windows that hold a hit, dealt by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            starts, ends, firsts = spans(data, offsets)
            hashes = word_hashes(data, starts, ends)
            at, h = window_hashes(hashes, firsts, window)
            lists = batch.column("places")
            size = np.diff(lists.offsets.to_numpy())
            where = lists.flatten().to_numpy(zero_copy_only=False) + np.repeat(firsts[:-1], size)
            where = where[where < np.repeat(firsts[1:], size)]
            near = np.zeros(len(hashes) + block + 2, np.int32)
            np.add.at(near, np.maximum(where - (window - block), 0), 1)
            np.add.at(near, where + 1, -1)
            good = np.cumsum(near)[at] > 0
            at, h = at[good], h[good]
            if len(at):
                yield _rows(list(_deal(_bucket(h, n), _ids(batch), batch.column("key").to_numpy(), firsts, at, [h, _second(hashes, at, window)], [8, 4])))

    return run


def _later(n: int):
    """Of each window's occurrences those in a document beyond the least one, packed by the document's bin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _buckets(batches):
            docs, places, keys, h, more = _entries(rows)
            order = np.lexsort((more, h))
            h, more = h[order], more[order]
            edge = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (more[1:] != more[:-1])]))
            sizes = np.diff(np.append(edge, len(h)))
            least = np.empty(len(h), np.int64)
            least[order] = np.repeat(np.minimum.reduceat(docs[order], edge), sizes)
            late = np.flatnonzero(docs > least)
            if not len(late):
                continue
            d, k, p = docs[late], keys[late], places[late].astype("<u4")
            bins = _bucket(mix64(d.astype(U) ^ mix64(k.astype(U))), n)
            order = np.argsort(bins, kind="stable")
            bins, d, k, p = bins[order], d[order], k[order], p[order]
            cut = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
            to = np.append(cut[1:], len(bins))
            pack = lambda x: pa.array([planes(x[i:j]) for i, j in zip(cut.tolist(), to.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(bins[cut].astype(np.int32)), pack(d), pack(k), pack(p)], names=["bucket", "docs", "keys", "places"])

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document of a bin: the starts of its covered windows."""
    for _, rows in _buckets(batches):
        d, k, p = (np.concatenate([unplanes(r[c], kind) for r in rows]) for c, kind in (("docs", "<i8"), ("keys", "<i8"), ("places", "<u4")))
        order = np.lexsort((p, k, d))
        d, k, p = d[order], k[order], p[order]
        cut = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (k[1:] != k[:-1])]))
        to = np.append(cut[1:], len(d))
        for i in range(0, len(cut), BATCH):
            a, b = cut[i : i + BATCH], to[i : i + BATCH]
            raw = pa.array([p[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(d[a]), pa.array(k[a]), raw], names=["id", "key", "starts"])


def _cut(window: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            rows = []
            column = batch.column("starts") if "starts" in batch.schema.names else None
            data, offsets = buffers(batch.column("text"))
            raw = data.tobytes()
            for i, (doc, a, b) in enumerate(zip(batch.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                words = raw[a:b].split()
                kept = words
                starts = column[i].as_py() if column is not None else None
                if starts:
                    at = np.frombuffer(starts, "<u4").astype(np.int64)
                    step = np.bincount(at, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(at + window, minlength=len(words) + 1)[: len(words) + 1]
                    kept = [words[j] for j in np.flatnonzero(np.cumsum(step)[: len(words)] == 0).tolist()]
                left = b" ".join(kept)
                rows.append((doc, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if texts else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: word counts, and the words left after removing repeated windows.

    Words are runs without ASCII white space.  A window is ``window`` consecutive words; all its words go
    if the same words also stand in a document with a smaller doc_id.  Null text has no words; texts
    shorter than a window keep all; null doc_id counts as below all others; rows of equal doc_id do not
    affect each other; repeated rows give repeated results; other columns are ignored.  ``kept`` is null
    unless ``texts``.
    """
    spark = docs.sparkSession
    n, block = partitions(spark), window // 2
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    probes = in_arrow(docs, _probes(block, window, n), DEALT)
    hits = in_arrow(probes.repartitionById(n, "bucket").sortWithinPartitions("bucket"), _hits(block), "id long, place int")
    hits = written(hits.groupBy("id").agg(F.sort_array(F.collect_set("place")).alias("places")), "repeat-hits")
    few = hits.count() <= BROADCAST_IDS
    ids = F.broadcast(hits.select("id")) if few else hits.select("id")
    same = F.coalesce("doc_id", F.lit(NULL_ID)) == F.col("id")
    near = docs.join(ids, same, "left_semi").join(hits, same).select("doc_id", "text", F.xxhash64("text").alias("key"), "places")
    near = written(near, "repeat-texts")
    # a hit is in at most so many windows; a bucket for every BUCKET_WINDOWS of them
    bound = near.agg(F.sum(F.size("places"))).first()[0] or 0
    deals = bound * (window - block + 1) // BUCKET_WINDOWS + 1
    dealt = in_arrow(near, _windows(block, window, deals), DEALT)
    late = in_arrow(dealt.repartitionById(deals, F.col("bucket")).sortWithinPartitions("bucket"), _later(n), "bucket int, docs binary, keys binary, places binary")
    late = in_arrow(late.repartitionById(n, F.col("bucket")).sortWithinPartitions("bucket"), _gather, "id long, key long, starts binary")
    late = late.withColumnRenamed("key", "k")
    found = near.drop("places").join(late, same & (F.col("key") == F.col("k")), "left").select("doc_id", "text", "starts")
    rest = docs.join(ids, same, "left_anti")
    return in_arrow(found, _cut(window, texts), OUT).unionByName(in_arrow(rest, _cut(window, texts), OUT))
