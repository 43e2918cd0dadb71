"""Near-duplicate detection: ProbMinHash sketches, banding, exact verification, classes.

A document's shingles are its runs of five words, weighted by 1 + log2(occurrences).  ProbMinHash lets
every shingle arrive at the times of a Poisson process of its weight's rate, each arrival at a random
register; a register keeps its first arrival, and a shingle stops when its next arrival is later than
all registers'.  Two registers agree with the probability Jaccard likeness of the weighted sets (for
equal weights: the Jaccard likeness).  All documents of a batch run their rounds together in numpy.
Links are defined on sets, so every document has bands over equal weights; one with repeated shingles also
has those over its weights, in the same buckets.

Documents of equal words are one node.  Nodes that share a band are candidates, but a bucket's pairs are
never listed: its least node is compared with every other one, verified links are joined to classes, and
then those outside the bucket's largest class are compared with all its members.  So a bucket of near
copies costs little more than one comparison each, and no link between classes is lost to a cap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.components import components
from weftgraph.llm.shared import fresh, in_arrow, join_spread, partitions, written
from weftgraph.llm.words import ODD, U, buffers, chunks, mix64, runs, spans, text_hashes, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: 24 bands of 5 registers over equal weights miss a pair of likeness 0.8 with probability 7e-5.
BANDS, ROWS = 24, 5
BROADCAST_IDS = 1_000_000
#: A node of more rows, all copies of one text, is joined back to them without being gathered in one task.
COPIES = 1000
#: Members compared with one copy of a bucket's centre before it is sent to another task too.
SALT_ROWS = 128
#: Members outside a bucket's main class that one task holds.
BLOCK = 512
SECOND = 0xD6E8FEB86659FD93


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document index and hash of every shingle, and a 16-byte key of each document's words.

    A document of fewer words than ``width`` has one shingle, all its words; one without words has none.
    """
    starts, ends, firsts = spans(data, offsets)
    h = word_hashes(data, starts, ends)
    keys = np.stack([text_hashes(h, firsts, 1), text_hashes(h, firsts, SECOND)], 1)
    size = np.diff(firsts)
    doc = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(np.arange(width, len(h) + width) <= firsts[1:][doc])
    short = np.flatnonzero((size > 0) & (size < width))
    if not len(short):
        return doc[at], runs(h, width)[at], keys
    doc, found = np.concatenate([doc[at], short]), np.concatenate([runs(h, width)[at], keys[short, 0]])
    order = np.argsort(doc, kind="stable")
    return doc[order], found[order], keys


def prob_min_hash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """Sketches (n_docs, registers): the element that arrives first at each register."""
    first = np.full(n_docs * registers, np.inf)
    sketch = np.zeros(n_docs * registers, U)
    seed = mix64(element ^ U(0xA5A5F00DBEEF1234))
    time = np.zeros(len(element))
    step = 0
    while len(doc):
        step += 1
        r = mix64(seed + U(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        time = time - np.log(((r >> U(11)) + U(1)).astype(np.float64) * 2.0**-53) / weight
        slot = doc * registers + (((mix64(r ^ U(SECOND)) >> U(32)) * U(registers)) >> U(32)).astype(np.int64)
        better = time < first[slot]
        s, t, e = slot[better], time[better], element[better]
        np.minimum.at(first, s, t)
        won = t == first[s]
        sketch[s[won]] = e[won]
        latest = first.reshape(n_docs, registers).max(1)
        go = time < latest[doc]
        doc, element, weight, seed, time = doc[go], element[go], weight[go], seed[go], time[go]
    return sketch.reshape(n_docs, registers)


def weighted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) with weight; 40 bits of a shingle's hash name it within its batch."""
    packed = np.sort((doc.astype(U) << U(40)) | (shingle >> U(24)))
    edge = np.flatnonzero(np.concatenate([[True], packed[1:] != packed[:-1]])) if len(packed) else np.empty(0, np.int64)
    count = np.diff(np.append(edge, len(packed)))
    packed = packed[edge]
    return (packed >> U(40)).astype(np.int64), packed & U((1 << 40) - 1), 1 + np.log2(np.maximum(count, 1))


def _sketches(width: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix64(np.arange(1, bands + 1, dtype=U))

        def named(sketch: np.ndarray) -> np.ndarray:
            sketch = sketch.reshape(len(sketch), bands, rows)
            band = np.zeros((len(sketch), bands), U) + salt
            for i in range(rows):
                band = mix64(band * ODD + sketch[:, :, i])
            return band

        for batch in chunks(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            doc, shingle, keys = shingles(data, offsets, width)
            n = batch.num_rows
            doc, element, weight = weighted(doc, shingle)
            band = named(prob_min_hash(doc, element, np.ones(len(doc)), n, bands * rows))
            some = np.unique(doc)
            # without repeats the weighted sketch is the same one
            repeats = np.unique(doc[weight > 1])
            its = np.isin(doc, repeats)
            more = named(prob_min_hash(np.searchsorted(repeats, doc[its]), element[its], weight[its], len(repeats), bands * rows))
            new = more != band[repeats]
            owner = np.concatenate([np.repeat(some, bands), np.repeat(repeats, new.sum(1))])
            held = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=n))]).astype(np.int32)
            flat = np.concatenate([band[some].reshape(-1), more[new]])[np.argsort(owner, kind="stable")]
            lists = pa.ListArray.from_arrays(pa.array(held), pa.array(flat.view(np.int64)))
            names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), n, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), names, lists], names=["doc_id", "row", "node", "bands"])

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            data, offsets = buffers(batch.column("text"))
            doc, shingle, keys = shingles(data, offsets, width)
            packed = np.unique((doc.astype(U) << U(32)) | (shingle >> U(32)))
            first = np.searchsorted(packed >> U(32), np.arange(batch.num_rows + 1))
            values = (packed & U(0xFFFFFFFF)).astype("<u4")
            raw = pa.array([values[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
            names = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), batch.num_rows, [None, pa.py_buffer(keys.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([names, raw], names=["node", "set"])

    return run


def _verified(similarity: float):
    """Links of a centre (``own`` false, first of its group) to the members that follow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, mine = None, np.empty(0, np.uint32)
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in ("centre", "salt", "member", "node")]
            sets = batch.column("set")
            for i, (centre, salt, member, node) in enumerate(zip(*columns, strict=True)):
                its = np.frombuffer(sets[i].as_buffer(), "<u4")
                if not member:
                    group, mine = (centre, salt), its
                elif (centre, salt) == group and min(len(its), len(mine)) >= similarity * max(len(its), len(mine)):
                    common = len(its) + len(mine) - len(np.unique(np.concatenate([its, mine])))
                    if common >= similarity * (len(its) + len(mine) - common) - 1e-9:
                        out.append((node, centre))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` whose shingle sets (32-bit hashes) have a Jaccard likeness of at least ``similarity``.

    Members go to their centre b; a centre with many members is copied to several tasks, each with some
    of them, and a task holds one centre's set and the batch at hand.
    """
    n = partitions(pairs.sparkSession)
    salts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SALT_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(salts, "b").select("a", F.col("b").alias("centre"), F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = sets.join(dealt, sets.node == dealt.a).select("centre", "salt", F.lit(True).alias("member"), "node", "set")
    copies = salts.select(F.col("b").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    centres = sets.join(copies, sets.node == copies.centre).select("centre", "salt", F.lit(False).alias("member"), "node", "set")
    rows = centres.unionByName(members).repartition(n, "centre", "salt").sortWithinPartitions("centre", "salt", "member")
    return in_arrow(rows, _verified(similarity), "a binary, b binary")


def _exact(similarity: float):
    """Links between classes inside a bucket: every member against a block of members outside its main class.

    A group's first rows (``other`` false) are the block, at most a few times BLOCK sets; the bucket's
    members then stream past.  Only links that join two classes for the first time are put out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: tuple | None = None
        nodes: list[bytes] = []
        labels: list[bytes] = []
        held: list[np.ndarray] = []
        ready = False
        joined: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while (y := joined.get(x, x)) != x:
                joined[x] = joined.get(y, y)
                x = y
            return x

        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            columns = [batch.column(c).to_pylist() for c in ("bucket", "block", "other", "node", "label")]
            sets = batch.column("set")
            for i, (bucket, block, other, node, label) in enumerate(zip(*columns, strict=True)):
                if (bucket, block) != group:
                    group, nodes, labels, held, joined, ready = (bucket, block), [], [], [], {}, False
                its = np.frombuffer(sets[i].as_buffer(), "<u4")
                if not other:
                    nodes.append(node)
                    labels.append(label)
                    held.append(its)
                    continue
                if not ready:
                    sizes = np.array([len(x) for x in held], np.int64)
                    flat = np.concatenate(held) if held else np.empty(0, np.uint32)
                    order = np.argsort(flat, kind="stable")
                    flat, owner, ready = flat[order], np.repeat(np.arange(len(held)), sizes)[order], True
                low, high = np.searchsorted(flat, its, "left"), np.searchsorted(flat, its, "right")
                n = high - low
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
                common = np.bincount(owner[at], minlength=len(nodes))
                for j in np.flatnonzero(common >= similarity * (sizes + len(its) - common) - 1e-9).tolist():
                    x, y = root(label), root(labels[j])
                    if x != y:
                        joined[x] = y
                        out.append((node, nodes[j]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*out, strict=True)], names=["a", "b"])

    return run


def between_classes(buckets: DataFrame, labels: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` between different classes of one bucket, after the centres' links made the classes.

    Of any two members in different classes at least one is outside the bucket's largest class, so
    comparing those with all members misses nothing.  They go in blocks of BLOCK, the members past each
    block, so a bucket of any size is compared in tasks of bounded memory, and no pair becomes a row.
    """
    n = partitions(buckets.sparkSession)
    held = buckets.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    sizes = held.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("n"))
    open_ = sizes.groupBy("bucket").agg(F.max_by("label", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    open_ = open_.withColumn("blocks", F.ceil(F.col("others") / BLOCK).cast("int"))
    held = held.join(open_, "bucket")
    block = held.where("label <> main").select("bucket", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), F.lit(False).alias("other"), "node", "label")
    past = held.select("bucket", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("other"), "node", "label")
    rows = block.unionByName(past).join(sets, "node")
    rows = rows.repartition(n, "bucket", "block").sortWithinPartitions("bucket", "block", "other")
    return in_arrow(rows.select("bucket", "block", "other", "node", "label", "set"), _exact(similarity), "a binary, b binary")


def classes(docs: DataFrame, width: int = SHINGLE, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: ``doc_id, row, class_id, keep``.

    Two documents are linked if the Jaccard likeness of their sets of ``width``-word shingles is at least
    ``similarity``; classes are the connected components, ``class_id`` the least doc_id in the class (null
    only if all are null), ``row`` a hash of the text, and ``keep`` marks the row of the least doc_id, of
    several such the one of the least ``row`` (repeated rows are all marked).  Null text is empty; documents without words are copies of
    each other; shorter ones than a shingle are one shingle.  Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    texts = docs.withColumn("row", F.xxhash64("text"))
    all_ = written(in_arrow(texts, _sketches(width, bands, rows), "doc_id long, row long, node binary, bands array<long>"), "dup-bands")
    known = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    nodes = all_.groupBy("node").agg(F.min(known).alias("first"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("doc_id", F.col("first.doc_id")), "dup-nodes")
    places = nodes.select("node", "doc_id", F.explode("bands").alias("bucket"))
    shared = places.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).where("n > 1").select("bucket", "centre")
    buckets = written(places.join(shared, "bucket"), "dup-buckets")
    near = buckets.select("node", "doc_id").distinct()
    ids = near.select("doc_id").distinct()
    texts = docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, docs.doc_id.eqNullSafe(ids.doc_id), "left_semi")
    sets = in_arrow(texts, _sets(width), "node binary, set binary").dropDuplicates(["node"])
    sets = written(sets.join(near.select("node").distinct(), "node", "left_semi"), "dup-sets")
    buckets = buckets.drop("doc_id")

    pairs = buckets.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct()
    links = written(verify(pairs, sets, similarity), "dup-links")
    labels = components(links)
    more = written(between_classes(buckets, labels, sets, similarity), "dup-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    # classes are told by node, of which there is one for all copies of a text; only then rows get theirs
    held = nodes.select("node", "first", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = labels.select("label").distinct().join(held, "label").groupBy("label").agg(F.min("first").alias("least"))
    of_node = held.join(F.broadcast(least) if least.count() <= BROADCAST_IDS else least, "label", "left")
    of_node = written(of_node.select("node", "n", F.coalesce("least", "first").alias("least")), "dup-classes")
    rows = join_spread(all_.select("doc_id", "row", "node"), of_node.where(F.col("n") <= COPIES).select("node", "least"), "node", ["doc_id", "row"], of_node.where(F.col("n") > COPIES).select("node", "least"))
    keep = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("row") == F.col("least.row"))
    return rows.select("doc_id", "row", F.col("least.doc_id").alias("class_id"), keep.alias("keep"))


def without_duplicates(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: the least doc_id's; all columns stay.  Options are those of ``classes``."""
    found = written(classes(docs, **options), "dup-classes")
    id_, row = fresh(docs.columns, "id", "row")
    gone = found.where("not keep").select(F.col("doc_id").alias(id_), F.col("row").alias(row)).distinct()
    twice = found.where("keep").groupBy("doc_id", "row").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias(id_), F.col("row").alias(row))
    few = lambda t: F.broadcast(t) if t.count() <= BROADCAST_IDS else t
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(row))
    rows = docs.join(few(gone), same, "left_anti")
    if twice.isEmpty():
        return rows
    twice = few(twice)
    return rows.join(twice, same, "left_anti").unionByName(rows.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
