"""Document fingerprints from closed syncmers, with DataFrame functions only.

Symbols are words (runs without white space, cut after 16 characters, so that text without spaces has
symbols too).  A k-mer is 4 words, an s-mer 2; the k-mer is a closed syncmer if the least of its three
s-mer hashes is the first or the last one.  Whether a k-mer is chosen depends on its own words alone, so
equal passages choose equal anchors wherever they stand.  The fingerprint holds all anchors with their
places, about two thirds of the words', in order.  Likeness is over steps, an anchor with the next one and
the distance between them: the Jaccard likeness of the two texts' sets of steps, exact but for hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftgraph.llm.shared import fresh, partitions

K, S = 4, 2
SYMBOL = r"[^\x20\x09-\x0D]{1,16}"


def with_anchors(df: DataFrame, text: str, out: str, positions: bool = False) -> DataFrame:
    """Add ``out``: hashes of the closed syncmers of column ``text``, in order (null where not chosen).

    With ``positions`` every element keeps its place, so index i is the k-mer at word i.  Each step is a
    column of its own: lambdas then read a finished array instead of evaluating its expression again.
    """
    p, h = fresh(df.columns, f"p_{out}", f"h_{out}")
    df = df.withColumn(p, F.regexp_extract_all(F.col(text), F.lit(SYMBOL), F.lit(0)))
    df = df.withColumn(h, F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + 1))))
    # h[i] covers words i, i+1; its last element has no second word and only stands in dropped k-mers
    n = F.size(p) - (K - 1)
    middle, last = lambda i: F.get(h, i + 1), lambda i: F.get(h, i + 2)
    chosen = F.transform(h, lambda a, i: F.when((i < n) & (middle(i) >= F.least(a, last(i))), F.xxhash64(a, last(i))))
    df = df.withColumn(out, chosen if positions else F.array_compact(chosen))
    return df.drop(p, h)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``, array<struct<at int, anchor long>>: all anchors of ``text`` in order, ``at`` the place of their first symbol.

    A text without anchors (fewer than four words, or none chosen) has the hash of its whole as its only
    one, so equal texts have equal fingerprints and no fingerprint is empty.
    """
    anchors, held = fresh(df.columns, f"a_{out}", f"f_{out}")
    df = with_anchors(df, text, anchors, positions=True)
    df = df.withColumn(held, F.array_compact(F.transform(anchors, lambda x, i: F.when(x.isNotNull(), F.struct(i.alias("at"), x.alias("anchor"))))))
    whole = F.array(F.struct(F.lit(0).alias("at"), F.xxhash64(F.lit("whole"), F.col(text)).alias("anchor")))
    return df.withColumn(out, F.when(F.size(held) > 0, F.col(held)).otherwise(whole)).drop(anchors, held)


def with_steps(df: DataFrame, fingerprint: str, out: str) -> DataFrame:
    """Add ``out``: hashes of each anchor of a fingerprint with the next one and the distance; of a single anchor, its own."""
    following = lambda i: F.get(fingerprint, i + 1)
    steps = F.transform(fingerprint, lambda x, i: F.when(following(i).isNotNull(), F.xxhash64(x["anchor"], following(i)["anchor"], following(i)["at"] - x["at"])))
    return df.withColumn(out, F.when(F.size(fingerprint) > 1, F.array_compact(steps)).otherwise(F.transform(fingerprint, lambda x: F.xxhash64(x["anchor"]))))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard likeness of two texts' steps, 0 to 1."""
    return F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))


def as_text(fingerprint: Column | str) -> Column:
    """24 hexadecimal digits an anchor: 8 of its place, 16 of its hash."""
    digits = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    return F.array_join(F.transform(fingerprint, lambda x: F.concat(digits(x["at"], 8), digits(x["anchor"], 16))), "")


def not_above(cuts: list[int], value: Column) -> Column:
    """How many of the ascending ``cuts`` are not above ``value``, by binary search."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    held = F.array(*[F.lit(x).cast("long") for x in cuts])
    known = lambda at, step: F.get(held, at + step - 1) <= value
    return F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: at + F.when(known(at, step), step).otherwise(0))


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` with ``next_text`` of the next row in descending doc_id (after the last: the first).

    Rows are dealt by ranges of doc_id of about equal numbers of rows, whatever the ids; the last row of every range also goes to the range above it, so
    no order over the whole table is needed.  Null doc_id counts as below all others, rows of equal
    doc_id follow by text.
    """
    n = 4 * partitions(docs.sparkSession)
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)], max(10_000, 100 * n))).first()[0] or []
    place = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(not_above(sorted(set(cuts)), F.col("doc_id").cast("long")))
    rows = docs.select(place.alias("__range"), F.lit(1).alias("__own"), "doc_id", "text")
    # at most one row per range: a size fixed by the number of partitions, so it may be broadcast
    tops = rows.groupBy("__range").agg(F.max("doc_id").alias("top"))
    order = W.orderBy("__range")
    ends = tops.select(
        F.col("__range").alias("to"),
        F.coalesce(F.lag("__range").over(order), F.last("__range").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("from"),
        F.when(F.lag("__range").over(order).isNotNull(), F.lag("top").over(order)).otherwise(F.last("top").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("id"),
    )
    lasts = rows.join(F.broadcast(ends), (F.col("__range") == F.col("from")) & F.col("doc_id").eqNullSafe(F.col("id")))
    lasts = lasts.groupBy("to").agg(F.max("text").alias("text"), F.max("doc_id").alias("doc_id"))
    rows = rows.unionByName(lasts.select(F.col("to").alias("__range"), F.lit(0).alias("__own"), "doc_id", "text"))
    w = W.partitionBy("__range").orderBy("__own", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.select("*", F.lag("text").over(w).alias("next_text"))
    return rows.where("__own = 1").drop("__own", "__range")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and their likenesses.

    The edited text replaces the last floor(n_chars / 2) code points by the first as many of the next
    document.  Fingerprints are written as ``as_text`` does.  Null text is empty; an empty table gives no rows; a
    single row is its own next; rows of equal doc_id follow by text, repeated ones each have their own row;
    other columns are ignored.  A row's three texts and their symbols, some 100 bytes a word, are in memory at once.
    """
    rows = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", "n_chars", "text", "next_text", "edited")
    # a fingerprint is larger than its text, so the next row's is made again instead of being carried along
    for text, fp, steps in (("text", "fp", "steps"), ("edited", "edited_fp", "edited_steps"), ("next_text", "next_fp", "next_steps")):
        rows = with_steps(with_fingerprint(rows, text, fp), fp, steps)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("steps", "edited_steps").alias("near_edited"),
        likeness("steps", "next_steps").alias("near_next"),
    )
