"""Mixing sources to target weights by capped water-filling.

Targets are the limit of "give every source its share by weight, clamp what exceeds the cap, share the
excess again by weight": sources in ascending order of size / weight are clamped while their share of
what is left exceeds their cap, so one pass over the sorted sources replaces the repeated
redistribution.  All comparisons are on whole numbers (decimal(38,0)), so reruns agree to the word.

A document is then taken ``floor(target / source size)`` whole times, and the remainder of the target is
filled in the order of a seeded hash; the document at the quota's edge is taken in part.  The edge is
found without sorting a source: word counts are summed by hash prefix, a running sum over the prefixes
finds the one prefix in which the quota ends, which is divided again by a longer prefix, until few enough
documents are left to be sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from weftgraph.llm.shared import BROADCAST_ROWS, fresh, written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"
#: Characters of the hash by which a level of the search for a source's edge divides it, and those it has.
PREFIX_CHARS, KEY_CHARS = 3, 32
#: Rows of a source that are sorted by their whole hash.
EDGE_ROWS = 10_000
WORD = r"[^\x20\x09-\x0D]+"
_BIG = "decimal(38,0)"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sizes(source, source_size)`` with ``target`` (double) and ``quota`` (its whole words).

    Sources by code point, null last, take the weights in turn.  One row per source is sorted in one
    place; documents never are.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = sizes.select("source", "source_size", weight.cast(_BIG).alias("w"), F.col("source_size").cast(_BIG).alias("s"))
    whole = W.partitionBy(F.lit(1))
    fill = W.orderBy((F.col("s").cast("double") / F.col("w").cast("double")), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    s = s.select(
        "*",
        (F.sum("s").over(whole) - F.coalesce(F.sum("s").over(before), F.lit(0)) * cap).cast(_BIG).alias("left_words"),
        (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))).cast(_BIG).alias("left_weight"),
        F.row_number().over(fill).alias("at"),
    )
    s = s.withColumn("over", (F.col("left_words") * F.col("w")) > (F.col("s") * cap * F.col("left_weight")))
    # Clamped sources are a prefix of the order; the first one that isn't sets the level for all after it.
    first = F.min(F.when(~F.col("over"), F.col("at"))).over(whole)
    s = s.withColumn("level_at", first)
    level = lambda c: F.max(F.when(F.col("at") == F.col("level_at"), F.col(c))).over(whole)
    s = s.select("*", level("left_words").alias("lw"), level("left_weight").alias("lwt"))
    clamped = F.col("level_at").isNull() | (F.col("at") < F.col("level_at"))
    share = F.col("lw") * F.col("w")
    return s.select(
        "source",
        "source_size",
        F.when(clamped, (F.col("source_size") * cap).cast("double")).otherwise(share.cast("double") / F.col("lwt").cast("double")).alias("target"),
        F.when(clamped, F.col("source_size") * cap).otherwise(F.floor(share / F.col("lwt")).cast("long")).alias("quota"),
    )


def edges(slim: DataFrame, goal: DataFrame, names: Sequence[str], edge_rows: int = EDGE_ROWS) -> DataFrame:
    """For each source with words left to fill, where in the order of keys they end: ``source, cut, before, n``.

    Of ``slim`` (source, key, size in columns ``names``) rows whose key begins with less than ``cut`` are taken,
    ``before`` words in all, greater ones are not, and ``n`` rows begin with it.  A level sums the words by
    PREFIX_CHARS more characters of the key, for the rows of the last level's cut only, until no cut has more
    than ``edge_rows`` rows, so no source is ever sorted.  ``goal`` has ``source`` and ``rest``.
    """
    source, key, size = names
    at = goal.where("rest > 0").select("source", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("before"))
    for chars in range(PREFIX_CHARS, KEY_CHARS + PREFIX_CHARS, PREFIX_CHARS):
        last = at.select(F.col("source").alias("of"), "rest", "cut", F.col("before").alias("base"))
        last = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
        inside = slim.join(last, F.col(source).eqNullSafe(F.col("of")) & (F.substring(F.col(key), 1, chars - PREFIX_CHARS) == F.col("cut")))
        sums = inside.groupBy("of", "rest", "base", F.substring(F.col(key), 1, chars).alias("cut")).agg(F.sum(size).alias("sum"), F.count(F.lit(1)).alias("n"))
        running = W.partitionBy("of").orderBy("cut").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.col("base") + F.coalesce(F.sum("sum").over(running), F.lit(0)))
        sums = sums.where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("sum") >= F.col("rest")))
        at = written(sums.select(F.col("of").alias("source"), "rest", "cut", "before", "n"), "mix-edges")
        if (at.agg(F.max("n")).first()[0] or 0) <= edge_rows:
            break
    return at


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: str = SEED, edge_rows: int = EDGE_ROWS) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``: words of each row, of its source, and those the mix takes.

    Null text has size 0; null sources are one source, after all others; a source of size 0 gets target
    0; an empty table gives an empty result.  Rows with equal doc_id are separate rows and share a place
    in the seeded order (then by size).  Columns of ``docs`` named like a result column are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    key, of, goal_size, goal_target, whole, rest, cut, before, extra = fresh([*docs.columns, "size", "taken"], "key", "of", "goal_size", "goal_target", "whole", "rest", "cut", "before", "extra")
    md5 = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":" + seed)))
    # source, key and size are a few bytes a row: texts are read twice, and sorted nowhere but at the edge
    slim = written(docs.select(F.col("source").alias(of), md5.alias(key), n_words(F.col("text")).alias("size")), "mix-sizes")
    goal = targets(slim.groupBy(F.col(of).alias("source")).agg(F.sum("size").alias("source_size")), weights, cap)
    # an empty source has no words to repeat, so its division is skipped
    goal = goal.withColumn("whole", F.when(F.col("source_size") > 0, F.expr("quota div source_size")).otherwise(F.lit(0)))
    goal = written(goal.withColumn("rest", F.col("quota") - F.col("whole") * F.col("source_size")), "mix-targets")
    at = edges(slim, goal, (of, key, "size"), edge_rows).select(F.col("source").alias("s"), "cut", "before")
    goal = goal.join(at, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias(of), F.col("source_size").alias(goal_size), F.col("target").alias(goal_target), F.col("whole").alias(whole), F.col("rest").alias(rest), F.col("cut").alias(cut), F.col("before").alias(before))
    if goal.count() <= BROADCAST_ROWS:
        goal = F.broadcast(goal)
    rows = docs.select(*[F.col(c) for c in kept], n_words(F.col("text")).alias("size"), md5.alias(key))
    rows = rows.join(goal, F.col("source").eqNullSafe(F.col(of)))
    begin = F.substring(F.col(key), F.lit(1), F.length(cut))
    edge = F.col(cut).isNotNull() & (begin == F.col(cut))
    plain = rows.where(~edge).withColumn(extra, F.when(F.col(cut).isNotNull() & (begin < F.col(cut)), F.col("size")).otherwise(F.lit(0)))
    order = W.partitionBy("source").orderBy(key, "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    seen = F.col(before) + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = rows.where(edge).withColumn(extra, F.greatest(F.lit(0), F.least(F.col("size"), F.col(rest) - seen)))
    out = plain.unionByName(last)
    return out.select(*[F.col(c) for c in kept], "size", F.col(goal_size).alias("source_size"), F.col(goal_target).alias("target"), (F.col(whole) * F.col("size") + F.col(extra)).cast("long").alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row of ``mix`` as often as it is taken.

    A last part holds the first words only, joined by single spaces, and has its own ``n_chars`` if there
    is such a column.
    """
    size, taken = F.col("size"), F.col("taken")
    some, n, i = fresh(mixed.columns, "part", "n", "i")
    times = F.when(size > 0, F.expr("taken div size")).otherwise(F.lit(0))
    part = F.when(size > 0, taken % size).otherwise(F.lit(0))
    rows = mixed.withColumn(some, part).withColumn(n, times + (part > 0).cast("long")).where(F.col(n) > 0)
    rows = rows.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n))))
    last = (F.col(i) == F.col(n)) & (F.col(some) > 0)
    words = F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), 1, F.col(some).cast("int"))
    rows = rows.withColumn("text", F.when(last, F.array_join(words, " ")).otherwise(F.col("text")))
    if "n_chars" in rows.columns:
        rows = rows.withColumn("n_chars", F.when(last, F.char_length("text").cast(rows.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.drop(some, n, i)


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':{SEED}') AS k
  FROM documents),
s0 AS (SELECT source, sum(size)::HUGEINT AS s FROM d GROUP BY source),
s1 AS (SELECT source, s, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::HUGEINT AS w FROM s0),
s2 AS (SELECT *, row_number() OVER f AS i,
         (sum(s) OVER () - 3 * coalesce(sum(s) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS lw,
         (sum(w) OVER () - coalesce(sum(w) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::HUGEINT AS lwt
       FROM s1 WINDOW f AS (ORDER BY s::DOUBLE / w::DOUBLE, encode(source) NULLS LAST)),
s3 AS (SELECT *, min(CASE WHEN NOT lw * w > 3 * s * lwt THEN i END) OVER () AS fi FROM s2),
s4 AS (SELECT *, max(CASE WHEN i = fi THEN lw END) OVER () AS rw, max(CASE WHEN i = fi THEN lwt END) OVER () AS rwt FROM s3),
t AS (SELECT source, s::BIGINT AS source_size,
        CASE WHEN fi IS NULL OR i < fi THEN (3 * s)::DOUBLE ELSE (rw * w)::DOUBLE / rwt::DOUBLE END AS target,
        CASE WHEN fi IS NULL OR i < fi THEN 3 * s ELSE (rw * w) // rwt END::BIGINT AS quota FROM s4),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.quota,
        CASE WHEN t.source_size > 0 THEN t.quota // t.source_size ELSE 0 END AS whole,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (whole * size + greatest(0, least(size, quota - whole * source_size - seen)))::BIGINT AS taken
FROM j
"""
