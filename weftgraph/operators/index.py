"""Adjacency lists, degrees and membership over ``triples(s, p, o)``.

Lists are views: a lookup is a filter on the triples, which Parquet's folders and statistics prune, and a
whole index is one aggregation.  Lists hold distinct terms in ascending order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.graph import Graph, Source

#: index name -> key columns and listed columns
INDEXES = {
    "s2o": (("s",), ("o",)),
    "o2s": (("o",), ("s",)),
    "sp2o": (("s", "p"), ("o",)),
    "op2s": (("o", "p"), ("s",)),
    "s2po": (("s",), ("p", "o")),
    "o2ps": (("o",), ("p", "s")),
    "p2s": (("p",), ("s",)),
    "p2o": (("p",), ("o",)),
}


def index(triples: DataFrame, name: str) -> DataFrame:
    """Key columns, ``list`` (of terms, or of structs for the two-column lists) and its ``size``."""
    keys, values = INDEXES[name]
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    out = triples.groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias("list"))
    return out.withColumn("size", F.size("list"))


def index_parts(triples: DataFrame, name: str, size: int = 100_000) -> DataFrame:
    """As ``index``, but a key with more than ``size`` listed values has several rows, of about ``size`` values each, numbered by ``part``.

    Values are dealt to a key's parts by hash, so no task gathers the list of a hub or of a whole predicate.
    """
    keys, values = INDEXES[name]
    value = F.col(values[0]) if len(values) == 1 else F.struct(*values)
    rows = triples.select(*keys, value.alias("value")).distinct()
    hot = rows.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts")).where("parts > 1")
    same = [F.col(k) == F.col(f"{k}_") for k in keys]
    part = F.coalesce(F.pmod(F.xxhash64("value"), F.col("parts")).cast("int"), F.lit(0))
    out = rows.join(hot, same, "left").select(*keys, part.alias("part"), "value")
    return out.groupBy(*keys, "part").agg(F.sort_array(F.collect_list("value")).alias("list")).withColumn("size", F.size("list"))


#: characters of a key's text that a range of subjects shares
RANGE = 3


def subject_texts(graph: Graph, predicates: list[str], name: str) -> DataFrame:
    """Lists of subjects of relational tables as texts (items by comma, predicate and subject by blank), in parts: key columns, ``p`` of a two-column list, ``text`` and ``size``.

    A part holds a key's subjects of one range, in order and each once, and a key's parts are in order of their
    texts.  A table's rows are dealt out once, on plain keys, and become triples where their range lies.
    """
    keys, values = INDEXES[name]
    by = [*keys, *[v for v in values if v != "s"]]
    kinds: dict[str, list[tuple[Source, list[str]]]] = {}
    for source in graph.sources:
        if names := [p for p in source.attributes if p in predicates]:
            kinds.setdefault(source.kind.name, []).append((source, names))
    parts = []
    for kind, held in kinds.items():
        start = F.lit(len(f"<{kind}/") + RANGE)
        if len(held) == 1:
            source, names = held[0]
            plain = source.frame().select(source.key().alias("key"), *[source.attributes[p].value().alias(f"v{i}") for i, p in enumerate(names)])
            dealt = plain.withColumn("range", F.left(source.kind.render(F.col("key")), start)).repartition("range")
            pairs = [F.struct(F.lit(p).alias("p"), source.attributes[p].kind.render(F.col(f"v{i}")).alias("o")) for i, p in enumerate(names)]
            rows = dealt.select("range", source.kind.render(F.col("key")).alias("s"), F.explode(F.array(*pairs)).alias("t")).select("range", "s", "t.p", "t.o")
        else:  # their rows may say the same of one subject
            rows = reduce(DataFrame.unionAll, [graph.unpivoted(*x) for x in held]).withColumn("range", F.left("s", start)).repartition("range")
        item = F.col("s") if len(values) == 1 else F.concat_ws(" ", *values)
        parts.append(rows.where("s is not null and o is not null").groupBy("range", *by).agg(F.sort_array(F.array_distinct(F.collect_list(item))).alias("items")).select(*by, F.concat_ws(",", "items").alias("text"), F.size("items").alias("size")))
    return reduce(DataFrame.unionAll, parts)


def subject_lists(graph: Graph, predicates: list[str], name: str) -> DataFrame:
    """Key columns, the whole ``list`` of subjects as one text, and its ``size``.

    The rows are dealt out once more when they are whole: a row that comes from there has just its own size, and
    what made it is gone, so that a writer has room for its copies of a long one.
    """
    keys, _ = INDEXES[name]
    rows = subject_texts(graph, predicates, name).groupBy(*keys).agg(F.sort_array(F.collect_list("text")).alias("parts"), F.sum("size").cast("int").alias("size"))
    return rows.select(*keys, F.concat_ws(",", "parts").alias("list"), "size").repartition("size", *keys)


def lookup(triples: DataFrame, name: str, *key: str) -> DataFrame:
    """The list of one key as rows in ascending order; empty on a miss."""
    keys, values = INDEXES[name]
    for column, term in zip(keys, key, strict=True):
        triples = triples.where(F.col(column) == F.lit(term))
    return triples.select(*values).distinct().orderBy(*values)


def out_degree(triples: DataFrame) -> DataFrame:
    """``term, degree``: triples with the term as subject."""
    return triples.groupBy(F.col("s").alias("term")).agg(F.count(F.lit(1)).alias("degree"))


def in_degree(triples: DataFrame) -> DataFrame:
    """``term, degree``: triples with the term as object."""
    return triples.groupBy(F.col("o").alias("term")).agg(F.count(F.lit(1)).alias("degree"))


def degree(triples: DataFrame) -> DataFrame:
    """``term, degree``: triples with the term at either end (a loop counts twice)."""
    return triples.select(F.explode(F.array("s", "o")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("degree"))


def exists(triples: DataFrame, s: str, p: str, o: str) -> bool:
    return not triples.where((F.col("s") == s) & (F.col("p") == p) & (F.col("o") == o)).isEmpty()


def existing(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of ``wanted(s, p, o)`` that are stored."""
    return wanted.join(triples, ["s", "p", "o"], "left_semi")


def with_predicate(candidates: DataFrame, triples: DataFrame, p: str, role: str = "s") -> DataFrame:
    """Rows of ``candidates(term)`` that stand at end ``role`` of some triple of predicate p."""
    ends = triples.where(F.col("p") == p).select(F.col(role).alias("term"))
    return candidates.join(ends, "term", "left_semi")


# id lists as array columns: distinct values in ascending order


def intersect(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_intersect(a, b))


def union(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_union(a, b))


def difference(a: Column | str, b: Column | str) -> Column:
    return F.sort_array(F.array_except(a, b))


def member(a: Column | str, value: object) -> Column:
    return F.array_contains(a, value)


def position(a: Column | str, value: object) -> Column:
    """Index of a value, -1 if absent."""
    return F.array_position(a, value) - 1


def insert(a: Column | str, value: object) -> Column:
    return F.sort_array(F.array_distinct(F.array_append(a, value)))


def remove(a: Column | str, value: object) -> Column:
    return F.array_remove(a, value)


def erase_from(a: Column | str, i: int) -> Column:
    """The list without its elements from index i on."""
    return F.slice(a, 1, i)
