"""Predicate statistics: counts and distinct ends of each predicate, and overlaps of predicate pairs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.graph import Graph, whole_keys


def predicate_stats(graph: Graph, predicates: list[str] | None = None) -> DataFrame:
    """``p, triples, subjects, objects``."""
    rows = graph.triples(predicates)
    return rows.groupBy("p").agg(F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))


def ends(graph: Graph, predicates: list[str] | None = None) -> DataFrame:
    """Distinct ``p, role, term``: the subjects (role s) and objects (role o) of each predicate."""
    rows = graph.triples(predicates)
    return rows.select("p", F.explode(F.array(F.struct(F.lit("s").alias("role"), F.col("s").alias("term")), F.struct(F.lit("o").alias("role"), F.col("o").alias("term")))).alias("e")).select("p", "e.role", "e.term").distinct()


def overlaps(graph: Graph, predicates: list[str] | None = None) -> DataFrame:
    """``p1, role1, p2, role2, n``: terms common to two predicate ends, for every ordered pair with any.

    A term's ends are at most twice the predicates, so they are gathered in its row and paired there:
    one shuffle by term, and no self join.
    """
    sets = ends(graph, predicates).groupBy("term").agg(F.collect_list(F.struct("p", "role")).alias("e"))
    pairs = sets.where(F.size("e") > 1).select(F.col("e"), F.explode("e").alias("a")).select("a", F.explode("e").alias("b")).where("a <> b")
    return pairs.groupBy(F.col("a.p").alias("p1"), F.col("a.role").alias("role1"), F.col("b.p").alias("p2"), F.col("b.role").alias("role2")).agg(F.count(F.lit(1)).alias("n"))


#: ends that one whole number can mark
MOST_ENDS = 63


def _marked(value: Column, mark: Column, rows: DataFrame) -> DataFrame:
    return whole_keys(rows.select(value.alias("value"), mark.alias("ends")).where("ends <> 0"), "value")


def plain_ends(graph: Graph, predicates: list[str]) -> dict[str, tuple[list[tuple[str, str]], DataFrame]]:
    """Of relational tables, for each kind: its ends ``(p, role)``, and ``ends, n``: the distinct values that stand at a set of them.

    Values stay plain keys, and a value's ends are the bits of one number, so each end adds no row of its own
    for a term; values of two kinds are never the same term.
    """
    numbers: dict[str, list[tuple[str, str]]] = {}
    parts: dict[str, list[DataFrame]] = {}

    def bit(kind: str, p: str, role: str) -> Column:
        if (p, role) not in numbers.setdefault(kind, []):
            numbers[kind].append((p, role))
        return F.lit(1 << numbers[kind].index((p, role))).cast("long")

    for source in graph.sources:
        held = {p: a for p, a in source.attributes.items() if p in predicates}
        if not held:
            continue
        marks = [F.when(a.value().isNotNull(), bit(source.kind.name, p, "s")).otherwise(F.lit(0)) for p, a in held.items()]
        parts.setdefault(source.kind.name, []).append(_marked(source.key(), reduce(lambda a, b: a.bitwiseOR(b), marks), source.frame()))
        for kind in dict.fromkeys(a.kind.name for a in held.values()):
            pairs = [F.struct(a.value().alias("value"), bit(kind, p, "o").alias("ends")) for p, a in held.items() if a.kind.name == kind]
            rows = source.frame().select(F.explode(F.array(*pairs)).alias("e"))
            parts.setdefault(kind, []).append(_marked(F.col("e.value"), F.col("e.ends"), rows))
    one = lambda rows: rows.groupBy("value").agg(F.bit_or("ends").alias("ends")).groupBy("ends").agg(F.count(F.lit(1)).alias("n"))
    return {kind: (numbers[kind], one(reduce(DataFrame.unionAll, rows))) for kind, rows in parts.items()}


@dataclass
class Stats:
    """Statistics in memory (one row for each predicate, one for each pair): bounded by the vocabulary."""

    triples: dict[str, int] = field(default_factory=dict)
    ends: dict[tuple[str, str], int] = field(default_factory=dict)
    common: dict[tuple[str, str, str, str], int] = field(default_factory=dict)

    @classmethod
    def of(cls, graph: Graph, predicates: list[str] | None = None, pairs: bool = True) -> Stats:
        out = cls()
        if graph.stored is None and graph.sources:
            wanted = graph.predicates() if predicates is None else predicates
            kinds = [k for s in graph.sources for p, a in s.attributes.items() if p in wanted for k in (s.kind.name, a.kind.name)]
            if all(kinds.count(k) <= MOST_ENDS for k in kinds):
                return out._of_tables(graph, wanted, pairs)
        for r in predicate_stats(graph, predicates).collect():
            out.triples[r.p] = r.triples
            out.ends[r.p, "s"], out.ends[r.p, "o"] = r.subjects, r.objects
        if pairs:
            out.common = {(r.p1, r.role1, r.p2, r.role2): r.n for r in overlaps(graph, predicates).collect()}
        return out

    def _of_tables(self, graph: Graph, predicates: list[str], pairs: bool) -> Stats:
        """The same figures without writing terms out."""
        for source in graph.sources:
            held = {p: a for p, a in source.attributes.items() if p in predicates}
            if held:
                counts = source.frame().agg(*[F.count(a.value()).alias(f"n{i}") for i, a in enumerate(held.values())]).first()
                self.triples |= {p: n for p, n in zip(held, counts, strict=True) if n}
        for ends_, rows in plain_ends(graph, predicates).values():
            for r in rows.collect():
                here = [end for i, end in enumerate(ends_) if r.ends >> i & 1]
                for end in here:
                    self.ends[end] = self.ends.get(end, 0) + r.n
                if pairs:
                    for a, b in ((a, b) for a in here for b in here if a != b):
                        self.common[a + b] = self.common.get(a + b, 0) + r.n
        return self
