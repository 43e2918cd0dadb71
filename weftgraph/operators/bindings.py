"""Relations of variable bindings: joins, left joins, unions and differences with the group semantics.

An unbound variable is null and joins only with unbound, so joins on a variable that may be unbound are
null-safe; all others are plain equi joins that Catalyst can reorder, broadcast or split freely.

Where a variable may be unbound, all unbound rows of one side meet all of the other's, so such a join deals
the rows of a frequent key to parts, each of which meets a copy of the other side's rows of that key.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.terms import TERM, Kind


def column_name(var: str) -> str:
    """A column name for a variable; Spark's names ignore case, variables' don't."""
    name = var[1:].replace(".", "__b")
    bits = "".join("1" if c.isupper() else "0" for c in name)
    return "v_" + name.lower() + (f"_{int(bits, 2):x}_{len(bits)}" if "1" in bits else "")


#: rows of one key, on the left, that one part of a null-safe join holds
PART_ROWS = 250


@dataclass
class Rel:
    """``df`` has one column of plain values for each variable in ``kinds``; ``maybe`` may be unbound."""

    df: DataFrame
    kinds: dict[str, Kind]
    maybe: frozenset[str] = field(default_factory=frozenset)

    def col(self, var: str) -> Column:
        return self.df[column_name(var)]

    def term(self, var: str) -> Column:
        return self.kinds[var].render(self.col(var))

    def as_terms(self, variables: set[str] | None = None) -> Rel:
        """The same relation with (some) variables written out as terms."""
        out = [(self.term(v) if variables is None or v in variables else self.col(v)).alias(column_name(v)) for v in self.kinds]
        kinds = {v: TERM if variables is None or v in variables else k for v, k in self.kinds.items()}
        return Rel(self.df.select(*out), kinds, self.maybe)

    def where(self, condition: Column) -> Rel:
        return Rel(self.df.where(condition), self.kinds, self.maybe)


def _aligned(a: Rel, b: Rel, shared: list[str]) -> tuple[Rel, Rel]:
    """Both relations with equal kinds on the shared variables."""
    differ = {v for v in shared if a.kinds[v].name != b.kinds[v].name}
    return (a.as_terms(differ), b.as_terms(differ)) if differ else (a, b)


def _sides(a: Rel, b: Rel) -> tuple[Rel, Rel, list[str], Column | None]:
    shared = [v for v in a.kinds if v in b.kinds]
    a, b = _aligned(a, b, shared)
    right = b.df.select(*[b.col(v).alias("r_" + column_name(v) if v in shared else column_name(v)) for v in b.kinds])
    b = Rel(right, b.kinds, b.maybe)
    on = None
    for v in shared:
        name = column_name(v)
        x, y = a.df[name], right["r_" + name]
        one = x.eqNullSafe(y) if v in a.maybe or v in b.maybe else x == y
        on = one if on is None else on & one
    return a, b, shared, on


def join(a: Rel, b: Rel) -> Rel:
    """Natural join; without a shared variable the cross product."""
    if any(v in a.maybe or v in b.maybe for v in a.kinds if v in b.kinds):
        return _join_in_parts(a, b)
    a, b, shared, on = _sides(a, b)
    df = a.df.crossJoin(b.df) if on is None else a.df.join(b.df, on)
    kinds = a.kinds | {v: k for v, k in b.kinds.items() if v not in shared}
    return Rel(df.drop(*["r_" + column_name(v) for v in shared]), kinds, a.maybe | (b.maybe - set(shared)))


def _join_in_parts(a: Rel, b: Rel) -> Rel:
    """The natural join on variables that may be unbound, no part of which holds a whole frequent key.

    Its rows can outnumber both sides' by far, so terms are written out before it.
    """
    a, b = a.as_terms(), b.as_terms()
    keys = [column_name(v) for v in a.kinds if v in b.kinds]
    # an array, so that unbound is a value like others
    key = F.array(*[F.col(k) for k in keys])
    left, right = a.df.withColumn("__key", key), b.df.withColumn("__key", key)
    hot = left.groupBy("__key").agg(F.ceil(F.count(F.lit(1)) / PART_ROWS).cast("int").alias("__parts")).where("__parts > 1")
    left = left.join(hot, "__key", "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*a.df.columns), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts")
    right = right.join(hot, "__key", "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts", *keys)
    df = left.join(right, ["__key", "__part"]).drop("__key", "__part")
    kinds = a.kinds | {v: k for v, k in b.kinds.items() if v not in a.kinds}
    maybe = (a.maybe - set(b.kinds)) | (b.maybe - set(a.kinds)) | (a.maybe & b.maybe)
    return Rel(df, kinds, maybe)


def left_join(a: Rel, b: Rel, condition=None) -> Rel:
    """Rows of ``a`` with their matches in ``b``, or unbound; ``condition(rel)`` is part of the match."""
    a, b, shared, on = _sides(a, b)
    kinds = a.kinds | {v: k for v, k in b.kinds.items() if v not in shared}
    if condition is not None:
        both = a.df.crossJoin(b.df) if on is None else a.df.join(b.df, on)
        extra = condition(Rel(both, kinds))
        on = extra if on is None else on & extra
    df = a.df.join(b.df, on if on is not None else F.lit(True), "left")
    new = frozenset(v for v in b.kinds if v not in shared)
    return Rel(df.drop(*["r_" + column_name(v) for v in shared]), kinds, a.maybe | new)


def semi_join(a: Rel, b: Rel, anti: bool = False) -> Rel:
    """Rows of ``a`` with (``anti``: without) a match in ``b`` on the shared variables."""
    plain, (a, b, shared, on) = a, _sides(a, b)
    how = "left_anti" if anti else "left_semi"
    df = a.df.join(b.df, on if on is not None else F.lit(True), how)
    return Rel(df, a.kinds, plain.maybe)


def minus(a: Rel, b: Rel) -> Rel:
    """MINUS: without a shared variable nothing is removed."""
    return semi_join(a, b, anti=True) if set(a.kinds) & set(b.kinds) else a


def union(a: Rel, b: Rel) -> Rel:
    """Bag union; a variable of one side only is unbound in the other's rows."""
    shared = [v for v in a.kinds if v in b.kinds]
    a, b = _aligned(a, b, shared)
    df = a.df.unionByName(b.df, allowMissingColumns=True)
    return Rel(df, a.kinds | b.kinds, a.maybe | b.maybe | (set(a.kinds) ^ set(b.kinds)))
