"""Queries as DataFrames.

A basic graph pattern becomes one scan for each (subject, table) with all its columns, one for each other
pattern, joined left-deep in the planner's order.  ``match="iso"`` binds different node variables to
different nodes; predicates ``a <> b`` stand at the first join where both are bound.  ``match="homo"`` is
standard.  In a group, its patterns come first (as one basic graph pattern), then nested groups, unions,
optionals and the rest in order, then filters; a filter of constants and patterns' variables is pushed
to the scans by Catalyst.
"""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.functions.expressions import Scope, Value, aggregate, aggregates_in
from weftgraph.graph import Graph, Source
from weftgraph.operators.bindings import Rel, column_name, join, left_join, minus, semi_join, union
from weftgraph.plans.planner import Scan, is_var, order
from weftgraph.plans.stats import Stats
from weftgraph.scratch import materialised
from weftgraph.sparql.ast import Ask, Bind, Construct, Expr, Filter, Group, Minus, Optional_, Pattern, Select, Union, Values, variables
from weftgraph.sparql.parser import SparqlError, parse
from weftgraph.terms import TERM, Kind


class Compiler:
    def __init__(self, graph: Graph, match: str = "homo", filter_mode: str = "lexical", stats: Stats | None = None, pu_variables: bool = True):
        if match not in ("homo", "iso"):
            raise ValueError("match is 'homo' or 'iso'")
        if filter_mode not in ("lexical", "typed"):
            raise ValueError("filter_mode is 'lexical' or 'typed'")
        self.graph, self.match, self.mode, self.stats, self.pu = graph, match, filter_mode, stats, pu_variables
        self.fresh = 0

    # basic graph patterns

    def unit(self) -> Rel:
        return Rel(self.graph.spark.range(1).select(F.lit(1).alias("one")), {})

    def nothing(self, names: list[str]) -> Rel:
        df = self.graph.spark.createDataFrame([], ", ".join(f"`{column_name(v)}` string" for v in names) or "one int")
        return Rel(df, dict.fromkeys(names, TERM))

    def _temp(self) -> str:
        self.fresh += 1
        return f"?.t{self.fresh}"

    def plain(self, patterns: list[Pattern]) -> tuple[list[Pattern], list[Rel]]:
        """Patterns without paths (``<PU1>`` is a predicate variable), and relations of those paths that need one."""
        out: list[Pattern] = []
        rels: list[Rel] = []
        for p in patterns:
            path = p.p
            if isinstance(path, str):
                if self.pu and path.startswith("<PU") and path[3:-1].isdigit():
                    path = f"?.{path[1:-1]}"
                out.append(Pattern(p.s, path, p.o))
            elif path[0] == "^":
                a, b = self.plain([Pattern(p.o, path[1], p.s)])
                out, rels = out + a, rels + b
            elif path[0] == "/":
                mid = self._temp()
                a, b = self.plain([Pattern(p.s, path[1], mid), Pattern(mid, path[2], p.o)])
                out, rels = out + a, rels + b
            else:
                rels.append(self.path(p))
        return out, rels

    def path(self, p: Pattern) -> Rel:
        mark = p.p[0]
        if mark == "|":
            return union(*[self.bgp([Pattern(p.s, x, p.o)]) for x in p.p[1:]])
        if mark == "!":
            forward = [x for x in p.p[1] if isinstance(x, str)]
            back = [x[1] for x in p.p[1] if not isinstance(x, str)]
            v = self._temp()
            parts = []
            for names, s, o in ((forward, p.s, p.o), (back, p.o, p.s)):
                if names or (not forward and not back):
                    rel = self.scan_any(Pattern(s, v, o), without=names)
                    parts.append(Rel(rel.df.drop(column_name(v)), {k: x for k, x in rel.kinds.items() if k != v}))
            return reduce(union, parts)
        # transitive paths: pairs of terms, set semantics
        pairs = self.bgp([Pattern("?.from", p.p[1], "?.to")]).as_terms().df.select(F.col(column_name("?.from")).alias("s"), F.col(column_name("?.to")).alias("o")).distinct()
        if mark in ("+", "*"):
            pairs = closure(pairs, None if is_var(p.s) else p.s, None if is_var(p.o) else p.o)
        if mark in ("*", "?"):
            rows = self.graph.triples()
            nodes = rows.select(F.explode(F.array("s", "o")).alias("s")).distinct().select("s", F.col("s").alias("o"))
            fixed = [t for t in (p.s, p.o) if not is_var(t)]
            own = self.graph.spark.createDataFrame([(t, t) for t in fixed], "s string, o string")
            pairs = pairs.unionAll(nodes if not fixed else own).distinct()
        conditions = [F.col(c) == F.lit(t) for c, t in (("s", p.s), ("o", p.o)) if not is_var(t)]
        if p.s == p.o:
            conditions.append(F.col("s") == F.col("o"))
        for c in conditions:
            pairs = pairs.where(c)
        cols = {t: F.col(c).alias(column_name(t)) for c, t in (("o", p.o), ("s", p.s)) if is_var(t)}
        return Rel(pairs.select(*(cols.values() or [F.lit(1).alias("one")])), dict.fromkeys(cols, TERM))

    def scans(self, patterns: list[Pattern]) -> list[Scan]:
        by_subject: dict[tuple[str, str], Scan] = {}
        out = []
        for p in patterns:
            source = None if is_var(p.p) else self.graph.source_of(p.p)
            here = frozenset(t for t in (p.s, p.p, p.o) if is_var(t))
            if source is None:
                out.append(Scan([p], here))
                continue
            # the same predicate twice in one scan is the same value twice, as its column is single-valued
            scan = by_subject.get((p.s, source.name))
            if scan is None:
                scan = by_subject[p.s, source.name] = Scan([p], here)
                out.append(scan)
            else:
                scan.patterns.append(p)
                scan.vars |= here
        return out

    def relation(self, scan: Scan, known: dict[str, Kind] | None = None) -> Rel:
        p = scan.patterns[0]
        if is_var(p.p):
            return self.scan_any(p, known=known)
        source = self.graph.source_of(p.p)
        return self.scan_stored(p) if source is None else self.scan_table(source, scan.patterns)

    def scan_table(self, source: Source, patterns: list[Pattern]) -> Rel:
        s = patterns[0].s
        df = source.frame()
        kinds, columns = {}, {}
        if is_var(s):
            kinds[s], columns[s] = source.kind, source.key()
        else:
            condition = source.kind.equals(source.key(), s)
            if condition is None:
                return self.nothing(sorted({t for p in patterns for t in (p.s, p.o) if is_var(t)}))
            df = df.where(condition)
        for p in patterns:
            a = source.attributes[p.p]
            if not is_var(p.o):
                condition = a.kind.equals(a.value(), p.o)
                if condition is None:
                    return self.nothing(sorted({t for q in patterns for t in (q.s, q.o) if is_var(t)}))
                value = a.kind.parse(p.o)
                typed = a.typed(value) if a.typed is not None else None
                df = df.where(condition if typed is None else typed)
                continue
            df = df.where(a.value().isNotNull())
            if p.o in columns:
                if kinds[p.o].name == a.kind.name:
                    df = df.where(columns[p.o] == a.value())
                else:
                    df = df.where(kinds[p.o].render(columns[p.o]) == a.kind.render(a.value()))
            else:
                kinds[p.o], columns[p.o] = a.kind, a.value()
        return Rel(df.select(*([c.alias(column_name(v)) for v, c in columns.items()] or [F.lit(1).alias("one")])), kinds)

    def _bound(self, df: DataFrame, ends: list[tuple[str, str]]) -> Rel:
        columns: dict[str, str] = {}
        for c, t in ends:
            if not is_var(t):
                df = df.where(F.col(c) == F.lit(t))
            elif t in columns:
                df = df.where(F.col(c) == F.col(columns[t]))
            else:
                columns[t] = c
        return Rel(df.select(*([F.col(c).alias(column_name(v)) for v, c in columns.items()] or [F.lit(1).alias("one")])), dict.fromkeys(columns, TERM))

    def scan_stored(self, p: Pattern) -> Rel:
        if self.graph.names is not None and p.p not in self.graph.names or self.graph.stored is None:
            return self.nothing(sorted({t for t in (p.s, p.o) if is_var(t)}))
        return self._bound(self.graph.predicate(p.p), [("s", p.s), ("o", p.o)])

    def scan_any(self, p: Pattern, without: list[str] | None = None, known: dict[str, Kind] | None = None) -> Rel:
        """A predicate variable: every predicate whose ends can be the pattern's constants, or of the kinds that other patterns bind.

        Where a table's chosen attributes are all of one kind, ends stay plain values, so joins run on them.
        """
        known = known or {}
        may_be = lambda kind, t: not is_var(t) or t not in known or known[t].name == kind.name
        ends = [("s", p.s), ("p", p.p), ("o", p.o)]
        parts = []
        for source in self.graph.sources:
            if not may_be(source.kind, p.s):
                continue
            held = [n for n, a in source.attributes.items() if n not in (without or ()) and may_be(a.kind, p.o)]
            if not held:
                continue
            df = source.frame()
            if not is_var(p.s):
                condition = source.kind.equals(source.key(), p.s)
                if condition is None:
                    continue
                df = df.where(condition)
            if not is_var(p.o):
                # the disjunction can be pushed to the scan, the exact test follows on the terms
                tests = {n: source.attributes[n].kind.equals(source.attributes[n].value(), p.o) for n in held}
                held = [n for n in held if tests[n] is not None]
                if held:
                    df = df.where(reduce(lambda a, b: a | b, [tests[n] for n in held]))
            if not held:
                continue
            kinds = {source.attributes[n].kind.name: source.attributes[n].kind for n in held}
            if len(kinds) == 1 and is_var(p.o) and len({p.s, p.p, p.o}) == 3:
                parts.append(self._plain_ends(source, held, df, p, next(iter(kinds.values()))))
            else:
                parts.append(self._bound(Graph.unpivoted(source, held, df), ends))
        if self.graph.stored is not None:
            rows = self.graph.stored
            rows = rows.where(~F.col("p").isin(list(without))) if without else rows
            parts.append(self._bound(rows, ends))
        names = sorted({t for t in (p.s, p.p, p.o) if is_var(t)})
        return reduce(union, parts) if parts else self.nothing(names)

    def _plain_ends(self, source: Source, held: list[str], df: DataFrame, p: Pattern, kind: Kind) -> Rel:
        pairs = F.array(*[F.struct(F.lit(n).alias("p"), source.attributes[n].value().alias("o")) for n in held])
        df = df.select(source.key().alias("s"), F.explode(pairs).alias("t")).where("t.o is not null")
        kinds = {p.s: source.kind, p.p: TERM, p.o: kind}
        columns = {p.s: F.col("s"), p.p: F.col("t.p"), p.o: F.col("t.o")}
        kinds = {v: k for v, k in kinds.items() if is_var(v)}
        return Rel(df.select(*[columns[v].alias(column_name(v)) for v in kinds]), kinds)

    def kinds(self, scans: list[Scan]) -> dict[str, Kind]:
        """Kinds of the variables that patterns over relational tables bind."""
        out: dict[str, Kind] = {}
        for p in (p for scan in scans for p in scan.patterns if not is_var(p.p)):
            if (source := self.graph.source_of(p.p)) is not None:
                for t, kind in ((p.s, source.kind), (p.o, source.attributes[p.p].kind)):
                    if is_var(t):
                        out.setdefault(t, kind)
        return out

    def different(self, rel: Rel, a: str, b: str) -> Rel:
        x, y = rel.kinds[a], rel.kinds[b]
        if x.name == y.name:
            return rel.where(rel.col(a) != rel.col(b))
        if TERM.name in (x.name, y.name):
            return rel.where(rel.term(a) != rel.term(b))
        return rel

    def bgp(self, patterns: list[Pattern]) -> Rel:
        patterns, rels = self.plain(patterns)
        nodes = dict.fromkeys(t for p in patterns for t in (p.s, p.o) if is_var(t))
        predicates = {p.p for p in patterns if is_var(p.p)}
        nodes = [v for v in nodes if v not in predicates]
        out: Rel | None = None
        done: set[str] = set()
        scans = self.scans(patterns)
        known = self.kinds(scans)
        for part in [*(self.relation(scan, known) for scan in order(scans, self.stats)), *rels]:
            out = part if out is None else join(out, part)
            if self.match == "iso":
                new = [v for v in nodes if v in out.kinds and v not in done]
                for i, v in enumerate(new):
                    for w in [*sorted(done), *new[:i]]:
                        out = self.different(out, v, w)
                done |= set(new)
        return out if out is not None else self.unit()

    # groups

    def group(self, group: Group) -> Rel:
        patterns = [x for x in group.items if isinstance(x, Pattern)]
        rest = [x for x in group.items if not isinstance(x, (Pattern, Filter))]
        filters = [x.expr for x in group.items if isinstance(x, Filter)]
        out = self.bgp(patterns) if patterns else None
        for x in rest:
            if isinstance(x, Optional_):
                base = out if out is not None else self.unit()
                out = left_join(base, self.group(x.group))
            elif isinstance(x, Minus):
                out = minus(out, self.group(x.group)) if out is not None else None
            elif isinstance(x, Bind):
                out = self.bind(out if out is not None else self.unit(), x)
            else:
                if isinstance(x, Group):
                    part = self.group(x)
                elif isinstance(x, Union):
                    part = reduce(union, [self.group(g) for g in x.groups])
                elif isinstance(x, Values):
                    part = self.values(x)
                else:
                    part = self.select(x)
                out = part if out is None else join(out, part)
        out = out if out is not None else self.unit()
        for f in filters:
            out = self.filter(out, f)
        return out

    def filter(self, rel: Rel, e: Expr) -> Rel:
        if e.op == "&&":
            return self.filter(self.filter(rel, e.args[0]), e.args[1])
        if e.op in ("exists", "notexists"):
            return semi_join(rel, self.group(e.args[0]), anti=e.op == "notexists")
        if e.op == "!" and e.args[0].op in ("exists", "notexists"):
            return semi_join(rel, self.group(e.args[0].args[0]), anti=e.args[0].op == "exists")
        return rel.where(Scope(rel, self.mode).value(e).boolean)

    def bind(self, rel: Rel, x: Bind) -> Rel:
        if x.var in rel.kinds:
            raise SparqlError(f"{x.var} is already bound")
        value = Scope(rel, self.mode).value(x.expr).term
        df = rel.df.withColumn(column_name(x.var), value)
        return Rel(df, rel.kinds | {x.var: TERM}, rel.maybe | {x.var})

    def values(self, x: Values) -> Rel:
        schema = ", ".join(f"`{column_name(v)}` string" for v in x.vars)
        df = self.graph.spark.createDataFrame([tuple(r) for r in x.rows], schema)
        return Rel(df, dict.fromkeys(x.vars, TERM), frozenset(v for i, v in enumerate(x.vars) if any(r[i] is None for r in x.rows)))

    # results

    def select(self, q: Select) -> Rel:
        """A sub-select as a relation of terms."""
        df, names = self.rows(q)
        columns = [Value(F.col(n), "term" if t else "string").term.alias(column_name("?" + n)) for n, t in names]
        kinds = {"?" + n: TERM for n, _ in names}
        return Rel(df.select(*columns), kinds, frozenset(kinds))

    def rows(self, q: Select) -> tuple[DataFrame, list[tuple[str, bool]]]:
        """Result columns by variable name, and whether each holds terms (aggregates and expressions may not)."""
        rel = self.group(q.where)
        items: list[Any] = q.items if q.items is not None else variables(q.where)
        calls = [a for i in items if not isinstance(i, str) for a in aggregates_in(i[0])]
        calls += [a for e in q.having for a in aggregates_in(e)] + [a for e, _ in q.order_by for a in aggregates_in(e)]
        if q.group_by or calls:
            scope, known = self.grouped(rel, q, calls)
        else:
            scope, known = Scope(rel, self.mode), rel.kinds
        for e in q.having:
            scope.rel.df = scope.rel.df.where(scope.value(e).boolean)
        out: list[tuple[str, Column, bool]] = []
        values: dict[str, Value] = {}
        for i in items:
            if isinstance(i, str):
                if i in known or i in getattr(scope.rel, "typed", {}):
                    v = scope.value(Expr("var", [i]))
                else:
                    # a variable that the pattern does not have prints as nothing
                    v = Value(F.lit(""), "term")
                out.append((i[1:], v.column, v.type == "term"))
                values[i] = v
            else:
                # aliases may be used by later expressions
                v = scope.value(i[0])
                out.append((i[1][1:], v.column, v.type == "term"))
                values[i[1]] = v
        df = scope.rel.df
        keys = []
        if q.order_by:
            typed = dict(getattr(scope.rel, "typed", {})) | {k: v for k, v in values.items() if k not in known}
            scope.rel.typed = typed
            for n, (e, up) in enumerate(q.order_by):
                v = scope.value(e)
                number, c = (None, v.column) if v.type != "term" else (v.number, v.column)
                for m, k in enumerate([c] if number is None else [number, c]):
                    keys.append((f"__k{n}_{m}", k, up))
        df = df.select(*[c.alias(n) for n, c, _ in out], *[k.alias(n) for n, k, _ in keys])
        if q.distinct:
            df = df.select(*[n for n, _, _ in out]).distinct() if not keys else df.dropDuplicates([n for n, _, _ in out])
        if keys:
            df = df.orderBy(*[F.col(n).asc_nulls_first() if up else F.col(n).desc_nulls_last() for n, _, up in keys])
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.select(*[n for n, _, _ in out]), [(n, t) for n, _, t in out]

    def grouped(self, rel: Rel, q: Select, calls: list[Expr]) -> tuple[Scope, dict]:
        scope = Scope(rel, self.mode)
        keys: dict[str, Column] = {}
        for g in q.group_by:
            name, e = (g, Expr("var", [g])) if isinstance(g, str) else (g[1], g[0])
            keys[name] = scope.value(e).term
        aggs, types = [], {}
        for i, call in enumerate(calls):
            column, types[id(call)] = aggregate(call, scope)
            aggs.append(column.alias(f"a_{i}"))
        frame = rel.df.groupBy(*[c.alias(column_name(v)) for v, c in keys.items()])
        df = frame.agg(*aggs) if aggs else frame.agg(F.count(F.lit(1)).alias("a_n"))
        out = Rel(df, dict.fromkeys(keys, TERM), frozenset(keys))
        return Scope(out, self.mode, {id(call): Value(F.col(f"a_{i}"), types[id(call)]) for i, call in enumerate(calls)}), out.kinds


def closure(pairs: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Transitive closure of ``pairs(s, o)``, from ``start`` or to ``end`` only where one is given.

    Semi-naive: each round joins only the pairs that the last one found; rounds end when none is new.
    """
    if start is None and end is not None:
        back = closure(pairs.select(F.col("o").alias("s"), F.col("s").alias("o")), end)
        return back.select(F.col("o").alias("s"), F.col("s").alias("o"))
    step = pairs.select(F.col("s").alias("m"), F.col("o").alias("n"))
    found = new = materialised(pairs if start is None else pairs.where(F.col("s") == start))
    while True:
        more = new.join(step, new.o == step.m).select("s", F.col("n").alias("o")).distinct()
        new = materialised(more.join(found, ["s", "o"], "left_anti"))
        if new.isEmpty():
            return found
        found = materialised(found.unionAll(new))


def query(graph: Graph, text: str, **options: Any) -> DataFrame:
    """Rows of a SELECT as terms (unbound: null), columns named by variable.  Options: ``match``, ``filter_mode``, ``stats``."""
    tree = parse(text)
    if not isinstance(tree, Select):
        raise SparqlError("query() takes a SELECT; see ask() and construct()")
    return Compiler(graph, **options).rows(tree)[0]


def ask(graph: Graph, text: str, **options: Any) -> bool:
    tree = parse(text)
    if not isinstance(tree, Ask):
        raise SparqlError("ask() takes an ASK")
    return not Compiler(graph, **options).group(tree.where).df.isEmpty()


def count(graph: Graph, text: str, **options: Any) -> int:
    """Number of rows of a SELECT."""
    return query(graph, text, **options).count()


def construct(graph: Graph, text: str, **options: Any) -> DataFrame:
    """Distinct ``s, p, o`` of a CONSTRUCT; rows with an unbound part are left out."""
    tree = parse(text)
    if not isinstance(tree, Construct):
        raise SparqlError("construct() takes a CONSTRUCT")
    compiler = Compiler(graph, **options)
    tree.select.items = variables(tree.select.where)
    rows, _ = compiler.rows(tree.select)
    part = lambda t: F.col(t[1:]) if is_var(t) and t[1:] in rows.columns else F.lit(None if is_var(t) else t).cast("string")
    made = F.explode(F.array(*[F.struct(part(p.s).alias("s"), part(p.p).alias("p"), part(p.o).alias("o")) for p in tree.template])).alias("t")
    return rows.select(made).select("t.*").where("s is not null and p is not null and o is not null").distinct()
