"""Filter, BIND and aggregate expressions as columns.

Two modes of comparison.  ``lexical`` compares terms as byte strings after dropping one leading quote,
and nothing is unbound: an unbound variable is the empty string.  ``typed`` compares numbers as numbers
where both sides are, strings otherwise, and unbound is null.  Function results are typed in both.
"""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from weftgraph.operators.bindings import Rel
from weftgraph.sparql.ast import Expr
from weftgraph.sparql.parser import AGGREGATES, SparqlError
from weftgraph.terms import bare, is_blank, is_literal, lang, unmarked

COMPARE = {"=": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}
ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul}
NUMBER = re.compile(r"-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass
class Value:
    """``type`` is term, string, int, double, boolean or time."""

    column: Column
    type: str

    @property
    def string(self) -> Column:
        return bare(self.column) if self.type == "term" else self.column.cast("string")

    @property
    def number(self) -> Column:
        if self.type in ("int", "double"):
            return self.column.cast("double")
        return self.string.try_cast("double")

    @property
    def boolean(self) -> Column:
        if self.type == "boolean":
            return self.column
        if self.type in ("int", "double"):
            return self.column != 0
        return F.coalesce(self.string.try_cast("boolean"), F.length(self.string) > 0)

    @property
    def time(self) -> Column:
        return self.column if self.type == "time" else self.string.try_cast("timestamp")

    @property
    def term(self) -> Column:
        return self.column if self.type == "term" else F.concat(F.lit('"'), self.column.cast("string"), F.lit('"'))


def constant(text: str) -> Value:
    if text in ("true", "false"):
        return Value(F.lit(text == "true"), "boolean")
    if NUMBER.fullmatch(text):
        whole = text.lstrip("-").isdigit()
        return Value(F.lit(int(text) if whole else float(text)), "int" if whole else "double")
    return Value(F.lit(text), "term")


def _one(f, type_: str, take: str = "string"):
    return lambda a: Value(f(getattr(a, take)), type_)


def _two(f, type_: str):
    return lambda a, b: Value(f(a.string, b.string), type_)


def _literal_text(e: Expr) -> str:
    if e.op != "term":
        raise SparqlError("this function needs a constant here")
    t = e.args[0]
    return t[1:-1] if t[:1] == '"' else t


FUNCTIONS = {
    "str": _one(lambda c: c, "string"),
    "strlen": _one(F.char_length, "int"),
    "ucase": _one(F.upper, "string"),
    "lcase": _one(F.lower, "string"),
    "encode_for_uri": _one(lambda c: F.regexp_replace(F.regexp_replace(F.url_encode(c), r"\+", "%20"), r"\*", "%2A"), "string"),
    "strstarts": _two(lambda a, b: a.startswith(b), "boolean"),
    "strends": _two(lambda a, b: a.endswith(b), "boolean"),
    "contains": _two(lambda a, b: a.contains(b), "boolean"),
    "strbefore": _two(lambda a, b: F.when(F.instr(a, b) > 0, F.call_function("substring_index", a, b, F.lit(1))).otherwise(""), "string"),
    "abs": _one(F.abs, "double", "number"),
    "ceil": _one(F.ceil, "int", "number"),
    "floor": _one(F.floor, "int", "number"),
    "round": _one(lambda c: F.floor(c + 0.5), "int", "number"),
    "year": _one(F.year, "int", "time"),
    "month": _one(F.month, "int", "time"),
    "day": _one(F.dayofmonth, "int", "time"),
    "hours": _one(F.hour, "int", "time"),
    "minutes": _one(F.minute, "int", "time"),
    "seconds": _one(F.second, "int", "time"),
    "tz": _one(lambda c: F.when(c.isNotNull(), F.lit("")), "string"),
    "timezone": _one(lambda c: F.when(c.isNotNull(), F.lit("PT0S")), "string"),
    "md5": _one(F.md5, "string"),
    "sha1": _one(F.sha1, "string"),
    "sha256": _one(lambda c: F.sha2(c, 256), "string"),
    "sha384": _one(lambda c: F.sha2(c, 384), "string"),
    "sha512": _one(lambda c: F.sha2(c, 512), "string"),
}
_ON_TERMS = {
    "isiri": lambda t: t.startswith("<") & ~is_blank(t),
    "isuri": lambda t: t.startswith("<") & ~is_blank(t),
    "isblank": is_blank,
    "isliteral": is_literal,
    "isnumeric": lambda t: is_literal(t) & bare(t).try_cast("double").isNotNull(),
}


@dataclass
class Scope:
    """Expressions over one relation.  ``aggregate`` maps aggregate calls to columns, inside GROUP BY."""

    rel: Rel
    mode: str = "lexical"
    aggregate: dict[int, Value] | None = None

    def value(self, e: Expr) -> Value:
        op, args = e.op, e.args
        if op == "var":
            v = args[0]
            if v in getattr(self.rel, "typed", {}):
                return self.rel.typed[v]
            return Value(self.rel.term(v) if v in self.rel.kinds else F.lit(None).cast("string"), "term")
        if op == "term":
            return constant(args[0])
        if op in COMPARE:
            return Value(self.compare(COMPARE[op], args[0], args[1]), "boolean")
        if op in ("in", "notin"):
            some = F.lit(False)
            for x in args[1:]:
                some = some | self.compare(operator.eq, args[0], x)
            return Value(some if op == "in" else ~some, "boolean")
        if op == "&&":
            return Value(self.value(args[0]).boolean & self.value(args[1]).boolean, "boolean")
        if op == "||":
            return Value(self.value(args[0]).boolean | self.value(args[1]).boolean, "boolean")
        if op == "!":
            return Value(~self.value(args[0]).boolean, "boolean")
        if op in AGGREGATES:
            if self.aggregate is None or id(e) not in self.aggregate:
                raise SparqlError(f"{op.upper()} is not allowed here")
            return self.aggregate[id(e)]
        if op in ("exists", "notexists"):
            raise SparqlError("EXISTS is only supported as a conjunct of a FILTER")
        return self.call(op, args)

    def compare(self, f, a: Expr, b: Expr) -> Column:
        if self.mode == "lexical" and a.op in ("var", "term") and b.op in ("var", "term"):
            typed = getattr(self.rel, "typed", {})
            if not any(x.op == "var" and x.args[0] in typed for x in (a, b)):
                return f(self._lexical(a), self._lexical(b))
        x, y = self.value(a), self.value(b)
        numbers = {"int", "double"}
        if x.type in numbers or y.type in numbers:
            return f(x.number, y.number)
        if "time" in (x.type, y.type):
            return f(x.time, y.time)
        if "boolean" in (x.type, y.type):
            return f(x.boolean, y.boolean)
        if "string" in (x.type, y.type):
            return f(x.string, y.string)
        both = x.number.isNotNull() & y.number.isNotNull() & is_literal(x.column) & is_literal(y.column)
        return F.when(both, f(x.number, y.number)).otherwise(f(x.column, y.column))

    def _lexical(self, e: Expr) -> Column:
        if e.op == "term":
            t = e.args[0]
            return F.lit(t[1:] if t[:1] in ("'", '"') else t)
        t = self.value(e).column
        return F.coalesce(unmarked(t), F.lit(""))

    def call(self, op: str, args: list[Expr]) -> Value:
        if op in FUNCTIONS:
            return FUNCTIONS[op](*[self.value(a) for a in args])
        if op in _ON_TERMS:
            return Value(_ON_TERMS[op](self.value(args[0]).term), "boolean")
        values = lambda: [self.value(a) for a in args]
        if op == "bound":
            return Value(self.value(args[0]).column.isNotNull(), "boolean")
        if op == "sameterm":
            a, b = values()
            return Value(a.term == b.term, "boolean")
        if op == "lang":
            return Value(lang(self.value(args[0]).term), "string")
        if op == "langmatches":
            a, b = values()
            low = F.lower(a.string)
            return Value(F.when(b.string == "*", low != "").otherwise((low == F.lower(b.string)) | low.startswith(F.concat(F.lower(b.string), F.lit("-")))), "boolean")
        if op in ("iri", "uri"):
            return Value(F.concat(F.lit("<"), self.value(args[0]).string, F.lit(">")), "term")
        if op == "strdt":
            return Value(F.concat(F.lit('"'), self.value(args[0]).string, F.lit('"')), "term")
        if op == "strlang":
            a, b = values()
            return Value(F.concat(F.lit('"'), a.string, F.lit('"@'), b.string), "term")
        if op == "datatype":
            t = self.value(args[0]).term
            base = "<http://www.w3.org/"
            return Value(F.when(lang(t) != "", F.lit(base + "1999/02/22-rdf-syntax-ns#langString>")).when(is_literal(t), F.lit(base + "2001/XMLSchema#string>")), "term")
        if op == "concat":
            return Value(F.concat(*[v.string for v in values()]), "string")
        if op == "substr":
            a, b, *n = values()
            size = n[0].number.cast("int") if n else F.length(a.string)
            return Value(F.substring(a.string, b.number.cast("int"), size), "string")
        if op == "strafter":
            a, b = values()
            at = F.instr(a.string, b.string)
            return Value(F.when(at > 0, F.substring(a.string, at + F.length(b.string), F.length(a.string))).otherwise(""), "string")
        if op == "replace":
            text, pattern, new = self.value(args[0]).string, _literal_text(args[1]), _literal_text(args[2])
            flags = f"(?{_literal_text(args[3])})" if len(args) > 3 else ""
            return Value(F.regexp_replace(text, flags + pattern, new), "string")
        if op == "regex":
            flags = f"(?{_literal_text(args[2])})" if len(args) > 2 else ""
            return Value(self.value(args[0]).string.rlike(flags + _literal_text(args[1])), "boolean")
        if op == "if":
            c, a, b = values()
            same = a.type == b.type
            return Value(F.when(c.boolean, a.column if same else a.term).otherwise(b.column if same else b.term), a.type if same else "term")
        if op == "coalesce":
            found = values()
            same = len({v.type for v in found}) == 1
            return Value(F.coalesce(*[v.column if same else v.term for v in found]), found[0].type if same else "term")
        if op in ("+", "-", "*"):
            a, b = values()
            if a.type == b.type == "int":
                return Value(ARITHMETIC[op](a.column, b.column), "int")
            return Value(ARITHMETIC[op](a.number, b.number), "double")
        if op == "/":
            a, b = values()
            return Value(F.try_divide(a.number, b.number), "double")
        if op == "neg":
            a = self.value(args[0])
            return Value(-a.column if a.type == "int" else -a.number, "int" if a.type == "int" else "double")
        if op == "rand":
            return Value(F.rand(), "double")
        if op == "now":
            return Value(F.current_timestamp(), "time")
        if op == "bnode":
            return Value(F.concat(F.lit("<_:"), F.uuid() if not args else F.md5(self.value(args[0]).string), F.lit(">")), "term")
        raise SparqlError(f"unknown function {op.upper()}")


def aggregates_in(e: Expr) -> list[Expr]:
    if e.op in AGGREGATES:
        return [e]
    return [x for a in e.args if isinstance(a, Expr) for x in aggregates_in(a)]


def _total(number: Column, distinct: bool) -> Column:
    """Sum of doubles.  Where all are whole millionths below 10 ** 22 it runs on decimals and does not depend on row order."""
    exact = number.try_cast("decimal(28,6)")
    fits = F.min(F.when(number.isNotNull(), F.coalesce(exact.cast("double") == number, F.lit(False))))
    add = F.sum_distinct if distinct else F.sum
    return F.when(fits, add(exact).cast("double")).otherwise(add(number))


def aggregate(e: Expr, scope: Scope) -> tuple[Column, str]:
    """Aggregate column and type of its result."""
    if e.op == "count":
        if not e.args:
            if e.distinct:
                every = [F.coalesce(scope.rel.term(v), F.lit("")) for v in scope.rel.kinds]
                return F.count_distinct(F.struct(*every)), "int"
            return F.count(F.lit(1)), "int"
        c = scope.value(e.args[0]).term
        return (F.count_distinct(c) if e.distinct else F.count(c)), "int"
    a = scope.value(e.args[0])
    if e.op in ("sum", "avg"):
        total = _total(a.number, e.distinct)
        if e.op == "sum":
            return F.coalesce(total, F.lit(0.0)), "double"
        return total / (F.count_distinct(a.number) if e.distinct else F.count(a.number)), "double"
    if e.op in ("min", "max"):
        pick = F.min if e.op == "min" else F.max
        number = pick(a.number)
        return F.when(F.count(a.number) == F.count(a.column), Value(number, "double").term).otherwise(pick(a.term)), "term"
    if e.op == "sample":
        return F.min(a.term), "term"
    sep = _literal_text(e.args[1]) if len(e.args) > 1 else " "
    items = F.collect_set(a.string) if e.distinct else F.collect_list(a.string)
    return F.array_join(F.sort_array(items), sep), "string"
