"""Terms and kinds.

A term is a string in its lexical form: ``<iri>``, ``"text"`` or ``"text"@lang``.  A *kind* says how a column
of plain values (a key, a text) stands for terms, so joins run on the plain values and terms are only
written out where a result or a filter needs them.  Values of two kinds are never the same term, unless
one of them is TERM, whose values are the terms themselves.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Kind:
    name: str
    render: Callable[[Column], Column] = field(compare=False)
    #: the plain value of a term of this kind, None if the term is of another
    parse: Callable[[str], Any] = field(compare=False)

    def equals(self, column: Column, term: str) -> Column | None:
        """Condition that ``column`` stands for ``term``; None if it never can."""
        value = self.parse(term)
        return None if value is None else column == F.lit(value)


TERM = Kind("term", lambda c: c, lambda t: t)
LITERAL = Kind("literal", lambda c: F.concat(F.lit('"'), c, F.lit('"')), lambda t: t[1:-1] if len(t) > 1 and t[0] == t[-1] == '"' else None)


def entity(prefix: str) -> Kind:
    """IRIs ``<prefix/key>`` over a whole-number key."""
    pattern = re.compile(rf"<{re.escape(prefix)}/(0|-?[1-9]\d*)>")

    def parse(term: str) -> int | None:
        m = pattern.fullmatch(term)
        return int(m[1]) if m else None

    return Kind(prefix, lambda c: F.concat(F.lit(f"<{prefix}/"), c.cast("string"), F.lit(">")), parse)


def composite(prefix: str, names: tuple[str, ...]) -> Kind:
    """IRIs ``<prefix/a-b-c>`` over a struct of whole numbers."""
    pattern = re.compile(rf"<{re.escape(prefix)}/" + "-".join([r"(-?\d+)"] * len(names)) + ">")

    def render(c: Column) -> Column:
        # concat, unlike concat_ws, is null for an unbound value
        parts = [x for n in names for x in (F.lit("-"), c[n].cast("string"))][1:]
        return F.concat(F.lit(f"<{prefix}/"), *parts, F.lit(">"))

    def parse(term: str) -> tuple[int, ...] | None:
        m = pattern.fullmatch(term)
        return tuple(map(int, m.groups())) if m else None

    class _Composite(Kind):
        def equals(self, column: Column, term: str) -> Column | None:
            values = self.parse(term)
            if values is None:
                return None
            out = column[names[0]] == F.lit(values[0])
            for n, v in zip(names[1:], values[1:], strict=True):
                out = out & (column[n] == F.lit(v))
            return out

    return _Composite(prefix, render, parse)


def is_literal(term: Column) -> Column:
    return term.startswith('"')


def is_blank(term: Column) -> Column:
    return term.startswith("<_:")


def bare(term: Column) -> Column:
    """Text of a term: without angle brackets, or without quotes and language tag."""
    return F.when(term.startswith("<"), F.substring(term, F.lit(2), F.length(term) - 2)).when(term.startswith('"'), F.regexp_extract(term, r'(?s)^"(.*)"(?:@[^"]*)?$', 1)).otherwise(term)


def lang(term: Column) -> Column:
    return F.regexp_extract(term, r'(?s)^".*"@([^"]+)$', 1)


def unmarked(term: Column) -> Column:
    """The form that comparisons use: a leading quote goes, a trailing one stays."""
    return F.when(term.startswith('"') | term.startswith("'"), F.substring(term, F.lit(2), F.length(term))).otherwise(term)
