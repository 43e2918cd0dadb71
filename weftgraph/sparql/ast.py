"""Syntax trees.  Terms are strings in lexical form; variables are ``?name``, predicate paths are tuples."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

#: ("^", p), ("/", p, q), ("|", p, q), ("+", p), ("*", p), ("?", p), ("!", [iri or ("^", iri)])
Path = str | tuple


@dataclass
class Pattern:
    s: str
    p: Path
    o: str


@dataclass
class Expr:
    """``op`` over ``args``: operators and functions in lower case, "var" and "term" with a string."""

    op: str
    args: list[Any] = field(default_factory=list)
    distinct: bool = False


@dataclass
class Group:
    """A group's elements in order: Pattern, Filter, Optional_, Union, Minus, Bind, Values, Group, Select."""

    items: list[Any] = field(default_factory=list)


@dataclass
class Filter:
    expr: Expr


@dataclass
class Optional_:
    group: Group


@dataclass
class Union:
    groups: list[Group]


@dataclass
class Minus:
    group: Group


@dataclass
class Bind:
    expr: Expr
    var: str


@dataclass
class Values:
    vars: list[str]
    rows: list[list[str | None]]


@dataclass
class Select:
    """``items`` are variables or (expression, variable); None stands for ``*``."""

    where: Group
    items: list[Any] | None = None
    distinct: bool = False
    group_by: list[Any] = field(default_factory=list)
    having: list[Expr] = field(default_factory=list)
    order_by: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0


@dataclass
class Ask:
    where: Group


@dataclass
class Construct:
    template: list[Pattern]
    select: Select


def variables(node: Any) -> list[str]:
    """Variables that a pattern element binds, in order of first use."""
    out: dict[str, None] = {}

    def walk(x: Any) -> None:
        if isinstance(x, Pattern):
            for t in (x.s, x.p, x.o):
                if isinstance(t, str) and t.startswith("?"):
                    out[t] = None
        elif isinstance(x, Group):
            for i in x.items:
                walk(i)
        elif isinstance(x, Optional_):
            walk(x.group)
        elif isinstance(x, Union):
            for g in x.groups:
                walk(g)
        elif isinstance(x, Bind):
            out[x.var] = None
        elif isinstance(x, Values):
            out.update(dict.fromkeys(x.vars))
        elif isinstance(x, Select):
            if x.items is None:
                walk(x.where)
            else:
                out.update(dict.fromkeys(i if isinstance(i, str) else i[1] for i in x.items))

    walk(node)
    return [v for v in out if not v.startswith("?.")]
