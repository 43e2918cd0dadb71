"""Recursive-descent parser for SPARQL SELECT, ASK and CONSTRUCT; what it does not know it refuses by name."""

from __future__ import annotations

import re
from typing import Any

from weftgraph.sparql.ast import Ask, Bind, Construct, Expr, Filter, Group, Minus, Optional_, Path, Pattern, Select, Union, Values

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
#: Keywords that are known to the language but not supported.
REFUSED = ("describe", "graph", "service", "from", "insert", "delete", "load", "clear", "drop", "create", "add", "move", "copy", "with", "using", "bindings")
AGGREGATES = ("count", "sum", "avg", "min", "max", "sample", "group_concat")
_TOKENS = re.compile(
    r"""(?P<space>[\s]+|\#[^\n]*)
      | (?P<iri><[^<>"{}|^`\\\s]*>)
      | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<var>[?$]\w+)
      | (?P<blank>_:[\w.-]*\w)
      | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
      | (?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
      | (?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%-]|[.:](?=[\w:%-]))*|[A-Za-z_][\w-]*)
      | (?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/|^?-])""",
    re.X | re.S,
)
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)
_PLAIN = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


class SparqlError(ValueError):
    pass


def unescaped(text: str) -> str:
    return _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if m[1][0] in "uU" and len(m[1]) > 1 else _PLAIN.get(m[1], m[1]), text)


def string_of(token: str) -> str:
    n = 3 if token[:3] in ('"""', "'''") else 1
    return unescaped(token[n:-n])


class Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if m is None:
                raise SparqlError(f"cannot read the query at {text[at : at + 20]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup or "", m[0]))
            at = m.end()
        self.tokens.append(("end", ""))
        self.at = 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.fresh = 0

    # tokens

    def peek(self, ahead: int = 0) -> str:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)][1]

    def kind(self) -> str:
        return self.tokens[self.at][0]

    def word(self, ahead: int = 0) -> str:
        kind, text = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return text.lower() if kind == "name" and ":" not in text else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.kind() == "op" or self.word() in wanted and self.word():
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise SparqlError(f"expected {wanted!r} before {self.peek()!r}")

    def next(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    # terms

    def iri(self) -> str:
        kind, text = self.tokens[self.at]
        if kind == "iri":
            self.at += 1
            body = unescaped(text[1:-1])
            return f"<{self.base + body if self.base and '://' not in body[:10] else body}>"
        if kind == "name" and ":" in text:
            self.at += 1
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{local}>"
        raise SparqlError(f"expected an IRI before {text!r}")

    def variable(self) -> str:
        if self.kind() != "var":
            raise SparqlError(f"expected a variable before {self.peek()!r}")
        return "?" + self.next()[1:]

    def term(self, numbers: bool = False) -> str:
        """A variable or a constant; a number is a literal in patterns and bare in expressions."""
        kind, text = self.tokens[self.at]
        if kind == "var":
            return self.variable()
        if kind == "string":
            self.at += 1
            body = f'"{string_of(text)}"'
            if self.kind() == "lang":
                return body + self.next()
            if self.take("^^"):
                self.iri()  # datatypes are not stored
            return body
        if kind == "number" or text in ("-", "+") and self.tokens[self.at + 1][0] == "number":
            sign = self.next() if kind != "number" else ""
            value = ("-" if sign == "-" else "") + self.next()
            return value if numbers else f'"{value}"'
        if self.word() in ("true", "false"):
            value = self.next().lower()
            return value if numbers else f'"{value}"'
        if kind == "blank":
            return "?._" + self.next()[2:]
        return self.iri()

    # patterns

    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.word() == "select":
            out.items.append(self.select())
            self.need("}")
            return out
        while not self.take("}"):
            word = self.word()
            if word in REFUSED:
                raise SparqlError(f"{word.upper()} is not supported")
            if self.take("optional"):
                out.items.append(Optional_(self.group()))
            elif self.take("minus"):
                out.items.append(Minus(self.group()))
            elif self.take("filter"):
                out.items.append(Filter(self.constraint()))
            elif self.take("bind"):
                self.need("(")
                expr = self.expression()
                self.need("as")
                out.items.append(Bind(expr, self.variable()))
                self.need(")")
            elif self.take("values"):
                out.items.append(self.values())
            elif self.peek() == "{":
                groups = [self.group()]
                while self.take("union"):
                    groups.append(self.group())
                out.items.append(Union(groups) if len(groups) > 1 else groups[0])
            elif self.kind() == "end":
                raise SparqlError("expected '}' before the end")
            else:
                self.triples(out.items)
            self.take(".")
        return out

    def values(self) -> Values:
        one = self.kind() == "var"
        names = [self.variable()] if one else []
        if not one:
            self.need("(")
            while not self.take(")"):
                names.append(self.variable())
        self.need("{")
        rows: list[list[str | None]] = []
        cell = lambda: None if self.take("undef") else self.term()
        while not self.take("}"):
            if one:
                rows.append([cell()])
                continue
            self.need("(")
            row = []
            while not self.take(")"):
                row.append(cell())
            rows.append(row)
        if any(len(r) != len(names) for r in rows):
            raise SparqlError("VALUES rows differ in length")
        return Values(names, rows)

    def blank(self) -> str:
        self.fresh += 1
        return f"?._{self.fresh}"

    def node(self, out: list[Any]) -> str:
        """A term, ``[...]`` or ``(...)``; blank nodes of a query are variables that are not returned."""
        if self.take("["):
            name = self.blank()
            if not self.take("]"):
                self.properties(name, out)
                self.need("]")
            return name
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = f"<{RDF}nil>"
            for item in reversed(items):
                name = self.blank()
                out += [Pattern(name, f"<{RDF}first>", item), Pattern(name, f"<{RDF}rest>", head)]
                head = name
            return head
        return self.term()

    def triples(self, out: list[Any]) -> None:
        bracket = self.peek() == "["
        s = self.node(out)
        if bracket and self.peek() in (".", "}"):
            return
        self.properties(s, out)

    def properties(self, s: str, out: list[Any]) -> None:
        while True:
            p = self.path()
            while True:
                out.append(Pattern(s, p, self.node(out)))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek() in (".", "]", "}"):
                return

    def path(self) -> Path:
        if self.kind() == "var":
            return self.variable()
        out = self.path_sequence()
        while self.take("|"):
            out = ("|", out, self.path_sequence())
        return out

    def path_sequence(self) -> Path:
        out = self.path_step()
        while self.take("/"):
            out = ("/", out, self.path_step())
        return out

    def path_step(self) -> Path:
        if self.take("^"):
            return ("^", self.path_step())
        if self.take("!"):
            names = []
            many = self.take("(")
            while True:
                back = self.take("^")
                p = self.path_name()
                names.append(("^", p) if back else p)
                if not many or not self.take("|"):
                    break
            if many:
                self.need(")")
            return ("!", names)
        if self.take("("):
            out = self.path()
            self.need(")")
        else:
            out = self.path_name()
        for mark in ("+", "*", "?"):
            if self.peek() == mark and self.kind() == "op":
                self.at += 1
                return (mark, out)
        return out

    def path_name(self) -> str:
        if self.word() == "a":
            self.at += 1
            return f"<{RDF}type>"
        return self.iri()

    # expressions

    def constraint(self) -> Expr:
        if self.peek() == "(":
            self.at += 1
            out = self.expression()
            self.need(")")
            return out
        return self.primary()

    def expression(self) -> Expr:
        return self._chain(("||",), lambda: self._chain(("&&",), self.relation))

    def _chain(self, ops: tuple[str, ...], inner: Any) -> Expr:
        out = inner()
        while self.kind() == "op" and self.peek() in ops:
            op = self.next()
            out = Expr(op, [out, inner()])
        return out

    def relation(self) -> Expr:
        out = self.sum()
        if self.kind() == "op" and self.peek() in ("=", "!=", "<", "<=", ">", ">="):
            op = self.next()
            return Expr(op, [out, self.sum()])
        negated = self.word() == "not" and self.word(1) == "in"
        if negated or self.word() == "in":
            self.at += 1 + negated
            self.need("(")
            args = [out]
            while not self.take(")"):
                args.append(self.expression())
                self.take(",")
            return Expr("notin" if negated else "in", args)
        return out

    def sum(self) -> Expr:
        return self._chain(("+", "-"), lambda: self._chain(("*", "/"), self.unary))

    def unary(self) -> Expr:
        if self.take("!"):
            return Expr("!", [self.unary()])
        if self.peek() == "-" and self.kind() == "op" and self.tokens[self.at + 1][0] != "number":
            self.at += 1
            return Expr("neg", [self.unary()])
        if self.peek() == "+" and self.kind() == "op":
            self.at += 1
            return self.unary()
        return self.primary()

    def primary(self) -> Expr:
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        word = self.word()
        if word == "exists" or word == "not" and self.word(1) == "exists":
            self.at += 1 + (word == "not")
            return Expr("exists" if word == "exists" else "notexists", [self.group()])
        if word and word not in ("true", "false"):
            if self.peek(1) != "(":
                raise SparqlError(f"expected an expression before {self.peek()!r}")
            self.at += 2
            out = Expr(word, distinct=self.take("distinct"))
            if word == "count" and self.take("*"):
                self.need(")")
                return Expr("count", [], out.distinct)
            while not self.take(")"):
                if self.take(";"):
                    if not self.take("separator"):
                        raise SparqlError("expected SEPARATOR")
                    self.need("=")
                    out.args.append(Expr("term", [self.term()]))
                    continue
                out.args.append(self.expression())
                self.take(",")
            return out
        term = self.term(numbers=True)
        return Expr("var" if term.startswith("?") else "term", [term])

    # queries

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct", "reduced")
        items: list[Any] | None = []
        if self.take("*"):
            items = None
        else:
            while self.kind() == "var" or self.peek() == "(":
                if self.kind() == "var":
                    items.append(self.variable())
                    continue
                self.need("(")
                expr = self.expression()
                self.need("as")
                items.append((expr, self.variable()))
                self.need(")")
            if not items:
                raise SparqlError("SELECT needs variables or *")
        self._no_dataset()
        self.take("where")
        out = Select(self.group(), items, distinct)
        self.modifiers(out)
        return out

    def _no_dataset(self) -> None:
        if self.word() in REFUSED:
            raise SparqlError(f"{self.word().upper()} is not supported")

    def modifiers(self, out: Select) -> None:
        while True:
            if self.word() == "group":
                self.at += 1
                self.need("by")
                while self.kind() == "var" or self.peek() == "(" or self.word() not in ("", "having", "order", "limit", "offset", "values") and self.peek(1) == "(":
                    if self.kind() == "var":
                        out.group_by.append(self.variable())
                        continue
                    if self.take("("):
                        expr = self.expression()
                        name = self.variable() if self.take("as") else self.blank()
                        self.need(")")
                    else:
                        expr, name = self.primary(), self.blank()
                    out.group_by.append((expr, name))
            elif self.take("having"):
                out.having.append(self.constraint())
                while self.peek() == "(":
                    out.having.append(self.constraint())
            elif self.word() == "order":
                self.at += 1
                self.need("by")
                while True:
                    if self.word() in ("asc", "desc"):
                        up = self.next().lower() == "asc"
                        self.need("(")
                        out.order_by.append((self.expression(), up))
                        self.need(")")
                    elif self.kind() == "var":
                        out.order_by.append((Expr("var", [self.variable()]), True))
                    elif self.peek() == "(":
                        out.order_by.append((self.constraint(), True))
                    else:
                        break
            elif self.word() in ("limit", "offset"):
                word = self.next().lower()
                if self.kind() != "number":
                    raise SparqlError(f"{word.upper()} needs a number")
                setattr(out, word, int(self.next()))
            else:
                break
        if self.take("values"):
            out.where.items.append(self.values())

    def query(self) -> Select | Ask | Construct:
        while self.word() in ("prefix", "base"):
            if self.next().lower() == "base":
                self.base = unescaped(self.next()[1:-1])
                continue
            name = self.next()
            if not name.endswith(":"):
                raise SparqlError(f"a prefix ends with ':', not {name!r}")
            self.prefixes[name[:-1]] = self.iri()[1:-1]
        word = self.word()
        if word == "select":
            out: Any = self.select()
        elif self.take("ask"):
            self._no_dataset()
            self.take("where")
            out = Ask(self.group())
        elif self.take("construct"):
            template: list[Any] = []
            short = self.take("where")
            self.need("{")
            while not self.take("}"):
                self.triples(template)
                self.take(".")
            if short:
                select = Select(Group(list(template)))
            else:
                self._no_dataset()
                self.take("where")
                select = Select(self.group())
            self.modifiers(select)
            out = Construct(template, select)
        elif word in REFUSED:
            raise SparqlError(f"{word.upper()} is not supported")
        else:
            raise SparqlError(f"expected SELECT, ASK or CONSTRUCT before {self.peek()!r}")
        if self.kind() != "end":
            raise SparqlError(f"unexpected {self.peek()!r} after the query")
        return out


def parse(text: str) -> Select | Ask | Construct:
    return Parser(text).query()
