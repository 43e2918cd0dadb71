"""Turtle and N-Triples text.

N-Triples lines stand alone, so they are split by Spark's text reader and a regular expression on the
JVM.  Turtle carries state from statement to statement (prefixes, blank nodes), so each file, or string,
is parsed by one task.  A broken statement is reported and the rest of its line skipped; parsing goes on.
Stored terms: ``<iri>``, ``<_:blank>``, ``"text"`` and ``"text"@lang``; datatypes are dropped.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.sparql.parser import RDF, string_of, unescaped

TRIPLES = "s string, p string, o string"
ERRORS = "path string, error string"
_SPACE = re.compile(r"(?:\s+|#[^\n]*)*")
_TOKEN = re.compile(
    r"""(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\.)*>)
      | (?P<string>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
      | (?P<blank>_:[\w.-]*[\w-])
      | (?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
      | (?P<number>[+-]?(?:\d+\.\d+|\.\d+|\d+)(?:[eE][+-]?\d+)?)
      | (?P<name>[\w-]*(?:\.[\w-]+)*:(?:[\w%-]|\\.|[.:](?=[\w:%-]))*|[A-Za-z]+)
      | (?P<op>\^\^|[.;,\[\]()])""",
    re.X | re.S,
)


class TurtleError(ValueError):
    pass


class TurtleParser:
    """``parse(text)`` yields triples; prefixes and the base stay for the next call.  ``errors`` collects complaints."""

    def __init__(self, label: str = ""):
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.errors: list[str] = []
        self.label, self.count = label, 0

    def parse(self, text: str) -> Iterator[tuple[str, str, str]]:
        self.text, self.at = text, 0
        while True:
            self.at = _SPACE.match(text, self.at).end()
            if self.at >= len(text):
                return
            self.out: list[tuple[str, str, str]] = []
            start = self.at
            try:
                self.statement()
            except TurtleError as e:
                line = text.count("\n", 0, self.at) + 1
                self.errors.append(f"line {line}: {e}")
                end = text.find("\n", max(self.at, start + 1) - 1)
                self.at = len(text) if end < 0 else end + 1
                continue
            yield from self.out

    # tokens

    def peek(self) -> tuple[str, str]:
        self.at = _SPACE.match(self.text, self.at).end()
        m = _TOKEN.match(self.text, self.at)
        return (m.lastgroup or "", m[0]) if m else ("end", "")

    def next(self) -> tuple[str, str]:
        kind, text = self.peek()
        if kind == "end":
            raise TurtleError(f"cannot read {self.text[self.at : self.at + 20]!r}")
        self.at += len(text)
        return kind, text

    def take(self, op: str) -> bool:
        kind, text = self.peek()
        if kind == "op" and text == op:
            self.at += len(text)
            return True
        return False

    def need(self, op: str) -> None:
        if not self.take(op):
            raise TurtleError(f"expected {op!r} before {self.text[self.at : self.at + 20]!r}")

    def fresh(self) -> str:
        self.count += 1
        return f"<_:_{self.label}{self.count}>"

    # grammar

    def statement(self) -> None:
        kind, text = self.peek()
        word = text.lower()
        if kind == "lang" and word in ("@prefix", "@base") or kind == "name" and word in ("prefix", "base"):
            self.next()
            if word.endswith("prefix"):
                kind, name = self.next()
                if kind != "name" or not name.endswith(":"):
                    raise TurtleError(f"a prefix ends with ':', not {name!r}")
                self.prefixes[name[:-1]] = self.iri(*self.next())[1:-1]
            else:
                self.base = self.iri(*self.next())[1:-1]
            if word.startswith("@"):
                self.need(".")
            return
        bracket = kind == "op" and text == "["
        s = self.subject()
        if not (bracket and self.peek() == ("op", ".")):
            self.properties(s)
        self.need(".")

    def subject(self) -> str:
        kind, text = self.peek()
        if kind == "op":
            return self.object()
        self.next()
        return self.blank(text) if kind == "blank" else self.iri(kind, text)

    def blank(self, text: str) -> str:
        # a label names one node within its text only
        return f"<_:{self.label}{text[2:]}>"

    def iri(self, kind: str, text: str) -> str:
        if kind == "iri":
            body = unescaped(text[1:-1])
            return f"<{self.base + body if self.base and '://' not in body[:10] else body}>"
        if kind == "name" and ":" in text:
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise TurtleError(f"unknown prefix {prefix!r}")
            return f"<{self.prefixes[prefix]}{unescaped(local)}>"
        raise TurtleError(f"expected an IRI, not {text!r}")

    def object(self) -> str:
        kind, text = self.next()
        if kind == "string":
            body = f'"{string_of(text)}"'
            if self.peek()[0] == "lang":
                return body + self.next()[1]
            if self.take("^^"):
                self.iri(*self.next())
            return body
        if kind == "number" or kind == "name" and text in ("true", "false"):
            return f'"{text}"'
        if kind == "blank":
            return self.blank(text)
        if text == "[":
            node = self.fresh()
            if not self.take("]"):
                self.properties(node)
                self.need("]")
            return node
        if text == "(":
            items = []
            while not self.take(")"):
                items.append(self.object())
            head = f"<{RDF}nil>"
            for item in reversed(items):
                node = self.fresh()
                self.out += [(node, f"<{RDF}first>", item), (node, f"<{RDF}rest>", head)]
                head = node
            return head
        return self.iri(kind, text)

    def properties(self, s: str) -> None:
        while True:
            kind, text = self.next()
            p = f"<{RDF}type>" if (kind, text) == ("name", "a") else self.iri(kind, text)
            while True:
                self.out.append((s, p, self.object()))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek() in (("op", "."), ("op", "]")):
                return


def parse_text(spark: SparkSession, text: str, parser: TurtleParser | None = None) -> DataFrame:
    """Triples of a Turtle string; pass the same parser again to carry its prefixes over."""
    return spark.createDataFrame(list((parser or TurtleParser()).parse(text)), TRIPLES)


def _files(errors: bool):
    """Triples of whole texts, or with ``errors`` the complaints about them."""
    names = ["path", "error"] if errors else ["s", "p", "o"]
    batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(batch.column("path").to_pylist(), batch.column("value").to_pylist(), strict=True):
                rows: list[tuple] = []
                # labels of other files are other nodes
                parser = TurtleParser(f"{zlib.crc32(path.encode()):x}_")
                for t in parser.parse(text or ""):
                    if errors:
                        continue
                    rows.append(t)
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
                rows += [(path, e) for e in parser.errors] if errors else []
                if rows:
                    yield batch_of(rows)

    return run


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def read_turtle(spark: SparkSession, path: str) -> DataFrame:
    """Triples of Turtle files: one task for each file, as Turtle cannot be split.  ``turtle_errors`` tells what was skipped."""
    return _texts(spark, path).mapInArrow(_files(False), TRIPLES)


def turtle_errors(spark: SparkSession, path: str) -> DataFrame:
    """``path, error`` of every statement that ``read_turtle`` skips."""
    return _texts(spark, path).mapInArrow(_files(True), ERRORS)


_IRI = r"<[^<>\"{}|^`\x00-\x20]*>"
_NODE = rf"{_IRI}|_:[\w.-]*[\w-]"
_TEXT = r"\"(?:[^\"\\]|\\.)*\""
LINE = rf"^\s*({_NODE})\s*({_IRI})\s*(?:({_NODE})|({_TEXT})(?:(@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)|\^\^{_IRI})?)\s*\.\s*(?:#.*)?$"


def _plain(text: Column) -> Column:
    """A literal without escapes.  \\u escapes are left to Python's parser and are rare."""

    def simple(part: Column) -> Column:
        for code, char in (("t", "\t"), ("n", "\n"), ("r", "\r"), ("b", "\b"), ("f", "\f"), ('"', '"'), ("'", "'")):
            part = F.replace(part, F.lit("\\" + code), F.lit(char))
        return part

    # an escaped backslash begins no other escape
    parts = F.transform(F.split(text, r"\\\\", -1), simple)
    return F.when(text.contains("\\"), F.array_join(parts, "\\")).otherwise(text)


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Triples of N-Triples files, split and parsed by many tasks; ``ntriples_errors`` tells which lines don't parse."""
    return ntriples(_lines(spark, path))


def ntriples_errors(spark: SparkSession, path: str) -> DataFrame:
    """``path, error`` of every line that ``read_ntriples`` skips."""
    return corrupt(_lines(spark, path)).select("path", F.concat(F.lit("not a triple: "), F.substring("value", 1, 200)).alias("error"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.input_file_name().alias("path"))


def ntriples(lines: DataFrame) -> DataFrame:
    """Triples of a DataFrame of N-Triples lines in ``value``.

    A blank node's label names one node within its ``path``, if there is such a column, else within all lines.
    """
    named = F.concat(F.lower(F.hex(F.crc32(F.col("path").cast("binary")))), F.lit("_")) if "path" in lines.columns else F.lit("")
    lines = lines.select("value", named.alias("label"))
    part = lambda i: F.regexp_extract("value", LINE, i)
    parts = lines.where(~F.col("value").rlike(r"\\[uU]") & F.col("value").rlike(LINE)).select("label", *[part(i).alias(n) for i, n in enumerate(("s", "p", "node", "text", "lang"), 1)])
    node = lambda c: F.when(c.startswith("_:"), F.concat(F.lit("<_:"), F.col("label"), F.substring(c, F.lit(3), F.length(c)), F.lit(">"))).otherwise(c)
    plain = parts.select(node(F.col("s")).alias("s"), "p", F.when(F.col("node") != "", node(F.col("node"))).otherwise(F.concat(_plain(F.col("text")), F.col("lang"))).alias("o"))
    coded = lines.where(F.col("value").rlike(r"\\[uU]")).mapInArrow(_coded, TRIPLES)
    return plain.unionByName(coded)


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [t for line, label in zip(batch.column("value").to_pylist(), batch.column("label").to_pylist(), strict=True) for t in TurtleParser(label).parse(line)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["s", "p", "o"])


def corrupt(lines: DataFrame) -> DataFrame:
    """The N-Triples lines that are neither a triple, a comment nor blank."""
    return lines.where(~F.col("value").rlike(LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))
