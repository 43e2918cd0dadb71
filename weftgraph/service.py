"""A catalogue of saved graphs, its command language, and batches of queries."""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from weftgraph.graph import Graph
from weftgraph.operators import update
from weftgraph.plans.compile import query
from weftgraph.plans.stats import Stats
from weftgraph.sources.sinks import EMPTY, result_lines
from weftgraph.sources.turtle import ntriples_errors, read_ntriples, read_turtle, turtle_errors


class Catalog:
    """Graphs under one root folder, one loaded at a time.  Statistics are computed when first asked for."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.name: str | None = None
        self.graph: Graph | None = None
        self._stats: Stats | None = None

    def path(self, name: str) -> str:
        if not name or name.startswith(".") or "/" in name or name.endswith((".old", ".new")):
            raise ValueError(f"not a graph's name: {name!r}")
        return f"{self.root}/{name}"

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def show(self) -> list[str]:
        fs, p = self._fs(self.root)
        found = {s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()} if fs.exists(p) else set()
        # a swap that was cut short has left the old version beside its place
        for name in sorted(x.removesuffix(".old") for x in found if x.endswith(".old")):
            if name not in found:
                fs.rename(self._fs(f"{self.root}/{name}.old")[1], self._fs(f"{self.root}/{name}")[1])
                found.add(name)
        return sorted(x for x in found if not x.endswith((".old", ".new")))

    def build(self, name: str, rdf_path: str) -> DataFrame:
        """Read N-Triples (``.nt``) or Turtle and save it as graph ``name``; ``path, error`` of what was skipped."""
        read, errors = (read_ntriples, ntriples_errors) if rdf_path.rstrip("/").endswith(".nt") else (read_turtle, turtle_errors)
        Graph.of_triples(read(self.spark, rdf_path)).save_triples(self.path(name))
        return errors(self.spark, rdf_path)

    def load(self, name: str) -> None:
        if name not in self.show():
            raise ValueError(f"no graph {name!r}")
        self.name, self.graph, self._stats = name, Graph.load(self.spark, self.path(name)), None

    def unload(self, name: str | None = None) -> None:
        if name is not None and name != self.name:
            raise ValueError(f"{name!r} is not loaded")
        self.name = self.graph = self._stats = None

    def drop(self, name: str) -> None:
        if name == self.name:
            self.unload()
        fs, p = self._fs(self.path(name))
        fs.delete(p, True)

    def insert(self, name: str, rdf_path: str) -> None:
        read = read_ntriples if rdf_path.rstrip("/").endswith(".nt") else read_turtle
        update.append(self.path(name), read(self.spark, rdf_path))
        if name == self.name:
            self.load(name)

    def remove(self, name: str, gone: DataFrame) -> None:
        """Remove triples: the graph is written beside itself, then swapped in.  One of both versions always stands."""
        path = self.path(name)
        rest = Graph.of_triples(update.remove(Graph.load(self.spark, path).stored, gone), distinct=False)
        rest.save_triples(path + ".new")
        fs, p = self._fs(path)
        old = self._fs(path + ".old")[1]
        fs.delete(old, True)
        fs.rename(p, old)
        fs.rename(self._fs(path + ".new")[1], p)
        fs.delete(old, True)
        if name == self.name:
            self.load(name)

    @property
    def stats(self) -> Stats:
        if self.graph is None:
            raise ValueError("no graph is loaded")
        if self._stats is None:
            self._stats = Stats.of(self.graph)
        return self._stats

    def query(self, text: str, **options: Any) -> DataFrame:
        """Rows of a SELECT, planned with the graph's statistics unless ``stats`` says otherwise."""
        if self.graph is None:
            raise ValueError("no graph is loaded")
        return query(self.graph, text, **({"stats": self.stats} | options))

    def query_batch(self, texts: list[str], threads: int = 8, **options: Any) -> list[list]:
        """Rows of several queries that run side by side, in the order of ``texts``; the caller holds all of them."""
        with ThreadPoolExecutor(threads) as pool:
            return list(pool.map(lambda t: self.query(t, **options).collect(), texts))


#: command -> number of words it takes; the last one takes the rest of the line
COMMANDS = {"load": 1, "unload": 1, "import": 2, "insert": 2, "query": 1, "show": 1, "drop": 1}


def parse_command(line: str) -> tuple[str, list[str]]:
    words = line.strip().split(None, 1)
    if not words or words[0].lower() not in COMMANDS:
        raise ValueError(f"unknown command {line.strip()[:40]!r}")
    name = words[0].lower()
    args = words[1].split(None, COMMANDS[name] - 1) if len(words) > 1 else []
    if len(args) != COMMANDS[name]:
        raise ValueError(f"{name} takes {COMMANDS[name]} parameters")
    return name, args


def run_command(catalog: Catalog, line: str) -> str:
    name, args = parse_command(line)
    if name == "query":
        return "\n".join(r.value for r in result_lines(catalog.query(args[0])).toLocalIterator()) or EMPTY
    if name == "show":
        if args[0].lower() != "databases":
            raise ValueError("show takes 'databases'")
        return "\n".join(catalog.show())
    {"load": catalog.load, "unload": catalog.unload, "import": catalog.build, "insert": catalog.insert, "drop": catalog.drop}[name](*args)
    return f"{name} {args[0]}: done"


def read_query(path: str) -> str:
    with open(os.path.expanduser(path), encoding="utf-8") as f:
        return f.read()
