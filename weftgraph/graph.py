"""Graphs as vertical partitions: one lazy two-column DataFrame for each predicate.

Triples from text or Parquet share one table; a predicate is a filter on its partition column.  A
relational table gives one predicate for each mapped column, and patterns that share a subject are one
scan of that table (``Source.columns``), so column pruning and pushed filters reach the Parquet reader.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weftgraph.terms import TERM, Kind, is_literal


@dataclass(frozen=True)
class Attribute:
    """Object of a predicate: the plain value's column expression and its kind.  ``typed`` parses a literal
    constant to the source column's own type, so that the comparison can be pushed to the scan.  ``key_part`` is
    the field of a composite key that holds the same value, if one does."""

    value: Callable[[], Column]
    kind: Kind
    typed: Callable[[str], Column | None] | None = None
    key_part: str | None = None


@dataclass(frozen=True)
class Source:
    """A relation with a subject key; every attribute is one predicate.  ``rows`` is an estimate's base."""

    name: str
    frame: Callable[[], DataFrame]
    key: Callable[[], Column]
    kind: Kind
    attributes: Mapping[str, Attribute]


@dataclass
class Graph:
    """``sources`` are relational; ``triples(s, p, o)`` hold everything else, as terms without duplicates."""

    spark: SparkSession
    sources: list[Source] = field(default_factory=list)
    stored: DataFrame | None = None
    #: predicates of ``stored``, so an unknown one is an empty scan at once (None: not known)
    names: frozenset[str] | None = None
    stats: dict | None = None

    def source_of(self, predicate: str) -> Source | None:
        return next((s for s in self.sources if predicate in s.attributes), None)

    def predicates(self) -> list[str]:
        own = [p for s in self.sources for p in s.attributes]
        return own + sorted(self.names or ())

    def predicate(self, p: str) -> DataFrame:
        """``s, o`` of one predicate, as terms."""
        if (source := self.source_of(p)) is not None:
            a = source.attributes[p]
            rows = source.frame().select(source.key().alias("s"), a.value().alias("o")).where("o is not null")
            return rows.select(source.kind.render(F.col("s")).alias("s"), a.kind.render(F.col("o")).alias("o"))
        return self.stored_rows().where(F.col("p") == p).select("s", "o")

    def stored_rows(self) -> DataFrame:
        return self.stored if self.stored is not None else self.spark.createDataFrame([], "s string, p string, o string")

    @staticmethod
    def unpivoted(source: Source, predicates: list[str], rows: DataFrame | None = None) -> DataFrame:
        """``s, p, o`` of several predicates of one relation, as terms, in one scan of it."""
        pairs = [F.struct(F.lit(p).alias("p"), source.attributes[p].kind.render(source.attributes[p].value()).alias("o")) for p in predicates]
        out = (source.frame() if rows is None else rows).select(source.kind.render(source.key()).alias("s"), F.explode(F.array(*pairs)).alias("t"))
        return out.select("s", "t.p", "t.o").where("o is not null")

    def triples(self, predicates: list[str] | None = None) -> DataFrame:
        """``s, p, o`` of all (or some) predicates, as terms."""
        wanted = self.predicates() if predicates is None else predicates
        held = {source.name: (source, [p for p in source.attributes if p in wanted]) for source in self.sources}
        parts = [self.unpivoted(source, names) for source, names in held.values() if names]
        if self.stored is not None:
            rows = self.stored.select("s", "p", "o")
            parts.append(rows if predicates is None else rows.where(F.col("p").isin(list(predicates))))
        return reduce(DataFrame.unionAll, parts) if parts else self.stored_rows()

    @classmethod
    def of_triples(cls, triples: DataFrame, distinct: bool = True) -> Graph:
        """A graph over ``triples(s, p, o)``; duplicates go unless the caller knows that there are none."""
        rows = triples.select("s", "p", "o")
        return cls(triples.sparkSession, stored=rows.dropDuplicates() if distinct else rows)

    def save(self, path: str) -> None:
        """Parquet by predicate: a pattern's predicate then prunes whole folders."""
        Graph(self.spark, stored=self.triples()).save_triples(path)

    def save_triples(self, path: str) -> None:
        """As ``save``, for stored triples alone.  A frequent predicate is spread over files by subject."""
        rows = self.stored_rows().withColumn("o_is_literal", is_literal(F.col("o")))
        rows.repartition("p", F.pmod(F.xxhash64("s"), F.lit(16))).write.mode("overwrite").partitionBy("p").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Graph:
        """A saved graph.  Its predicates are read from the folder names, not from the data."""
        rows = spark.read.schema("s string, o string, o_is_literal boolean, p string").parquet(path)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = [f.getPath().getName() for f in fs.listStatus(folder) if f.isDirectory()]
        names = frozenset(unquote(x[2:]) for x in found if x.startswith("p="))
        return cls(spark, stored=rows.select("s", "p", "o"), names=names)


def whole_keys(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose plain key stands for a term: a composite key does if no part of it is null."""
    kind = rows.schema[column].dataType
    parts = [F.col(column)[n] for n in kind.fieldNames()] if isinstance(kind, StructType) else [F.col(column)]
    return rows.where(reduce(and_, [x.isNotNull() for x in parts]))


def kind_of(graph: Graph, predicate: str) -> tuple[Kind, Kind]:
    source = graph.source_of(predicate)
    return (source.kind, source.attributes[predicate].kind) if source else (TERM, TERM)
