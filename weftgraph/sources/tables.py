"""The relational tables of TESTDATA.md as a graph: rows are entities, columns are predicates.

Key columns are declared unique; rows of equal key would be one entity whose columns pair up by row.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from weftgraph.graph import Attribute, Graph, Source
from weftgraph.terms import LITERAL, composite, entity

REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDER, EVENT, DOC = (entity(x) for x in ("region", "nation", "customer", "supplier", "part", "order", "event", "doc"))
LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
LINEITEM = composite("lineitem", LINE_KEY)

#: table -> key kind, key columns, columns that point to another table's key, columns that are literals
TABLES = {
    "region": (REGION, ("r_regionkey",), {}, ("r_name",)),
    "nation": (NATION, ("n_nationkey",), {"n_regionkey": REGION}, ("n_name",)),
    "customer": (CUSTOMER, ("c_custkey",), {"c_nationkey": NATION}, ("c_name", "c_acctbal", "c_mktsegment")),
    "supplier": (SUPPLIER, ("s_suppkey",), {"s_nationkey": NATION}, ("s_name", "s_acctbal")),
    "part": (PART, ("p_partkey",), {}, ("p_name", "p_brand", "p_type", "p_size", "p_retailprice")),
    "orders": (ORDER, ("o_orderkey",), {"o_custkey": CUSTOMER}, ("o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")),
    "lineitem": (LINEITEM, LINE_KEY, {"l_orderkey": ORDER, "l_partkey": PART, "l_suppkey": SUPPLIER}, ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")),
    "events": (EVENT, ("event_id",), {"user_id": CUSTOMER}, ("event_type", "value", "ts")),
    "documents": (DOC, ("doc_id",), {}, ("lang", "source", "n_chars")),
    "labels": (DOC, ("doc_id",), {}, ("quality", "toxic")),
}


def _key(columns: tuple[str, ...]) -> Column:
    return F.col(columns[0]) if len(columns) == 1 else F.struct(*[F.col(c).cast("long").alias(c) for c in columns])


def _literal(frame: Callable[[], DataFrame], column: str) -> Attribute:
    kind = lambda: frame().schema[column].dataType.typeName()

    def typed(text: str) -> Column | None:
        if kind() in ("integer", "long", "short") and text.lstrip("-").isdigit() and str(int(text)) == text:
            return F.col(column) == F.lit(int(text))
        return F.col(column) == F.lit(text) if kind() == "string" else None

    return Attribute(lambda: F.col(column) if kind() == "string" else F.col(column).cast("string"), LITERAL, typed)


def tables_graph(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] | None = None) -> Graph:
    """Nothing is read here; a table's schema is read when a query first needs the table."""
    sources = []
    for name in tables or tuple(TABLES):
        kind, key, links, literals = TABLES[name]
        frame = cache(partial(spark.read.parquet, os.path.join(sf_dir, f"{name}.parquet")))
        attributes = {c: Attribute(lambda c=c: F.col(c).cast("long"), k, key_part=c if len(key) > 1 and c in key else None) for c, k in links.items()} | {c: _literal(frame, c) for c in literals}
        sources.append(Source(name, frame, lambda k=key: _key(k), kind, {f"<{c}>": a for c, a in attributes.items()}))
    return Graph(spark, sources)
