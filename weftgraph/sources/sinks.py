"""Text output: results, the six-tuple dump, and the integer re-encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weftgraph.graph import Graph
from weftgraph.operators.dictionary import LITERAL_FIRST_ID, dictionary, encode, encode_tables

EMPTY = "[empty result]"


def result_lines(df: DataFrame) -> DataFrame:
    """``value``: the fields of each row joined by a space; unbound prints a tab."""
    return df.select(F.concat_ws(" ", *[F.coalesce(df[c].cast("string"), F.lit("\t")) for c in df.columns]).alias("value"))


def write_result(df: DataFrame, path: str) -> None:
    lines = result_lines(df)
    if lines.isEmpty():
        lines = df.sparkSession.createDataFrame([(EMPTY,)], "value string")
    lines.write.mode("overwrite").text(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """One ``s<tab>p<tab>o.`` line for each triple."""
    triples.select(F.concat(F.concat_ws("\t", "s", "p", "o"), F.lit(".")).alias("value")).write.mode("overwrite").text(path)


def six_tuples(triples: DataFrame) -> DataFrame:
    """``s_id, p_id, o_id, s, p, o`` of every triple."""
    return encode(triples, dictionary(triples))


def six_tuples_of_tables(graph: Graph, predicates: list[str]) -> DataFrame:
    """As ``six_tuples`` of the distinct triples of relational tables."""
    o_id = F.when(F.col("literal"), F.col("o_id") + LITERAL_FIRST_ID).otherwise(F.col("o_id"))
    return encode_tables(graph, predicates).triples.select("s_id", "p_id", o_id.alias("o_id"), "s", "p", "o")


def write_six_tuples(triples: DataFrame, path: str) -> None:
    six_tuples(triples).write.mode("overwrite").csv(path, sep="\t", quote="", escape="")


def reencoded(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``<s> <p> <o> .`` lines over ids, the predicate dictionary ``name, id``, and ``edges, nodes`` counts.

    Nodes (entities and literals alike) share one id space, predicates have their own.
    """
    nodes = dictionary(triples.select("s", F.lit("<p>").alias("p"), F.col("o"))).where("kind <> 'predicate'")
    entities = nodes.where("kind = 'entity'").count()
    nodes = nodes.select("term", F.when(F.col("kind") == "literal", F.col("id") + entities).otherwise(F.col("id")).alias("id"))
    names = dictionary(triples).where("kind = 'predicate'").select(F.col("term").alias("name"), "id")
    rows = triples.join(nodes.select(F.col("term").alias("s"), F.col("id").alias("si")), "s")
    rows = rows.join(nodes.select(F.col("term").alias("o"), F.col("id").alias("oi")), "o")
    rows = rows.join(names.select(F.col("name").alias("p"), F.col("id").alias("pi")), "p")
    box = lambda c: F.concat(F.lit("<"), F.col(c).cast("string"), F.lit(">"))
    lines = rows.select(F.concat_ws(" ", box("si"), box("pi"), box("oi"), F.lit(".")).alias("value"))
    counts = triples.agg(F.count(F.lit(1)).alias("edges")).crossJoin(nodes.agg(F.count(F.lit(1)).alias("nodes")))
    return lines, names, counts


def reencoded_tables(graph: Graph, predicates: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``reencoded`` of the distinct triples of relational tables."""
    found = encode_tables(graph, predicates, text=False)
    o_id = F.when(F.col("literal"), F.col("o_id") + found.entities).otherwise(F.col("o_id"))
    line = F.concat(F.lit("<"), F.col("s_id").cast("string"), F.lit("> <"), F.col("p_id").cast("string"), F.lit("> <"), o_id.cast("string"), F.lit("> ."))
    names = graph.spark.createDataFrame(list(found.predicates.items()), "name string, id long")
    counts = found.triples.agg(F.count(F.lit(1)).alias("edges")).withColumn("nodes", F.lit(found.entities + found.literals))
    return found.triples.select(line.alias("value")), names, counts


def predicate_names(lines: DataFrame) -> DataFrame:
    """Distinct second field of text lines."""
    return lines.select(F.get(F.split(F.trim("value"), r"\s+"), 1).alias("p")).where("p is not null").distinct()
