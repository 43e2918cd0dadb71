"""Labelled rows for the classifiers: a bounded, reproducible sample outside the held-out fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from weftgraph.llm.shared import written

#: A classifier is fitted on at most so many labelled rows; more are drawn down by a hash of doc_id.
TRAIN_ROWS = 20_000
FOLDS = 5


def held_out(doc_id: Column | str) -> Column:
    """Whether crc32 of the id's text is a multiple of FOLDS; a null id is held out, as it has no label."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int = TRAIN_ROWS) -> DataFrame:
    """``id, text, y`` of at most ``limit`` labelled rows that are not held out, written once.

    The sampled ids (at most ``limit``, so the broadcast is bounded) meet the documents without a
    shuffle.  Of several labels of a document the greatest counts; null labels are none.
    """
    ids = labels.select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("y")).where("doc_id is not null and y is not null")
    ids = ids.where(~held_out("doc_id")).groupBy("doc_id").agg(F.max("y").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), F.col("id") == F.col("doc_id"))
    return written(rows.select("id", "text", "y"), "labelled")
