"""Connected components of a link table.

Tasks first reduce their share of the links to a forest of stars, each by union-find over at most about
LINKS_A_TASK links.  One task's forest is the answer; several tasks' forests are joined by alternating
large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from weftgraph.llm.shared import in_arrow, written

LINKS_A_TASK = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``a, b``: every node of the task's links but roots, with the least node it is linked to."""
    up: dict[bytes, bytes] = {}

    def root(x: bytes) -> bytes:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    rows = [(x, root(x)) for x in list(up)]
    rows = [r for r in rows if r[0] != r[1]]
    for at in range(0, len(rows), 1 << 16):
        a, b = zip(*rows[at : at + (1 << 16)], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    # the join spreads a hub's links over tasks; only its least neighbour is aggregated
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, label`` (the least node of its component) of all nodes in ``links(a, b)``, which are binary.

    Rounds end when a round changes no link, after O(log^2 n) of them; stars end after one.  Every round
    is a written table, so lost executors cost at most one round.  An empty table has no components.
    """
    tasks = -(-links.count() // LINKS_A_TASK)
    now = written(in_arrow(links.select("a", "b").repartition(max(1, tasks)), _forest, "a binary, b binary"), "forest")
    before = None
    while tasks > 1:
        now = written(_small_star(_large_star(now)), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
