"""Scratch tables in the folder that driver and executors share, and small session helpers."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A table of so many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Parts in which a key that is too frequent for one task is dealt, where its rows can't be broadcast.
PARTS = 64
#: Bytes of one Arrow batch sent to a Python worker, and the setting of the session for it.
BATCH_BYTES, BATCH_SETTING = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, or a temporary folder on a local master.

    A machine-local folder would not be seen by other executors, so a cluster without the setting is
    an error rather than a silent fallback.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/weft-scratch-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application (call it once results have been stored)."""
    jvm, path = spark._jvm, f"{shared_dir(spark)}/weft-scratch-{spark.sparkContext.applicationId}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """``names`` with as many underscores in front as keep them apart from ``columns``, whatever their case."""
    taken = {c.lower() for c in columns}
    lead = "_"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]


def trim() -> None:
    """Give this process's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    if found := getattr(ctypes.CDLL(None), "malloc_trim", None):
        found(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the Python worker, which stays for other tasks, is trimmed."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return wrapped


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: object) -> DataFrame:
    """``df.mapInArrow`` by batches of at most BATCH_BYTES (or one longer row), trimmed at a task's end.

    Spark's own bound is 64 MB, which executor and worker each hold several times over.  The plan reads the
    setting when it runs, so the session keeps it; a lower one of the caller's stays.
    """
    spark = df.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_SETTING)) > BATCH_BYTES:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(released(run), schema)


def join_spread(rows: DataFrame, few: DataFrame, key: str, spread_by: list[str], frequent: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``few`` (one row for each ``key``), where some keys may have a large share of all rows.

    ``frequent`` holds those rows of ``few``; ``few`` the others only.  Frequent ones are broadcast if there are
    at most BROADCAST_ROWS, else copied to PARTS parts among which ``spread_by`` deals the rows.
    """
    if frequent is None:
        return rows.join(few, key)
    if frequent.count() <= BROADCAST_ROWS:
        frequent = F.broadcast(frequent)
        return rows.join(frequent, key).unionByName(rows.join(F.broadcast(frequent.select(key)), key, "left_anti").join(few, key))
    (part,) = fresh([*rows.columns, *few.columns], "part")
    dealt = rows.withColumn(part, F.pmod(F.xxhash64(*spread_by), F.lit(PARTS)))
    copies = frequent.withColumn(part, F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)).cast("array<long>")))
    rest = dealt.join(copies.select(key, part), [key, part], "left_anti").drop(part)
    return dealt.join(copies, [key, part]).drop(part).unionByName(rest.join(few, key))
