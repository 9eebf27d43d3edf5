"""Session setup, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A table is broadcast only if its rows, as measured, stay below this.
BROADCAST_BYTES = 256 * 1024 * 1024
# Text that one task takes apart: its terms and their counts need some 25 times as much.
TASK_TEXT_BYTES = 16 * 1024 * 1024


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("recordlens")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names; a scratch folder only in local mode."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not _is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="recordlens-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder; readers survive executor loss."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder for a table this run writes."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table below the shared folder, compressed by column."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_tasks(spark: SparkSession, size: int | None) -> int:
    """Shuffle partitions for the terms of ``size`` bytes of text: never fewer than are set."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // TASK_TEXT_BYTES))


@contextmanager
def shuffle_partitions(spark: SparkSession, n: int) -> Iterator[None]:
    """Aggregates and joins that run inside are dealt out to ``n`` partitions."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def broadcast_if_small(df: DataFrame, payload: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its measured size allows it; else it joins by shuffle.

    ``payload`` is the byte size of a row's variable part. ``df`` should be cheap to read.
    """
    size = df.agg(F.sum(payload.cast("long") + F.lit(64))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df
