"""Label drift and review routing over a stream of labelled, timed rows.

Rows are counted by event-time window and label under a watermark; rows that come later
than it are dropped by Spark. Each batch writes the windows it changed, so a replayed batch
overwrites itself and the state after any batch can be read back. Shares are compared with
stated ones when reading, from a number of rows that grows with windows and labels only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

WINDOW = "1 day"
LATE = "1 day"

COUNTS = "start timestamp, label string, n long, n_review long, batch long"


def count_stream(
    rows: DataFrame, time: str, label: str, review: Column, target: str, checkpoint: str,
    window: str = WINDOW, late: str = LATE,
) -> StreamingQuery:
    """Counts of the rows and of those for review by window and label, one folder a batch.

    A null label is counted as itself; rows without a time are in no window.
    """
    counted = (
        rows.select(F.col(time).cast("timestamp").alias("time"), F.col(label).alias("label"), F.coalesce(review, F.lit(False)).alias("review"))
        .withWatermark("time", late)
        .groupBy(F.window("time", window).alias("w"), "label")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if("review").alias("n_review"))
        .select(F.col("w.start").alias("start"), "label", "n", "n_review")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("batch", F.lit(batch_id).cast("long"))
        changed.write.mode("overwrite").parquet(f"{target}/at={batch_id}")

    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def counts(spark: SparkSession, target: str) -> DataFrame:
    """The counts of each window and label as the last batch that changed them left them."""
    written = spark.read.schema(COUNTS).parquet(f"{target}/at=*")
    last = written.groupBy("start", "label").agg(F.max_by(F.struct("n", "n_review"), "batch").alias("c"))
    return last.select("start", "label", "c.n", "c.n_review")


def drift(found: DataFrame, expected: DataFrame) -> DataFrame:
    """``start, label, n, n_review, share, expected_share, shift``: by window, for every
    expected label and every label that came.

    ``expected`` has ``label`` and ``expected_share``; it has a row per label and is broadcast.
    """
    by_window = Window.partitionBy("start")
    starts = found.select("start").distinct()
    known = starts.join(F.broadcast(expected.select("label")))
    labels = known.unionByName(found.select("start", "label")).distinct()
    same = lambda a, b: (F.col(f"{a}.start") == F.col(f"{b}.start")) & F.col(f"{a}.label").eqNullSafe(F.col(f"{b}.label"))
    rows = labels.alias("l").join(found.alias("f"), same("l", "f"), "left").select(
        "l.start", "l.label", *[F.coalesce(F.col(f"f.{c}"), F.lit(0)).alias(c) for c in ("n", "n_review")]
    )
    shares = rows.withColumn("share", F.col("n") / F.sum("n").over(by_window))
    wanted = F.broadcast(expected.select(F.col("label").alias("_label"), "expected_share"))
    joined = shares.join(wanted, F.col("label").eqNullSafe(F.col("_label")), "left").drop("_label")
    expected_share = F.coalesce("expected_share", F.lit(0.0))
    return joined.withColumn("expected_share", expected_share).withColumn("shift", F.col("share") - expected_share)
