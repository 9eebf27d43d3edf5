"""A stream over the events, read back and compared with the same counts in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.session import fresh_path
from recordlens.streaming import drift
from recordlens.workload.registry import query
from recordlens.workload.tables import table

# Events above this value go to review.
REVIEW_OVER = 40.0


@query(
    "label_drift_by_day",
    f"""WITH expected AS (SELECT event_type AS label, count(*) / (SELECT count(*) FROM events) AS expected_share
                         FROM events GROUP BY event_type),
    days AS (SELECT DISTINCT date_trunc('day', ts) AS start FROM events WHERE ts IS NOT NULL),
    counted AS (SELECT date_trunc('day', ts) AS start, event_type AS label, count(*) AS n,
                  sum(CASE WHEN value > {REVIEW_OVER} THEN 1 ELSE 0 END) AS n_review FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
    filled AS (SELECT days.start, expected.label, expected_share, coalesce(n, 0) AS n, coalesce(n_review, 0) AS n_review
               FROM days CROSS JOIN expected LEFT JOIN counted ON counted.start = days.start AND counted.label = expected.label)
    SELECT strftime(start, '%Y-%m-%d') AS day, label, n, CAST(n_review AS BIGINT) AS n_review,
           round(n / sum(n) OVER (PARTITION BY start) - expected_share, 9) AS shift FROM filled""",
)
def label_drift_by_day(spark, sf_dir):
    """Shares of each day's event types against those of all events, counted by a stream."""
    events = table(spark, sf_dir, "events")
    # As a pattern, the path may be a file or a folder.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parque[t]")
    target = fresh_path(spark, "drift")
    drift.count_stream(
        stream, "ts", "event_type", F.col("value") > REVIEW_OVER, target, fresh_path(spark, "drift-state")
    ).awaitTermination()
    total = events.agg(F.count(F.lit(1))).scalar()
    expected = events.groupBy(F.col("event_type").alias("label")).agg((F.count(F.lit(1)) / total).alias("expected_share"))
    found = drift.drift(drift.counts(spark, target), expected)
    return found.select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "label", "n", "n_review", F.round("shift", 9).alias("shift")
    )
