"""Abstention thresholds and temperature scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.operators import calibration
from recordlens.workload.registry import query
from recordlens.workload.tables import ORDER_LABELS, SCORED_ORDERS, scored_orders, sql_labels, table

THRESHOLDS = [k / 20 for k in range(20)]
_LEVELS = ", ".join(f"({t})" for t in THRESHOLDS)
_ABSTAIN = ORDER_LABELS[-1]
_IN = ", ".join(f"'{x}'" for x in ORDER_LABELS)


@query(
    "threshold_sweep",
    f"""WITH {SCORED_ORDERS}, {sql_labels(ORDER_LABELS)}, levels(threshold) AS (VALUES {_LEVELS}),
    given AS (SELECT CAST(threshold AS DOUBLE) AS threshold, actual_category AS a, confidence >= threshold AS kept,
                CASE WHEN confidence >= threshold THEN predicted_category ELSE '{_ABSTAIN}' END AS g
              FROM scored CROSS JOIN levels),
    counts AS (SELECT threshold, label, sum(CASE WHEN a = label AND g = label THEN 1 ELSE 0 END) AS hit,
                 sum(CASE WHEN a = label THEN 1 ELSE 0 END) AS held, sum(CASE WHEN g = label THEN 1 ELSE 0 END) AS guessed
               FROM given CROSS JOIN dim GROUP BY threshold, label),
    f1 AS (SELECT threshold, avg(CASE WHEN held + guessed > 0 THEN 2.0 * hit / (held + guessed) ELSE 0.0 END) AS macro_f1
           FROM counts GROUP BY threshold),
    rows_in AS (SELECT threshold, avg(CASE WHEN kept THEN 1.0 ELSE 0.0 END) AS coverage,
                  avg(CASE WHEN a = g THEN 1.0 ELSE 0.0 END) AS accuracy FROM given GROUP BY threshold)
    SELECT threshold, round(coverage, 9) AS coverage, round(accuracy, 9) AS accuracy, round(macro_f1, 9) AS macro_f1
    FROM rows_in JOIN f1 USING (threshold)""",
)
def threshold_sweep(spark, sf_dir):
    """Scores of the orders if predictions below each threshold abstain."""
    swept = calibration.threshold_sweep(
        scored_orders(spark, sf_dir), "actual_category", "predicted_category", "confidence", _ABSTAIN, THRESHOLDS, ORDER_LABELS
    )
    return swept.select("threshold", *[F.round(c, 9).alias(c) for c in ("coverage", "accuracy", "macro_f1")])


# Six logits of each embedding; the label is the largest of them where a rule agrees, else the next.
_CLASSES = 6
_LOGITS = "list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE) * 4)"
TEMPERATURES = [0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0]


def logit_rows(spark, sf_dir):
    first = F.transform(F.slice("embedding", 1, _CLASSES), lambda x: x.cast("double") * 4)
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), first.alias("z"))
    top = (F.array_position("z", F.array_max("z")) - 1).cast("int")
    return rows.select("id", "z", F.when(F.col("id") % 3 == 0, (top + 1) % _CLASSES).otherwise(top).alias("y"))


_ROWS_SQL = f"""rows_in AS (
      SELECT id, z, CASE WHEN id % 3 = 0 THEN (top + 1) % {_CLASSES} ELSE top END AS y FROM (
        SELECT vec_id AS id, {_LOGITS} AS z, list_position({_LOGITS}, list_max({_LOGITS})) - 1 AS top FROM embeddings) AS t)"""


@query(
    "temperature_losses",
    f"""WITH {_ROWS_SQL}, grid(temperature) AS (VALUES {", ".join(f"({t})" for t in TEMPERATURES)}),
    each AS (SELECT CAST(temperature AS DOUBLE) AS temperature, z, y, list_max(z) AS top,
               list_transform(z, lambda x: exp((x - list_max(z)) / temperature)) AS p FROM rows_in CROSS JOIN grid)
    SELECT temperature, count(*) AS n, round(avg(ln(list_sum(p)) + (top - z[y + 1]) / temperature), 6) AS nll FROM each GROUP BY temperature""",
)
def temperature_losses(spark, sf_dir):
    """Mean loss of the logits at each temperature of a grid."""
    found = calibration.negative_log_likelihood(logit_rows(spark, sf_dir), "z", "y", TEMPERATURES)
    return found.select("temperature", "n", F.round("nll", 6).alias("nll"))
