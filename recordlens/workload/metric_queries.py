"""Evaluation and error-analysis queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.domain import in_domain
from recordlens.operators import contracts, errors, metrics
from recordlens.operators.audit import zero_fill
from recordlens.sources.sinks import confusion_layout
from recordlens.workload.registry import query
from recordlens.workload.tables import (
    CANDIDATE_LINES,
    LINE_LABELS,
    ORDER_LABELS,
    PART_LABELS,
    SCORED_ORDERS,
    candidate_lines,
    scored_orders,
    sql_labels,
    table,
)

_DIM = sql_labels(ORDER_LABELS)

_MATRIX = f"""
WITH {SCORED_ORDERS}, {_DIM}
SELECT d.label_id, d.label AS actual, {', '.join(
    f'''count(*) FILTER (s.predicted_category = '{x}') AS "{x}"''' for x in ORDER_LABELS)}
FROM dim d LEFT JOIN scored s ON s.actual_category = d.label GROUP BY d.label_id, d.label
"""


def _cells(spark, sf_dir):
    return metrics.confusion_cells(
        scored_orders(spark, sf_dir), "actual_category", "predicted_category", ORDER_LABELS
    )


@query("confusion_matrix", _MATRIX)
def confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_cells(spark, sf_dir), ORDER_LABELS)


@query(
    "confusion_layout",
    "SELECT 'Actual_' || actual AS actual, "
    + ", ".join(f'"{x}" AS "Predicted_{x}"' for x in ORDER_LABELS)
    + f" FROM ({_MATRIX})",
)
def confusion_table(spark, sf_dir):
    return confusion_layout(metrics.confusion_matrix(_cells(spark, sf_dir), ORDER_LABELS), ORDER_LABELS)


@query(
    "confusion_rates",
    f"""WITH {SCORED_ORDERS}, {_DIM}
    SELECT a.label AS actual, p.label AS predicted, count(s.record_id) AS n,
           round(count(s.record_id) / greatest((SELECT count(*) FROM scored x, dim y
             WHERE x.actual_category = a.label AND x.predicted_category = y.label), 1), 9) AS rate
    FROM dim a CROSS JOIN dim p
    LEFT JOIN scored s ON s.actual_category = a.label AND s.predicted_category = p.label
    GROUP BY a.label, p.label""",
)
def confusion_rates(spark, sf_dir):
    rates = metrics.confusion_rates(_cells(spark, sf_dir), ORDER_LABELS)
    return rates.withColumn("rate", F.round("rate", 9))


def _per_class_sql(view: str, dim: str, actual: str, predicted: str, by: str = "") -> str:
    """Scores per label by direct counting, one conditional count per ingredient."""
    lead = f"{by}, " if by else ""
    return f"""per_class AS (
      SELECT {lead}label_id, label, support,
             CASE WHEN guessed = 0 THEN 0.0 ELSE hit / guessed END AS "precision",
             CASE WHEN support = 0 THEN 0.0 ELSE hit / support END AS recall,
             CASE WHEN guessed + support = 0 THEN 0.0 ELSE 2 * hit / (guessed + support) END AS f1
      FROM (SELECT {lead}label_id, label,
                   count(*) FILTER ({actual} = label AND {predicted} = label) AS hit,
                   count(*) FILTER ({predicted} = label) AS guessed,
                   count(*) FILTER ({actual} = label) AS support
            FROM scored CROSS JOIN dim GROUP BY {lead}label_id, label))"""


_ORDER_CLASSES = (
    f"WITH {SCORED_ORDERS}, {_DIM}, "
    + _per_class_sql("scored", "dim", "actual_category", "predicted_category")
)


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 9) for c in columns})


@query(
    "per_class_metrics",
    f'{_ORDER_CLASSES} SELECT label_id, label, round("precision", 9) AS "precision", '
    "round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM per_class",
)
def per_class_metrics(spark, sf_dir):
    out = metrics.per_class_metrics(_cells(spark, sf_dir), ORDER_LABELS)
    return _rounded(out, "precision", "recall", "f1")


@query(
    "summary_metrics",
    f"""{_ORDER_CLASSES} SELECT
      (SELECT round(avg(CASE WHEN actual_category = predicted_category THEN 1.0 ELSE 0.0 END), 9) FROM scored) AS accuracy,
      round(sum(f1) / {len(ORDER_LABELS)}, 9) AS macro_f1,
      round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM per_class""",
)
def summary_metrics(spark, sf_dir):
    out = metrics.summary_metrics(_cells(spark, sf_dir), ORDER_LABELS)
    return _rounded(out, "accuracy", "macro_f1", "weighted_f1")


_CANDIDATES = f"""WITH {CANDIDATE_LINES}, {sql_labels(LINE_LABELS)},
{_per_class_sql("scored", "dim", "actual", "predicted", "candidate")},
log AS (
  SELECT p.candidate, round(min(a.accuracy), 9) AS accuracy, round(sum(f1) / {len(LINE_LABELS)}, 9) AS macro_f1,
         round(sum(f1 * support) / sum(support), 9) AS weighted_f1
  FROM per_class p JOIN (SELECT candidate, avg(CASE WHEN actual = predicted THEN 1.0 ELSE 0.0 END) AS accuracy
                         FROM scored GROUP BY candidate) a ON a.candidate = p.candidate
  GROUP BY p.candidate)"""


@query("candidate_metrics", f"{_CANDIDATES} SELECT * FROM log")
def candidate_metrics(spark, sf_dir):
    lines = candidate_lines(spark, sf_dir)
    cells = metrics.confusion_cells(lines, "actual", "predicted", LINE_LABELS, ["candidate"])
    out = metrics.summary_metrics(cells, LINE_LABELS, ["candidate"])
    return _rounded(out, "accuracy", "macro_f1", "weighted_f1")


@query("best_candidate", f"{_CANDIDATES} SELECT * FROM log ORDER BY macro_f1 DESC, candidate LIMIT 1")
def best_candidate(spark, sf_dir):
    return metrics.select_best(candidate_metrics(spark, sf_dir), "macro_f1", "candidate")


@query(
    "class_weights",
    f"""WITH {sql_labels(PART_LABELS)}
    SELECT label_id, label, count(*) AS n,
           round((SELECT count(*) FROM part) / ({len(PART_LABELS)} * count(*)), 9) AS weight
    FROM dim JOIN part ON p_type = label GROUP BY label_id, label""",
)
def class_weights(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    counted = part.groupBy(F.col("p_type").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return _rounded(metrics.class_weights(zero_fill(counted, PART_LABELS), PART_LABELS), "weight")


_INVALID = f"predicted_category IS NULL OR predicted_category NOT IN (SELECT label FROM dim)"


@query(
    "invalid_rate",
    f"WITH {SCORED_ORDERS}, {_DIM} SELECT count(*) FILTER ({_INVALID}) AS n_invalid, "
    f"round(avg(CASE WHEN {_INVALID} THEN 1.0 ELSE 0.0 END), 9) AS invalid_rate FROM scored",
)
def invalid_rate(spark, sf_dir):
    out = metrics.invalid_rate(scored_orders(spark, sf_dir), "predicted_category", ORDER_LABELS)
    return _rounded(out, "invalid_rate")


@query(
    "invalid_predictions",
    f"WITH {SCORED_ORDERS}, {_DIM} SELECT record_id, predicted_category FROM scored WHERE {_INVALID}",
)
def invalid_predictions(spark, sf_dir):
    scored = scored_orders(spark, sf_dir)
    return scored.filter(~in_domain(F.col("predicted_category"), ORDER_LABELS)).select(
        "record_id", "predicted_category"
    )


_WRONG = "predicted_category IS DISTINCT FROM actual_category"
_COLUMNS = ", ".join(errors.ERROR_COLUMNS)


@query(
    "misclassified_rows",
    f"WITH {SCORED_ORDERS} SELECT {_COLUMNS} FROM scored WHERE {_WRONG}",
)
def misclassified_rows(spark, sf_dir):
    return errors.misclassified(scored_orders(spark, sf_dir)).select(*errors.ERROR_COLUMNS)


@query(
    "errors_by_actual_class",
    f"WITH {SCORED_ORDERS}, {_DIM} SELECT label_id, label, count(s.record_id) AS n FROM dim "
    f"LEFT JOIN (SELECT * FROM scored WHERE {_WRONG}) s ON s.actual_category = label GROUP BY label_id, label",
)
def errors_by_actual_class(spark, sf_dir):
    return errors.error_counts(errors.misclassified(scored_orders(spark, sf_dir)), ORDER_LABELS)


@query(
    "error_rate",
    f"WITH {SCORED_ORDERS} SELECT count(*) FILTER ({_WRONG}) AS error_count, "
    f"round(avg(CASE WHEN {_WRONG} THEN 1.0 ELSE 0.0 END), 9) AS error_rate FROM scored",
)
def error_rate(spark, sf_dir):
    return _rounded(errors.error_rate(scored_orders(spark, sf_dir)), "error_rate")


_TOP = f"""SELECT record_id, actual_category, predicted_category, confidence, label_id, rank, description FROM (
  SELECT *, row_number() OVER (PARTITION BY actual_category ORDER BY confidence DESC, record_id) AS rank
  FROM scored WHERE {_WRONG}) JOIN dim ON label = actual_category WHERE rank <= {errors.ERRORS_PER_CLASS}"""


@query(
    "most_confident_errors",
    f"WITH {SCORED_ORDERS}, {_DIM} {_TOP}",
)
def most_confident_errors(spark, sf_dir):
    wrong = errors.misclassified(scored_orders(spark, sf_dir))
    return errors.top_errors(wrong, labels=ORDER_LABELS).select(
        "record_id",
        "actual_category",
        "predicted_category",
        "confidence",
        "label_id",
        "rank",
        "description",
    )


@query(
    "error_examples_json",
    f"WITH {SCORED_ORDERS}, {_DIM}, t AS ({_TOP}) SELECT record_id, "
    "CAST(json_object('record_id', CAST(record_id AS VARCHAR), 'actual_category', actual_category, "
    "'predicted_category', coalesce(predicted_category, ''), 'confidence', confidence, "
    "'description', coalesce(description, '')) AS VARCHAR) AS example FROM t",
)
def error_examples_json(spark, sf_dir):
    top = most_confident_errors(spark, sf_dir)
    columns = ["record_id", "actual_category", "predicted_category", "confidence", "description"]
    return errors.json_rows(top, columns).select("record_id", "example")


# The named confusions, mapped onto the order labels.
_MODES = [
    ("urgent and high", "2-HIGH_to_1-URGENT", [("2-HIGH", "1-URGENT")]),
    ("urgent and high", "1-URGENT_to_2-HIGH", [("1-URGENT", "2-HIGH")]),
    ("urgent and high", "combined", [("2-HIGH", "1-URGENT"), ("1-URGENT", "2-HIGH")]),
    ("rare labels", "6-NEVER_errors", [("6-NEVER", None)]),
    ("rare labels", "5-LOW_errors", [("5-LOW", None)]),
]


def _mode_sql(mode: str, name: str, cells: list) -> str:
    tests = " OR ".join(
        f"(actual_category = '{a}' AND predicted_category "
        + (f"IS DISTINCT FROM '{a}')" if p is None else f"= '{p}')")
        for a, p in cells
    )
    return f"SELECT '{mode}' AS mode, '{name}' AS evidence, count(*) FILTER ({tests}) AS n FROM scored"


@query(
    "failure_modes",
    f"WITH {SCORED_ORDERS} " + " UNION ALL ".join(_mode_sql(*m) for m in _MODES),
)
def failure_modes(spark, sf_dir):
    return errors.failure_modes(_cells(spark, sf_dir), _MODES)


@query(
    "output_contract",
    f"WITH {SCORED_ORDERS}, {_DIM} SELECT count(*) AS n_rows, count(*) - count(DISTINCT record_id) AS n_repeated_ids, "
    f"count(*) FILTER ({_INVALID}) AS n_invalid_labels FROM scored",
)
def output_contract(spark, sf_dir):
    scored = scored_orders(spark, sf_dir)
    return contracts.contract_report(scored, ORDER_LABELS, label="predicted_category")


@query(
    "line_contract",
    """WITH dim(label) AS (VALUES ('A'), ('N')) SELECT count(*) AS n_rows,
    count(*) - count(DISTINCT l_orderkey) AS n_repeated_ids,
    count(*) FILTER (l_returnflag NOT IN (SELECT label FROM dim)) AS n_invalid_labels FROM lineitem""",
)
def line_contract(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return contracts.contract_report(lines, ["A", "N"], id_col="l_orderkey", label="l_returnflag")
