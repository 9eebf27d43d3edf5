"""Evaluate scored validation rows and analyse their errors."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.domain import LABELS
from recordlens.operators import errors, metrics
from recordlens.operators.scoring import Loader, as_evaluated, score_records
from recordlens.session import cut_lineage
from recordlens.sources import sinks


def score_validation(
    validation: DataFrame, loader: Loader, labels: Sequence[str] = LABELS
) -> DataFrame:
    """Scored validation rows, computed once."""
    return cut_lineage(as_evaluated(score_records(validation, loader, labels)))


def error_analysis(scored: DataFrame, labels: Sequence[str] = LABELS, modes=None) -> dict[str, object]:
    """Error counts, failure modes and examples; all bounded by the label domain."""
    wrong = errors.misclassified(scored).select(*errors.ERROR_COLUMNS)
    cells = metrics.confusion_cells(scored, "actual_category", "predicted_category", labels)
    rate = errors.error_rate(scored).first()
    by_class = errors.error_counts(wrong, labels).orderBy("label_id").collect()
    evidence = errors.failure_modes(cells, modes or errors.FAILURE_MODES).collect()
    recurring: dict[str, dict[str, int]] = {}
    for row in evidence:
        recurring.setdefault(row["mode"], {})[row["evidence"]] = row["n"]
    top = errors.json_rows(errors.top_errors(wrong, labels=labels)).orderBy("label_id", "rank")
    return {
        "validation_error_count": rate["error_count"],
        "validation_error_rate": rate["error_rate"],
        "errors_by_actual_class": {r["label"]: r["n"] for r in by_class},
        "recurring_failure_modes": recurring,
        "failure_mode_descriptions": {m: errors.describe_mode(m) for m in recurring},
        "example_selection": (
            f"Of each actual label the {errors.ERRORS_PER_CLASS} errors predicted with most "
            "confidence, so rare labels are shown too."
        ),
        "examples": [json.loads(r["example"]) for r in top.select("example").collect()],
    }


def evaluate(scored: DataFrame, out: str, section: str, labels: Sequence[str] = LABELS) -> None:
    """Write the confusion table, all errors, the error analysis and one metrics section."""
    spark = scored.sparkSession
    cells = metrics.confusion_cells(scored, "actual_category", "predicted_category", labels)
    sinks.write_confusion(metrics.confusion_matrix(cells, labels), f"{out}/confusion", labels)
    sinks.write_errors(
        errors.misclassified(scored).select(*errors.ERROR_COLUMNS), f"{out}/validation_errors"
    )
    sinks.write_report(spark, error_analysis(scored, labels), f"{out}/error_analysis")
    rows = metrics.metrics_rows(
        metrics.summary_metrics(cells, labels), metrics.per_class_metrics(cells, labels)
    )
    invalid = metrics.invalid_rate(scored, "predicted_category", labels).select(
        F.lit("invalid_output_rate").alias("metric"),
        F.lit(None).cast("string").alias("label"),
        F.col("invalid_rate").cast("string").alias("value"),
    )
    sinks.update_metrics(rows.unionByName(invalid), f"{out}/metrics", section)
