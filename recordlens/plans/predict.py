"""Classify a JSONL file under the output contract."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.domain import ID, LABEL, LABELS, SCORING_COLUMNS, TEXT_FIELDS
from recordlens.operators.contracts import check_contract
from recordlens.operators.scoring import Loader, score_records
from recordlens.session import cut_lineage
from recordlens.sources.records import check_keys, read_jsonl, read_lines, with_file_order, with_input_order
from recordlens.sources.sinks import write_predictions


def predict(records: DataFrame, loader: Loader, labels: Sequence[str] = LABELS) -> DataFrame:
    """``(input_order, record_id, category)``; the group column is not needed.

    An ``input_order`` that the records bring along is kept, else they are tagged here.
    """
    tagged = records if "input_order" in records.columns else with_input_order(records)
    rows = tagged.select("input_order", ID, *TEXT_FIELDS)
    scored = score_records(rows, loader, labels)
    return scored.select("input_order", ID, F.col("predicted_category").alias(LABEL))


def predict_file(
    spark: SparkSession, source: str, target: str, loader: Loader, labels: Sequence[str] = LABELS
) -> int:
    """Score the lines of ``source``, a file or a folder of files, in order, and write predictions; missing columns or a broken contract
    write nothing."""
    check_keys(read_lines(spark, source), SCORING_COLUMNS)
    records = with_file_order(read_jsonl(spark, source))
    # Scoring is the expensive part: it runs once, then checks and writing read the result.
    output = cut_lineage(predict(records, loader, labels))
    n_input = records.count()
    check_contract(output, n_input, labels)
    write_predictions(output, target)
    return n_input
