"""Error tables, rankings and failure-mode counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlens.domain import ID, LABELS, label_dim
from recordlens.functions.text import field
from recordlens.operators.audit import zero_fill

# Layout of the error table.
ERROR_COLUMNS = [
    "record_id",
    "server_slug",
    "name",
    "actual_category",
    "predicted_category",
    "confidence",
    "description",
    "input_schema",
]

ERRORS_PER_CLASS = 4

# Fixed values: (mode, evidence, cells of the matrix as (actual, predicted); None = any error).
FAILURE_MODES = [
    ("Read vs Write ambiguity", "Write_to_Read", [("Write", "Read")]),
    ("Read vs Write ambiguity", "Read_to_Write", [("Read", "Write")]),
    ("Read vs Write ambiguity", "combined", [("Write", "Read"), ("Read", "Write")]),
    ("Execute vs Read/Write ambiguity", "Execute_to_Read", [("Execute", "Read")]),
    ("Execute vs Read/Write ambiguity", "Execute_to_Write", [("Execute", "Write")]),
    ("Execute vs Read/Write ambiguity", "Read_to_Execute", [("Read", "Execute")]),
    ("Execute vs Read/Write ambiguity", "Write_to_Execute", [("Write", "Execute")]),
    ("Minority-class collapse", "Other_errors", [("Other", None)]),
    ("Minority-class collapse", "Financial_errors", [("Financial", None)]),
    ("Minority-class collapse", "Destructive_errors", [("Destructive", None)]),
]


def describe_mode(mode: str, modes: Sequence[tuple[str, str, list]] = tuple(FAILURE_MODES)) -> str:
    """What a mode counts, in words made from its cells."""
    cells = dict.fromkeys(cell for name, _, own in modes if name == mode for cell in own)
    told = [f"{actual} given another label" if predicted is None else f"{actual} given {predicted}" for actual, predicted in cells]
    return "Counts rows of " + ", rows of ".join(told) + "." if told else ""


def misclassified(
    scored: DataFrame, actual: str = "actual_category", predicted: str = "predicted_category"
) -> DataFrame:
    """Rows whose prediction differs; a NULL on either side is a difference."""
    return scored.filter(~F.col(actual).eqNullSafe(F.col(predicted)) | F.col(actual).isNull())


def error_counts(errors: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Errors per actual class, zero-filled."""
    counted = errors.groupBy(F.col("actual_category").alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return zero_fill(counted, labels)


def error_rate(scored: DataFrame) -> DataFrame:
    wrong = ~F.col("actual_category").eqNullSafe(F.col("predicted_category"))
    wrong = wrong | F.col("actual_category").isNull()
    return scored.agg(
        F.count_if(wrong).alias("error_count"), F.avg(wrong.cast("double")).alias("error_rate")
    )


def top_errors(
    errors: DataFrame,
    per_class: int = ERRORS_PER_CLASS,
    labels: Sequence[str] = LABELS,
    id_col: str = ID,
) -> DataFrame:
    """Most confident errors of each actual class, ties by id.

    Spark prunes to ``per_class`` rows per class inside every map task before
    the shuffle, so a class holding most errors stays small.
    """
    order = Window.partitionBy("actual_category").orderBy(F.desc("confidence"), F.asc(id_col))
    ranked = errors.withColumn("rank", F.row_number().over(order)).filter(
        F.col("rank") <= per_class
    )
    dim = label_dim(errors.sparkSession, labels).withColumnRenamed("label", "actual_category")
    return ranked.join(F.broadcast(dim), "actual_category")


def json_rows(errors: DataFrame, columns: Sequence[str] = ERROR_COLUMNS) -> DataFrame:
    """Rows as JSON objects: text with NULL as empty, confidence as a number."""
    shown = [
        F.col(c).cast("double").alias(c) if c == "confidence" else field(F.col(c)).alias(c)
        for c in columns
    ]
    return errors.withColumn("example", F.to_json(F.struct(*shown)))


def failure_modes(
    cells: DataFrame, modes: Sequence[tuple[str, str, list]] = tuple(FAILURE_MODES)
) -> DataFrame:
    """Evidence counts of the named confusions, from the confusion cells."""
    sums = []
    for i, (_, _, wanted) in enumerate(modes):
        hit = F.lit(False)
        for actual, predicted in wanted:
            is_actual = F.col("actual") == actual
            hit = hit | (
                is_actual & ~F.col("predicted").eqNullSafe(F.lit(actual))
                if predicted is None
                else is_actual & (F.col("predicted") == predicted)
            )
        sums.append(F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(str(i)))
    rows = F.array(
        *[
            F.struct(
                F.lit(mode).alias("mode"), F.lit(name).alias("evidence"), F.col(str(i)).alias("n")
            )
            for i, (mode, name, _) in enumerate(modes)
        ]
    )
    return cells.agg(*sums).select(F.explode(rows).alias("r")).select("r.*")
