"""Writing predictions, matrices, error tables, reports and fitted artefacts."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.domain import ID, LABEL, LABELS
from recordlens.operators.heads import Head

# Descriptions hold quotes and newlines; this dialect doubles quotes like most CSV tools.
_CSV = {"header": "true", "quote": '"', "escape": '"', "quoteAll": "false"}

METRIC_DEFAULTS = {"primary_metric": "macro_f1", "evaluation_split": "validation"}


def write_predictions(df: DataFrame, path: str, order: str = "input_order") -> None:
    """``record_id,category`` in input order; part files are ordered among themselves."""
    ordered = df.orderBy(order).select(ID, LABEL)
    ordered.write.mode("overwrite").options(**_CSV).csv(path)


def write_errors(errors: DataFrame, path: str) -> None:
    errors.write.mode("overwrite").options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**_CSV, multiLine="true").csv(path)


def confusion_layout(matrix: DataFrame, labels: Sequence[str] = LABELS) -> DataFrame:
    """Rows ``Actual_*`` and columns ``Predicted_*`` in label order."""
    columns = [F.col(f"`{x}`").alias(f"Predicted_{x}") for x in labels]
    return matrix.orderBy("label_id").select(
        F.concat(F.lit("Actual_"), "actual").alias("actual"), *columns
    )


def write_confusion(matrix: DataFrame, path: str, labels: Sequence[str] = LABELS) -> None:
    confusion_layout(matrix, labels).write.mode("overwrite").options(**_CSV).csv(path)


def write_report(spark: SparkSession, sections: Mapping[str, object], path: str) -> None:
    """One JSON document from bounded aggregates."""
    text = json.dumps(sections, ensure_ascii=False)
    spark.range(1).select(F.lit(text).alias("value")).write.mode("overwrite").text(path)


def update_metrics(metrics: DataFrame, path: str, section: str) -> None:
    """Replace one section of the metrics table and leave the others.

    ``metrics`` has the columns ``metric, label, value``.
    """
    (
        metrics.select("metric", "label", "value", F.lit(section).alias("section"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("section")
        .parquet(path)
    )


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table with the two document-wide defaults."""
    schema = "metric string, label string, value string, section string"
    defaults = spark.createDataFrame(
        [(k, None, v, "document") for k, v in METRIC_DEFAULTS.items()], schema
    )
    stored = spark.read.schema(schema).parquet(path)
    return stored.unionByName(defaults)


def save_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.write.mode("overwrite").parquet(path)


def load_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_models(models: Mapping[str, LogisticRegressionModel | Head], path: str) -> None:
    """One fitted model per label below ``path``, and the list of the labels that have one.

    Spark ML models are saved as such, heads that were fitted together as a table of theirs.
    """
    spark = SparkSession.active()
    listed = [(i, label, isinstance(m, Head)) for i, (label, m) in enumerate(models.items())]
    heads = [(i, m.intercept, m.coefficients) for (i, _, head), m in zip(listed, models.values()) if head]
    for (i, _, head), model in zip(listed, models.values()):
        if not head:
            model.write().overwrite().save(f"{path}/{i}")
    if heads:
        table = spark.createDataFrame(heads, T.StructType.fromDDL("i int, intercept double").add("coefficients", VectorUDT()))
        table.write.mode("overwrite").parquet(f"{path}/heads")
    spark.createDataFrame(listed, "i int, label string, head boolean").coalesce(1).write.mode("overwrite").json(
        f"{path}/labels"
    )


def load_models(spark: SparkSession, path: str) -> dict[str, LogisticRegressionModel | Head]:
    """The stored models by label, in the order they were saved."""
    listed = spark.read.schema("i int, label string, head boolean").json(f"{path}/labels").orderBy("i").collect()
    heads = {}
    if any(row["head"] for row in listed):
        rows = spark.read.parquet(f"{path}/heads").collect()
        heads = {r["i"]: Head(r["coefficients"], r["intercept"]) for r in rows}
    return {
        row["label"]: heads[row["i"]] if row["head"] else LogisticRegressionModel.load(f"{path}/{row['i']}")
        for row in listed
    }


def stored_megabytes(spark: SparkSession, path: str) -> float:
    """Size of everything stored below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return (files.agg(F.sum("length")).first()[0] or 0) / (1024 * 1024)
