"""Fixed vocabulary of the record model: fields, label order, split pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Label order defines label ids and every report axis.
LABELS = ["Read", "Write", "Execute", "Destructive", "Financial", "Other"]

# Model input and content identity use these three fields only.
TEXT_FIELDS = ["name", "description", "input_schema"]

# Column names and splits of the record files.
ID = "record_id"
GROUP = "server_slug"
LABEL = "category"

SPLITS = ["train", "validation", "test"]
SPLIT_PAIRS = [("train", "validation"), ("train", "test"), ("validation", "test")]

SCORING_COLUMNS = [ID, *TEXT_FIELDS]

RECORD_SCHEMA = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in [ID, GROUP, *TEXT_FIELDS, LABEL]
    ]
)

# Model input limit and scoring batch.
MAX_TOKENS = 1024
SCORING_BATCH = 8


def label_dim(spark: SparkSession, labels: Sequence[str] = LABELS) -> DataFrame:
    """The closed label domain as ``(label_id INT, label STRING)``."""
    names = F.array(*[F.lit(x) for x in labels])
    return spark.range(1).select(F.posexplode(names).alias("label_id", "label"))


def in_domain(label: Column, labels: Sequence[str] = LABELS) -> Column:
    """True only for labels of the domain; NULL counts as outside."""
    return F.coalesce(label.isin(list(labels)), F.lit(False))


def encode_label(label: Column, labels: Sequence[str] = LABELS) -> Column:
    """Label to id; an unknown or NULL label fails the job."""
    position = F.array_position(F.array(*[F.lit(x) for x in labels]), label)
    unknown = F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(label, F.lit("NULL"))))
    return F.when(in_domain(label, labels), (position - 1).cast("int")).otherwise(
        unknown.cast("int")
    )


def decode_label(label_id: Column, labels: Sequence[str] = LABELS) -> Column:
    """Id to label; NULL for an id outside the domain."""
    return F.get(F.array(*[F.lit(x) for x in labels]), label_id)
