"""Batched scoring with a pluggable model, and input-length profiles."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.domain import LABELS, SCORING_BATCH, TEXT_FIELDS
from recordlens.functions.probability import top_label, top_probability
from recordlens.functions.text import model_text, words

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A loader runs once per Python worker and returns texts -> logits (rows x labels).
Loader = Callable[[], Callable[[np.ndarray], np.ndarray]]


def score(
    df: DataFrame,
    loader: Loader,
    text: Column,
    labels: Sequence[str] = LABELS,
    batch_size: int = SCORING_BATCH,
) -> DataFrame:
    """Add ``predicted_category`` and ``confidence``. Rows keep their keys, so
    nothing is paired by position, and the model is loaded once per worker."""
    scorer = predict_batch_udf(
        loader, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size
    )
    # A Python function sees every row whatever stands around it, so NULL texts go in as
    # empty ones and lose their logits afterwards. The text is read twice, so the
    # optimizer computes it below the scorer instead of copying its lambdas.
    present = F.col("_text").isNotNull()
    logits = (
        df.withColumn("_text", text)
        .withColumn("_scored", scorer(F.coalesce("_text", F.lit(""))))
        .withColumn("_logits", F.when(present, F.col("_scored")))
    )
    return logits.select(
        *df.columns,
        top_label(F.col("_logits"), labels).alias("predicted_category"),
        top_probability(F.col("_logits")).alias("confidence"),
    )


def score_records(
    df: DataFrame, loader: Loader, labels: Sequence[str] = LABELS, batch_size: int = SCORING_BATCH
) -> DataFrame:
    """Score records on their model text."""
    return score(df, loader, model_text(*[F.col(c) for c in TEXT_FIELDS]), labels, batch_size)


def as_evaluated(scored: DataFrame, label: str = "category") -> DataFrame:
    """Scored rows with the known label named as in the error tables."""
    return scored.withColumnRenamed(label, "actual_category")


def letter_share_scorer(letters: str) -> Loader:
    """A deterministic scorer for tests: logit k is the share of letter k in the text."""

    def load():
        def predict(batch: np.ndarray) -> np.ndarray:
            return np.array(
                [[s.count(x) / max(len(s), 1) for x in letters] for s in batch], dtype=np.float32
            )

        return predict

    return load


def token_profile(df: DataFrame, text: str, limit: int) -> DataFrame:
    """Shortest, mean and longest token count, and texts above the limit."""
    n = df.select(F.size(words(F.col(text))).cast("long").alias("n"))
    return n.agg(
        F.min("n").alias("shortest"),
        F.avg("n").alias("mean"),
        F.max("n").alias("longest"),
        F.count_if(F.col("n") > limit).alias("n_over_limit"),
    )


def head_sample(df: DataFrame, id_col: str, n: int) -> DataFrame:
    """The first ``n`` rows by id; each task keeps its own ``n``, then they merge."""
    return df.orderBy(id_col).limit(n)
