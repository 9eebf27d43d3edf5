"""Multinomial naive Bayes: candidates that are fitted by counting, for model selection.

One aggregate over the training words fits every candidate, since candidates differ in
their smoothing only; one pass over the rows to score serves all of them.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.functions.text import words
from recordlens.session import broadcast_if_small, cut_lineage

# Scores are compared at this many decimals, so summation order cannot break ties.
DECIMALS = 6


def _terms(df: DataFrame, text: str, *keep: str) -> DataFrame:
    rows = df.select(*keep, F.explode_outer(words(F.col(text))).alias("term"))
    return rows.filter(F.col("term").isNotNull())


def predict_smoothed(
    train: DataFrame, rows: DataFrame, key: str, text: str, label: str, labels: Sequence[str], smoothings: Sequence[float]
) -> DataFrame:
    """``key, label, candidate, predicted_category``: the rows once for each smoothing.

    A label's score is its log share of the training rows plus the log share of each known
    word; unknown words are not counted. Of equal scores the first label wins. Training
    rows with another label, or none, are not used; every label needs one.
    """
    known = train.filter(F.col(label).isin(list(labels)))
    counted = {r[label]: r["n"] for r in known.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = [x for x in labels if not counted.get(x)]
    if missing:
        raise ValueError(f"no training rows for labels: {missing}")
    own = [F.count_if(F.col(label) == x).alias(f"c{i}") for i, x in enumerate(labels)]
    table = cut_lineage(_terms(known, text, label).groupBy("term").agg(*own))
    sums = table.agg(F.count(F.lit(1)).alias("v"), *[F.coalesce(F.sum(f"c{i}"), F.lit(0)).alias(f"t{i}") for i in range(len(labels))]).first()

    tf = _terms(rows, text, key).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    joined = tf.join(broadcast_if_small(table, F.octet_length("term") + 8 * len(labels)), "term")
    total = sum(counted.values())
    scores = [
        F.sum(F.col("tf") * F.log((F.col(f"c{i}") + a) / (sums[f"t{i}"] + a * max(sums["v"], 1)))).alias(f"s{k}_{i}")
        for k, a in enumerate(smoothings)
        for i in range(len(labels))
    ]
    by_row = rows.select(key, label).join(joined.groupBy(key).agg(*scores), key, "left")

    def best(k: int):
        own = [
            F.round(F.coalesce(f"s{k}_{i}", F.lit(0.0)) + math.log(counted[x] / total), DECIMALS) for i, x in enumerate(labels)
        ]
        at = F.array_position(F.array(*own), F.greatest(*own) if len(own) > 1 else own[0])
        return F.element_at(F.array(*[F.lit(x) for x in labels]), at.cast("int"))

    found = F.array(
        *[F.struct(F.lit(float(a)).alias("candidate"), best(k).alias("predicted_category")) for k, a in enumerate(smoothings)]
    )
    return by_row.select(key, label, F.explode(found).alias("e")).select(key, label, "e.*")
