"""Thresholds and temperatures of a scorer, each from one pass over its predictions.

Rows shrink to counts before anything is computed from them: by label pair and confidence
bin for thresholds, to two sums per temperature for calibration.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.domain import LABELS, in_domain
from recordlens.operators.metrics import _ratio


def threshold_sweep(
    df: DataFrame, actual: str, predicted: str, confidence: str, abstain: str, thresholds: Sequence[float],
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """``threshold, coverage, accuracy, macro_f1`` if rows below it are given the label ``abstain``.

    A row is below a threshold if its confidence is smaller; a null confidence always is.
    Rows are counted by (actual, predicted, number of thresholds reached); the counts are
    summed from the highest threshold down, so every threshold is served by one pass over
    the rows. ``coverage`` is the share of rows that keep their prediction.
    """
    levels = sorted(set(float(t) for t in thresholds))
    reached = sum((F.when(F.col(confidence) >= t, 1).otherwise(0) for t in levels), F.lit(0))
    known = lambda c: F.when(in_domain(F.col(c), labels), F.col(c))
    cells = df.groupBy(
        known(actual).alias("actual"), known(predicted).alias("predicted"), reached.alias("reached")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(actual) == F.col(predicted)).alias("same"))

    # At most (K + 1)^2 cells for each bin; each takes part in every threshold as kept or not.
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(levels)]))
    each = cells.select("actual", "predicted", "reached", "n", "same", at.alias("t")).select(
        "actual", "t.threshold", "n", "same", (F.col("reached") > F.col("t.i")).alias("kept"),
        F.when(F.col("reached") > F.col("t.i"), F.col("predicted")).otherwise(F.lit(abstain)).alias("given"),
    )
    own = [
        F.struct(
            F.lit(x).alias("label"),
            F.when((F.col("actual") == x) & (F.col("given") == x), F.col("n")).otherwise(0).alias("hit"),
            F.when(F.col("actual") == x, F.col("n")).otherwise(0).alias("held"),
            F.when(F.col("given") == x, F.col("n")).otherwise(0).alias("guessed"),
        )
        for x in labels
    ]
    by_label = each.select("threshold", F.explode(F.array(*own)).alias("e")).groupBy("threshold", "e.label").agg(
        *[F.sum(f"e.{c}").alias(c) for c in ("hit", "held", "guessed")]
    )
    f1 = by_label.groupBy("threshold").agg(
        F.avg(_ratio(2 * F.col("hit"), F.col("held") + F.col("guessed"))).alias("macro_f1")
    )
    right = F.when(F.col("kept"), F.col("same")).otherwise(
        F.when(F.col("actual") == abstain, F.col("n")).otherwise(0)
    )
    rows = each.groupBy("threshold").agg(
        _ratio(F.sum(F.when(F.col("kept"), F.col("n")).otherwise(0)), F.sum("n")).alias("coverage"),
        _ratio(F.sum(right), F.sum("n")).alias("accuracy"),
    )
    return rows.join(f1, "threshold").select("threshold", "coverage", "accuracy", "macro_f1")


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep row with the highest macro F1; of equals the one that keeps most rows."""
    return sweep.orderBy(F.desc("macro_f1"), F.asc("threshold")).limit(1)


def _scaled(logits: Column, t: Column) -> Column:
    """``exp((z - max) / T)`` per logit."""
    top = F.array_max(logits)
    return F.transform(logits, lambda z: F.exp((z - top) / t))


def negative_log_likelihood(df: DataFrame, logits: str, label_id: str, temperatures: Sequence[float]) -> DataFrame:
    """``temperature, n, nll, slope``: mean loss and its derivative by 1/T, for a whole grid in one pass.

    Rows without logits, with a null logit, or with a label outside them are left out.
    """
    z = F.transform(F.col(logits), lambda x: x.cast("double"))
    usable = F.col(logits).isNotNull() & ~F.exists(logits, lambda x: x.isNull()) & F.col(label_id).between(0, F.size(logits) - 1)
    rows = df.filter(usable).select(z.alias("z"), F.col(label_id).cast("int").alias("y"))
    grid = F.array(*[F.lit(float(t)) for t in temperatures])
    rows = rows.select("z", "y", F.explode(grid).alias("temperature"))
    powers = rows.select("temperature", "z", "y", _scaled(F.col("z"), F.col("temperature")).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    mean = F.aggregate(F.zip_with("p", "z", lambda p, x: p * x), F.lit(0.0), lambda a, b: a + b) / total
    own = F.get("z", F.col("y"))
    loss = F.log(total) + (F.array_max("z") - own) / F.col("temperature")
    return powers.groupBy("temperature").agg(
        F.count(F.lit(1)).alias("n"), F.avg(loss).alias("nll"), F.avg(mean - own).alias("slope")
    )


def fit_temperature(
    df: DataFrame, logits: str, label_id: str, low: float = 0.05, high: float = 20.0, points: int = 16, rounds: int = 5
) -> float:
    """The temperature with the smallest mean loss between ``low`` and ``high``.

    The loss is convex in 1/T, so the sign of its slope brackets the minimum: each round
    reads the rows once for a grid and goes on between the two points where it turns.
    """
    a, b = 1.0 / high, 1.0 / low
    for _ in range(rounds):
        grid = [a + (b - a) * k / (points - 1) for k in range(points)]
        found = negative_log_likelihood(df, logits, label_id, [1.0 / g for g in grid]).collect()
        if not found:
            return 1.0
        slopes = [(1.0 / r["temperature"], r["slope"]) for r in found]
        below = [g for g, s in slopes if s < 0]
        above = [g for g, s in slopes if s >= 0]
        if not below or not above:
            return 1.0 / (min(above) if above else max(below))
        a, b = max(below), min(above)
    return 2.0 / (a + b)


def calibration_error(df: DataFrame, logits: str, label_id: str, temperature: float, bins: int = 10) -> DataFrame:
    """``n, accuracy, mean_confidence, error``: expected calibration error over equal bins."""
    z = F.transform(F.col(logits), lambda x: x.cast("double"))
    usable = F.col(logits).isNotNull() & ~F.exists(logits, lambda x: x.isNull()) & F.col(label_id).between(0, F.size(logits) - 1)
    rows = df.filter(usable).select(z.alias("z"), F.col(label_id).cast("int").alias("y"))
    rows = rows.select("z", "y", _scaled(F.col("z"), F.lit(float(temperature))).alias("p"))
    # The largest power is 1.
    sure = F.lit(1.0) / F.aggregate("p", F.lit(0.0), lambda a, b: a + b)
    right = (F.array_position("z", F.array_max("z")) - 1 == F.col("y")).cast("double")
    placed = rows.select(sure.alias("sure"), right.alias("right"))
    cells = placed.groupBy(F.least(F.floor(F.col("sure") * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("sure").alias("sure"), F.sum("right").alias("right")
    )
    n = F.sum("n")
    return cells.agg(
        F.coalesce(n, F.lit(0)).alias("n"),
        _ratio(F.sum("right"), n).alias("accuracy"),
        _ratio(F.sum("sure"), n).alias("mean_confidence"),
        _ratio(F.sum(F.abs(F.col("sure") - F.col("right"))), n).alias("error"),
    )
