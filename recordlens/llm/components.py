"""Connected components of links, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of the links ``a, b``: the smallest node it reaches.

    In each round a node takes the smallest label around it and then that label's own label,
    so long chains shorten by half; rounds end when no label changes. Sums and minima are
    combined before the shuffle, and a node with many links is never one task's work.
    """
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = links.select(F.explode(ends).alias("e")).select("e.a", "e.b")
    edges = stored(both.distinct(), "links")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
                    .select("node", F.least("node", "label").alias("label")), "labels")
    while True:
        near = (
            edges.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        own = labels.select(F.col("node").alias("label"), F.col("label").alias("jump"))
        labels = stored(
            lower.join(own, "label", "left").select("node", "old", F.least("label", F.coalesce("jump", "label")).alias("label")),
            "labels",
        )
        changed = not labels.where("old <> label").isEmpty()
        labels = labels.select("node", "label")
        if not changed:
            return labels
