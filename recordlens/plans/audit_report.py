"""The audit of a set of splits, as tables and as one JSON report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.domain import GROUP, ID, LABEL, LABELS, SPLIT_PAIRS, TEXT_FIELDS
from recordlens.functions.text import percent_finding, similarity_text
from recordlens.operators import audit, neighbors
from recordlens.session import cut_lineage
from recordlens.sources.sinks import write_report

# Row number that stands in for a textual record id in the neighbour search.
_ROW = "_row"


NOTE = "The audit reports near duplicates and changes no split; all of them stay in."


def audit_tables(records: DataFrame, labels: Sequence[str] = LABELS) -> dict[str, DataFrame]:
    """All audit sections over ``records`` (with a ``split`` column), which is read twice:
    once for the counts by row, once for the keys that duplicates and leakage compare."""
    counts = audit.RowCounts(records, labels)
    keys = [c for c in (ID, GROUP, LABEL) if c in records.columns]
    hashed = cut_lineage(audit.with_content_hash(records).select("split", *keys, "content_hash"))
    train = hashed.filter(F.col("split") == "train")
    single = audit.single_label_groups(train)
    return {
        "definitions": audit.definitions(records.sparkSession, neighbors.THRESHOLD),
        "dataset_sizes": counts.sizes(),
        "missing_values": counts.missing_values(),
        "duplicate_record_ids": audit.rows_after_first(hashed, ID),
        "empty_text_fields": counts.empty_text_fields(),
        "schema_validity": counts.schema_validity(),
        "train_label_distribution": audit.label_distribution(train, labels),
        "unique_groups": audit.unique_groups(hashed),
        "group_overlap": audit.split_overlap(hashed, GROUP),
        "group_isolation": audit.group_isolation(hashed),
        "duplicates_within_split": audit.rows_after_first(hashed, "content_hash"),
        "content_across_splits": audit.split_overlap(hashed, "content_hash"),
        "label_consistency": audit.label_consistency(hashed, "content_hash"),
        "literal_mentions": counts.literal_mentions(),
        "exact_name_labels": counts.exact_name_labels(),
        "group_label_concentration": single,
        "interpretation": _findings(single),
    }


def _findings(single: DataFrame) -> DataFrame:
    """One line for each thing that was counted, made from the counts and the settings."""
    pairs = ", ".join(f"{a} and {b}" for a, b in SPLIT_PAIRS)
    lines = [
        F.lit(f"A text counts for one of the {len(LABELS)} labels if it contains the label's name in lower case."),
        percent_finding(F.col("percentage"), f"of the values of {GROUP} in the training split occur with one label."),
        F.lit(f"{GROUP} is used for splitting only; texts are made from {', '.join(TEXT_FIELDS)}."),
        F.lit(f"Splits are compared by the values of {GROUP} that they share: {pairs}."),
    ]
    return single.select(F.posexplode(F.array(*lines)).alias("line", "finding"))


def near_duplicate_method() -> dict[str, object]:
    """How near duplicates were found."""
    return {
        "representation": f"TF-IDF of {', '.join(TEXT_FIELDS)}",
        "ngram_range": [1, 2],
        "min_df": neighbors.MIN_DF,
        "max_features": neighbors.MAX_FEATURES,
        "sublinear_tf": True,
        "similarity_metric": "cosine",
        "threshold": neighbors.THRESHOLD,
    }


def near_duplicate_tables(records: DataFrame) -> dict[str, DataFrame]:
    """Near duplicates of the training split: summary and top examples."""
    train = records.filter(F.col("split") == "train").select(ID, *TEXT_FIELDS, "category")
    # Fixed once, so every later read sees the same row numbers.
    rows = cut_lineage(train.withColumn(_ROW, F.monotonically_increasing_id()))
    text = similarity_text(*[F.col(c) for c in TEXT_FIELDS])
    found = neighbors.nearest_for_top(rows.select(_ROW, text.alias("_t")), _ROW, "_t")
    near = found.filter(F.col("similarity") >= neighbors.THRESHOLD)
    top = neighbors.top_pairs(found, rows, _ROW, "name", "category")
    ids = rows.select(_ROW, ID)
    # Twenty rows: give back the record ids.
    for side in ("a", "b"):
        named = ids.select(F.col(_ROW).alias(f"record_id_{side}"), F.col(ID).alias(f"_id_{side}"))
        top = named.join(F.broadcast(top), f"record_id_{side}")
    examples = top.select(
        "similarity",
        F.col("_id_a").alias("record_id_a"),
        F.col("_id_b").alias("record_id_b"),
        "name_a",
        "name_b",
        "label_a",
        "label_b",
    ).orderBy(F.desc("similarity"), "record_id_a")
    return {
        "near_duplicate_summary": neighbors.near_duplicate_summary(near, rows),
        "near_duplicate_examples": examples,
    }


def audit_document(records: DataFrame, labels: Sequence[str] = LABELS) -> dict[str, object]:
    """The report as nested Python values. Every table here is bounded by splits,
    columns, statuses, labels or the number of examples."""
    tables = {**audit_tables(records, labels), **near_duplicate_tables(records)}
    document: dict[str, object] = {
        name: [row.asDict(recursive=True) for row in df.collect()] for name, df in tables.items()
    }
    document["split_pairs"] = [f"{a}_{b}" for a, b in SPLIT_PAIRS]
    document["test_labels"] = audit.NOT_EVALUABLE
    document["near_duplicate_method"] = near_duplicate_method()
    document["near_duplicate_note"] = NOTE
    return document


def write_audit(records: DataFrame, path: str, labels: Sequence[str] = LABELS) -> None:
    write_report(records.sparkSession, audit_document(records, labels), path)
