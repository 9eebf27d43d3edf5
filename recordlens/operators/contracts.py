"""Output contract, checked before anything is written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.domain import ID, LABEL, LABELS, in_domain


def contract_report(
    output: DataFrame, labels: Sequence[str] = LABELS, id_col: str = ID, label: str = LABEL
) -> DataFrame:
    """Row count, rows with a repeated id and labels outside the domain, in one pass over ids."""
    ids = output.groupBy(id_col).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(~in_domain(F.col(label), labels)).alias("bad"),
    )
    return ids.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_repeated_ids"),
        F.coalesce(F.sum("bad"), F.lit(0)).alias("n_invalid_labels"),
    )


def check_contract(
    output: DataFrame,
    n_input: int,
    labels: Sequence[str] = LABELS,
    id_col: str = ID,
    label: str = LABEL,
) -> None:
    """Raise on the first broken rule: row count, unique ids, labels in the domain."""
    found = contract_report(output, labels, id_col, label).first()
    if found["n_rows"] != n_input:
        raise RuntimeError(f"{n_input} records went in and {found['n_rows']} predictions came out")
    if found["n_repeated_ids"]:
        raise ValueError(f"{id_col} repeats in {found['n_repeated_ids']} rows")
    if found["n_invalid_labels"]:
        raise ValueError(f"{found['n_invalid_labels']} rows have a {label} outside the label domain")
