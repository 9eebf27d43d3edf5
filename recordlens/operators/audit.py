"""Audit of record splits: missing data, duplicates, leakage, label shortcuts.

Input tables carry a ``split`` column. Every count is a grouped aggregate with
map-side partial aggregation, so one key holding a large share of the rows
shrinks to one row per map task before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.domain import (
    GROUP,
    ID,
    LABEL,
    LABELS,
    SPLIT_PAIRS,
    SPLITS,
    TEXT_FIELDS,
    label_dim,
)
from recordlens.functions.schema_text import SCHEMA_STATUSES, schema_status
from recordlens.functions.text import content_hash, field, is_blank, mentions, percent
from recordlens.session import cut_lineage

# The keys are fixed by the report.
DEFINITIONS = {
    "missing_values": "How often a column is NULL, by split; absent keys are NULL too.",
    "empty_text_fields": "Rows by split whose text column is blank: NULL, empty or white space alone.",
    "schema_validity": (
        "Rows by split for each outcome of reading input_schema. Blank is missing; two values, "
        "or none that parses, is malformed; arrays, numbers, strings and the like are non_object."
    ),
    "exact_duplicates": (
        "Rows are equal if the SHA-256 over their three text columns is. A split counts its rows "
        "less its distinct hashes; a pair of splits counts the hashes it has in common."
    ),
    "literal_category_occurrences": (
        "Per text column or group, and per label: train rows that have the label in them, "
        "as part of a word or not, in upper or lower case."
    ),
    "exact_category_tool_names": "Per label: train rows named exactly like it but for case.",
    "near_duplicates": (
        "Train rows for which some further train row has a cosine of at least {threshold}, "
        "both as TF-IDF vectors of words and word pairs."
    ),
}

NOT_EVALUABLE = "The test split has no labels to compare."


def definitions(spark, threshold: float = 0.9) -> DataFrame:
    """What each reported number counts."""
    rows = [(name, text.format(threshold=threshold)) for name, text in DEFINITIONS.items()]
    return spark.createDataFrame(rows, "metric string, definition string")


def audited_columns(df: DataFrame) -> list[str]:
    """Audited columns; the label only where the split has one."""
    return [ID, GROUP, *TEXT_FIELDS] + ([LABEL] if LABEL in df.columns else [])


def with_content_hash(df: DataFrame, column: str = "content_hash") -> DataFrame:
    return df.withColumn(column, content_hash(*[F.col(c) for c in TEXT_FIELDS]))


def _long(df: DataFrame, keys: Sequence[str], names: Sequence[str], name: str) -> DataFrame:
    """Wide counts to ``(keys, name, n)``."""
    pairs = F.array(*[F.struct(F.lit(c).alias(name), F.col(f"`{c}`").alias("n")) for c in names])
    return df.select(*keys, F.explode(pairs).alias("_e")).select(*keys, f"_e.{name}", "_e.n")


def _mention_cells(fields: Sequence[str], labels: Sequence[str]) -> list[tuple[str, str]]:
    return [(f, label) for f in fields for label in labels]


class RowCounts:
    """Every count that looks at one row at a time, for all splits, from one pass.

    ``wide`` has a row per split and is written once; the tables only rename its columns.
    """

    def __init__(self, df: DataFrame, labels: Sequence[str] = LABELS, train: str = "train"):
        self.columns, self.labels, self.train = audited_columns(df), list(labels), train
        self.cells = _mention_cells((*TEXT_FIELDS, GROUP), labels)
        status = schema_status(F.col("input_schema"), is_blank(F.col("input_schema")))
        lowered = F.lower(field(F.col("name")))
        rows = df.withColumn("_status", status)
        counts = {"rows": F.count(F.lit(1))}
        counts |= {f"null {c}": F.count_if(F.col(c).isNull()) for c in self.columns}
        counts |= {f"blank {c}": F.count_if(is_blank(F.col(c))) for c in TEXT_FIELDS}
        counts |= {f"status {s}": F.count_if(F.col("_status") == s) for s in SCHEMA_STATUSES}
        counts |= {f"mention {f} {x}": F.count_if(mentions(F.col(f), x)) for f, x in self.cells}
        counts |= {f"named {x}": F.count_if(lowered == x.lower()) for x in labels}
        self.wide = cut_lineage(rows.groupBy("split").agg(*[c.alias(n) for n, c in counts.items()]))

    def _table(self, prefix: str, names: Sequence[str], column: str) -> DataFrame:
        wide = self.wide.select("split", *[F.col(f"`{prefix} {n}`").alias(n) for n in names])
        return _long(wide, ["split"], list(names), column)

    def sizes(self) -> DataFrame:
        return self.wide.select("split", F.col("rows").alias("n"))

    def missing_values(self) -> DataFrame:
        return self._table("null", self.columns, "column")

    def empty_text_fields(self) -> DataFrame:
        return self._table("blank", TEXT_FIELDS, "column")

    def schema_validity(self) -> DataFrame:
        return self._table("status", SCHEMA_STATUSES, "status")

    def literal_mentions(self) -> DataFrame:
        cells = F.array(
            *[
                F.struct(F.lit(f).alias("field"), F.lit(x).alias("label"), F.col(f"`mention {f} {x}`").alias("n"))
                for f, x in self.cells
            ]
        )
        own = self.wide.filter(F.col("split") == self.train)
        return own.select(F.explode(cells).alias("c")).select("c.*")

    def exact_name_labels(self) -> DataFrame:
        return self._table("named", self.labels, "label").filter(F.col("split") == self.train).drop("split")


def dataset_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def missing_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NULLs per split and column, all columns in one pass."""
    columns = list(columns or audited_columns(df))
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return _long(df.groupBy("split").agg(*counts), ["split"], columns, "column")


def empty_text_fields(df: DataFrame, columns: Sequence[str] = TEXT_FIELDS) -> DataFrame:
    counts = [F.count_if(is_blank(F.col(c))).alias(c) for c in columns]
    return _long(df.groupBy("split").agg(*counts), ["split"], list(columns), "column")


def rows_after_first(df: DataFrame, key: str, by: str = "split") -> DataFrame:
    """Duplicate count per split: rows beyond the first of each key, NULLs equal."""
    groups = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    return groups.groupBy(by).agg(F.sum(F.col("n") - 1).alias("n"))


def later_copies(df: DataFrame, key: str, id_col: str = ID, by: str = "split") -> DataFrame:
    """Flag every row that is not the first of its key in its split; NULL keys are equal.

    First is the lowest id, NULL after all others; of rows that repeat it, one. Rows get
    a number of their own, and the first rows, found by an aggregate, are joined back on
    it, so neither a hot key nor a repeated id gathers or multiplies rows.
    """
    rows = cut_lineage(df.withColumn("_row", F.monotonically_increasing_id()))
    order = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "_row")
    firsts = rows.groupBy(by, key).agg(F.min(order).alias("f")).select(
        F.col("f._row").alias("_row"), F.lit(False).alias("_d")
    )
    return rows.join(firsts, "_row", "left").withColumn(
        "is_duplicate", F.coalesce("_d", F.lit(True))
    ).drop("_d", "_row")


def schema_validity(df: DataFrame, column: str = "input_schema") -> DataFrame:
    """Rows per split and schema status, all four statuses listed."""
    status = schema_status(F.col(column), is_blank(F.col(column)))
    counts = df.select("split", status.alias("status")).groupBy("split").agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in SCHEMA_STATUSES]
    )
    return _long(counts, ["split"], SCHEMA_STATUSES, "status")


def label_distribution(
    df: DataFrame, labels: Sequence[str] = LABELS, column: str = LABEL
) -> DataFrame:
    """Count and share of all rows per label, zero-filled, in label order."""
    counted = df.groupBy(F.col(column).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    filled = zero_fill(counted, labels)
    # NULL labels have a count of their own, so this is every row.
    total = counted.agg(F.sum("n")).scalar()
    return filled.withColumn("percentage", percent(F.col("n"), F.nullif(total, F.lit(0))))


def zero_fill(counts: DataFrame, labels: Sequence[str], column: str = "n") -> DataFrame:
    """Join counts to the label domain; labels without rows count 0."""
    dim = label_dim(counts.sparkSession, labels)
    # The counts hold at most one row per label, so both sides are tiny.
    return dim.join(counts, "label", "left").select(
        "label_id", "label", F.coalesce(column, F.lit(0)).alias(column)
    )


def _presence(df: DataFrame, key: str, splits: Sequence[str]) -> DataFrame:
    """One row per key with a bit per split it occurs in."""
    bits = F.lit(0)
    for i, name in enumerate(splits):
        bits = F.when(F.col("split") == name, F.lit(1 << i)).otherwise(bits)
    return df.groupBy(key).agg(F.bit_or(bits).alias("mask"))


def unique_groups(df: DataFrame, key: str = GROUP) -> DataFrame:
    """Distinct keys per split; NULL is a key."""
    return (
        df.groupBy("split", key).agg(F.lit(1).alias("one"))
        .groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    )


def split_overlap(
    df: DataFrame, key: str, pairs: Sequence[tuple[str, str]] = SPLIT_PAIRS
) -> DataFrame:
    """Keys present in both splits of each pair, from one shuffle for all pairs."""
    masks = _presence(df, key, SPLITS)

    def both(a: str, b: str) -> Column:
        need = (1 << SPLITS.index(a)) | (1 << SPLITS.index(b))
        return F.count_if(F.col("mask").bitwiseAND(need) == need)

    names = [f"{a}_{b}" for a, b in pairs]
    wide = masks.agg(*[both(a, b).alias(n) for n, (a, b) in zip(names, pairs)])
    return _long(wide, [], names, "pair")


def group_isolation(df: DataFrame, key: str = GROUP) -> DataFrame:
    """Single row: True when no key occurs in two splits."""
    return split_overlap(df, key).agg(F.coalesce(F.bool_and(F.col("n") == 0), F.lit(True)).alias("passed"))


def label_sets(df: DataFrame, key: str, label: str = LABEL) -> DataFrame:
    """Sorted distinct labels per key; bounded by the label domain."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(label)).alias("labels"))


def label_consistency(
    df: DataFrame, key: str, a: str = "train", b: str = "validation", label: str = LABEL
) -> DataFrame:
    """Content groups shared by two splits, and those whose label sets differ.

    A label seen in only one of the splits makes the sets differ. Works on
    (key, label) pairs, so no set is ever built.
    """
    sides = df.filter(F.col("split").isin(a, b))
    bit = F.when(F.col("split") == a, 1).otherwise(2)
    pairs = sides.groupBy(key, label).agg(F.bit_or(bit).alias("mask"))
    groups = pairs.groupBy(key).agg(
        F.bit_or("mask").alias("seen"), F.bool_or(F.col("mask") != 3).alias("differs")
    )
    shared = F.col("seen") == 3
    return groups.agg(
        F.count_if(shared).alias("shared_groups"),
        F.count_if(shared & F.col("differs")).alias("conflicting_groups"),
    )


def single_label_groups(df: DataFrame, key: str = GROUP, label: str = LABEL) -> DataFrame:
    """How many groups hold exactly one distinct label. NULL keys and labels are left out."""
    distinct = (
        df.filter(F.col(key).isNotNull())
        .groupBy(key, label).agg(F.lit(1).alias("one"))
        .groupBy(key).agg(F.count(label).alias("n_labels"))
    )
    single, total = F.count_if(F.col("n_labels") == 1), F.count(F.lit(1))
    return distinct.agg(single.alias("single_label_groups"), total.alias("total_groups")).withColumn(
        "percentage", percent(F.col("single_label_groups"), F.nullif("total_groups", F.lit(0)))
    )


def literal_mentions(
    df: DataFrame,
    fields: Sequence[str] = (*TEXT_FIELDS, GROUP),
    labels: Sequence[str] = LABELS,
) -> DataFrame:
    """Rows per field and label whose field contains the label word; one scan."""
    counts = [
        F.count_if(mentions(F.col(f), label)).alias(f"{i}_{j}")
        for i, f in enumerate(fields)
        for j, label in enumerate(labels)
    ]
    cells = [
        F.struct(F.lit(f).alias("field"), F.lit(label).alias("label"), F.col(f"{i}_{j}").alias("n"))
        for i, f in enumerate(fields)
        for j, label in enumerate(labels)
    ]
    return df.agg(*counts).select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def exact_name_labels(
    df: DataFrame, name: str = "name", labels: Sequence[str] = LABELS
) -> DataFrame:
    """Rows per label whose lower-cased name is exactly the label word."""
    lowered = F.lower(field(F.col(name)))
    wide = df.agg(*[F.count_if(lowered == x.lower()).alias(x) for x in labels])
    return _long(wide, [], list(labels), "label")
