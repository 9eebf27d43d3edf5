"""Exact copies by progressive refinement.

Rows are grouped by the length of their normalised text, then, inside lengths that
occur twice, by a hash of its first characters, and only rows whose length and start
occur twice are hashed in full. Each grouping is an aggregate with map-side combining,
so a group holding a third of the rows is a few rows per task. What passes from one
level to the next is a bit map of fixed size (``marks``); no text is ever shuffled.

Defined results: a null text is an empty text; a null id sorts after all others; rows
that repeat an id and a text are copies of each other, one of which is kept; further
columns are ignored by ``exact_groups`` and carried by ``drop_copies``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.marks import marks, with_mark
from recordlens.llm.store import stored

START_CHARS = 128


def normalised(text: str | Column) -> Column:
    """The text with each run of ASCII white space as one space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _start_key() -> Column:
    return F.xxhash64("_length", F.substring("_norm", 1, START_CHARS))


def suspects(docs: DataFrame, text: str) -> DataFrame:
    """Bit map of the (length, start) keys that two rows or more share."""
    keys = stored(
        docs.select(normalised(text).alias("_norm"))
        .withColumn("_length", F.length("_norm"))
        .select("_length", _start_key().alias("_start")),
        "lengths-and-starts",
    )
    lengths = keys.groupBy("_length").count().where("count > 1").select("_length")
    starts = keys.join(lengths, "_length", "left_semi").groupBy("_start").count()
    return marks(starts.where("count > 1"), F.col("_start"))


def _with_digest(docs: DataFrame, text: str) -> DataFrame:
    """Add ``_norm``, and ``_digest``, which stays null for rows that cannot have a copy."""
    rows = docs.withColumn("_norm", normalised(text)).withColumn("_length", F.length("_norm"))
    rows = with_mark(rows, suspects(docs, text), _start_key(), "_suspect")
    return rows.withColumn("_digest", F.when(F.col("_suspect"), F.sha2("_norm", 256)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Of equal normalised texts the row with the smallest id is kept.
    """
    rows = _with_digest(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text")
    rows = stored(
        rows.select(
            F.col("_id").alias(id_col),
            F.monotonically_increasing_id().alias("_row"),
            F.coalesce("_digest", F.sha2("_norm", 256)).alias("text_sha256"),
            F.col("_digest").isNotNull().alias("_hashed"),
        ),
        "digests",
    )
    order = F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("id"), F.col("_row").alias("r"))
    groups = (
        rows.where("_hashed")
        .groupBy(F.col("text_sha256").alias("_key"))
        .agg(F.min(order).alias("_first"), F.count("*").alias("group_size"))
        .where("group_size > 1")
    )
    joined = rows.where("_hashed").join(groups, F.col("text_sha256") == F.col("_key"), "left")
    alone = F.col("_first").isNull()
    copies = joined.select(
        id_col,
        F.when(alone, F.col(id_col)).otherwise(F.col("_first.id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("_first.r") == F.col("_row"))).alias("kept"),
        "text_sha256",
    )
    singles = rows.where("NOT _hashed").select(
        id_col, F.col(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    return singles.unionByName(copies)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns.

    Rows that cannot have a copy pass without a shuffle. The others are digested; those
    whose digest occurs once pass too, and of each larger group the first row is chosen
    by an aggregate, so that no group is ever in one place.
    """
    columns = docs.columns
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_doc"))
    whole = whole.withColumn("_text", F.col(f"_doc.`{text}`")).withColumn("_id", F.col(f"_doc.`{id_col}`"))
    rows = _with_digest(whole, "_text")
    order = F.struct(F.col("_id").isNull(), F.col("_id"), F.xxhash64("_doc"))
    first = (
        rows.where("_digest IS NOT NULL")
        .groupBy("_digest")
        .agg(F.min_by("_doc", order).alias("_doc"))
    )
    return rows.where("_digest IS NULL").select("_doc").unionByName(first.select("_doc")).select("_doc.*")
