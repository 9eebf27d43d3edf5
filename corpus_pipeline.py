"""From raw documents to packed sequences: five stages, each written and read again.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm.decontaminate import drop_contaminated
from recordlens.llm.exact_dedup import drop_copies
from recordlens.llm.language import keep_identified, learn
from recordlens.llm.near_dedup import drop_near_copies
from recordlens.llm.packing import pack
from recordlens.llm.queries import third_of, word_bpe
from recordlens.llm.store import stored, table

#: Bits per letter above which a text is in none of the languages. Text of a learned
#: language needs 2 to 8; letters that no automaton knows cost over 14 each.
MOST_BITS = 11.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the learned languages."""
    return keep_identified(docs, learn(docs.where(third_of() != 1)), most_bits=MOST_BITS)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact copies."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 4096 ids."""
    return pack(docs, word_bpe(), end_id=1, size=4096)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Cross-parsing and packing have no SQL; the tests rebuild the run from plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
