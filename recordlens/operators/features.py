"""TF-IDF over word 1-2-grams: sublinear tf, smooth idf, L2-normalised rows.

Fitting a table of much text counts its segments first. What a segment has once only is not
dealt out: the counts of the others bound what such terms can have in all, and the terms
that may be among the most frequent are then counted exactly. Vectorising looks the terms up
in the tasks that read the texts and shuffles packed counts by key, some two bytes a term.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recordlens import session
from recordlens.functions.text import with_bigrams, words
from recordlens.operators.arrow_terms import (
    LOOKUP_WORDS,
    counts_of,
    frequent_in_segments,
    known_terms,
    lengths,
    packed_counts,
    packed_entries,
    parts,
    single_words,
    unpacked_counts,
    weighed,
    word_pairs,
)
from recordlens.session import broadcast_if_small, cut_lineage, shuffle_partitions, stored, text_tasks

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Text of fewer bytes is counted term by term.
SEGMENTED_BYTES = 64 * 1024 * 1024
#: Bytes a term takes in a task that looks terms up, beside its letters.
TERM_BYTES = 150
#: Times a segment has a term that is dealt out with its counts, at least.
LEAST = 2


def grams(df: DataFrame, text: str, *keep: str, bigrams: bool = True) -> DataFrame:
    """``keep`` columns plus ``terms``: words, then adjacent pairs."""
    tokens = df.select(*keep, words(F.col(text)).alias("_words"))
    terms = with_bigrams(F.col("_words")) if bigrams else F.col("_words")
    return tokens.select(*keep, terms.alias("terms"))


def term_statistics(df: DataFrame, text: str, bigrams: bool = True) -> DataFrame:
    """Document frequency and corpus count per term.

    Terms are sorted inside the row, so the first of a run marks a new document
    for its term and one aggregate gives both counts. ``explode_outer`` keeps the
    optimizer from copying the tokenizer into a size filter.
    """
    ordered = grams(df, text, bigrams=bigrams).select(F.sort_array("terms").alias("terms"))

    def mark(term: Column, i: Column) -> Column:
        repeated = (i > 0) & (F.get("terms", i - 1) == term)
        return F.struct(term.alias("term"), F.when(repeated, 0).otherwise(1).alias("new"))

    rows = ordered.select(F.explode_outer(F.transform("terms", mark)).alias("e")).select("e.*")
    counted = rows.groupBy("term").agg(
        F.sum("new").alias("df"), F.count(F.lit(1)).alias("ctf")
    )
    return counted.filter(F.col("term").isNotNull())


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + 1.0


def most_frequent_terms(stats: DataFrame, max_features: int) -> DataFrame:
    """The ``max_features`` terms with the highest corpus count, ties by term.

    A histogram of the counts gives the count at the cut, one row for the driver.
    Every term above it stays, and of the terms exactly at it the first by name:
    a sort with a known limit, which each task applies to its own rows first. The
    histogram has one row per distinct count, which grows at most with the square
    root of the corpus. ``stats`` is read several times.
    """
    histogram = stats.groupBy("ctf").agg(F.count(F.lit(1)).alias("n"))
    falling = Window.orderBy(F.desc("ctf"))
    running = histogram.withColumn("upto", F.sum("n").over(falling))
    # First count whose running total reaches the limit, and how many terms lie above it.
    cut = running.filter(F.col("upto") >= max_features).agg(
        F.max("ctf").alias("ctf"), F.max_by(F.col("upto") - F.col("n"), "ctf").alias("above")
    ).first()
    if cut["ctf"] is None:
        return stats
    at_cut = stats.filter(F.col("ctf") == cut["ctf"]).orderBy("term").limit(max_features - cut["above"])
    return stats.filter(F.col("ctf") > cut["ctf"]).unionByName(at_cut)


def _fits_a_task(terms: DataFrame) -> bool:
    """Whether a task can hold the terms, by their measured size."""
    size = terms.agg(F.sum(F.octet_length("term") + F.lit(TERM_BYTES))).first()[0] or 0
    return size <= session.BROADCAST_BYTES


def _lookup(terms: list[str], bigrams: bool):
    return single_words(terms), word_pairs(terms) if bigrams else None


def _frequent_statistics(
    df: DataFrame, text: str, min_df: int, max_features: int, bigrams: bool
) -> DataFrame | None:
    """``(term, df, ctf)`` of all terms that may be among the ``max_features`` most frequent.

    Segments of the text tell what they have ``LEAST`` times or more. The counts so found are
    those of a term at least, and what a segment did not tell of adds less than ``LEAST``. The
    ``max_features``-th highest count found is one that the cut does not lie below; terms that
    cannot reach it are left out, and the others are counted in all rows. None if that does
    not hold for terms no segment told of, or if the terms do not fit a task.
    """
    tokens = df.select(words(F.col(text)).alias("_words"))
    told = tokens.mapInArrow(
        lambda batches: frequent_in_segments(batches, LEAST, bigrams), "term string, df long, ctf long"
    )
    sums = [F.count(F.lit(1)).alias("n"), F.sum("df").alias("df"), F.sum("ctf").alias("ctf")]
    found = stored(told.groupBy("term").agg(*sums), "segments")
    segments = found.filter("term IS NULL").agg(F.sum("n")).first()[0] or 0
    found = found.filter("term IS NOT NULL")
    falling = Window.orderBy(F.desc("ctf"))
    histogram = found.filter(F.col("df") >= min_df).groupBy("ctf").agg(F.count(F.lit(1)).alias("n"))
    least = histogram.withColumn("upto", F.sum("n").over(falling)).filter(F.col("upto") >= max_features)
    cut = least.agg(F.max("ctf")).first()[0]
    untold = LEAST - 1
    if cut is None or cut <= segments * untold:
        return None
    possible = found.filter(F.col("ctf") + (segments - F.col("n")) * untold >= cut).select("term")
    if not _fits_a_task(possible):
        return None
    terms = possible.toArrow().column("term").to_pylist()
    spark, n = df.sparkSession, len(terms)
    state = spark.sparkContext.broadcast(_lookup(terms, bigrams))
    # Each task adds up its counts, so there are only so many tasks as there are cores.
    counted = tokens.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(
        lambda batches: counts_of(batches, n, state.value), "ix int, df long, ctf long"
    )
    counts = counted.groupBy("ix").agg(F.sum("df").alias("df"), F.sum("ctf").alias("ctf"))
    rows = counts.filter(F.col("df") >= min_df).toArrow()
    names = _take(terms, rows.column("ix").to_numpy())
    return spark.createDataFrame(rows.drop_columns(["ix"]).add_column(0, "term", names))


def _take(terms: list[str], at: np.ndarray):
    import pyarrow as pa

    return pa.array(terms, pa.string()).take(pa.array(at))


def fit_vocabulary(
    df: DataFrame,
    text: str,
    min_df: int = 2,
    max_features: int = 100_000,
    bigrams: bool = True,
) -> DataFrame:
    """Fitted vocabulary ``(term, df, ctf, idf, ix)``; ``ix`` counts from the rarest term."""
    if max_features < 1:
        raise ValueError("max_features must be positive")
    spark = df.sparkSession
    n_docs, size = df.agg(F.count(F.lit(1)), F.sum(F.octet_length(text))).first()
    # Read several times below, so it is written once; the tokenizer runs once.
    with shuffle_partitions(spark, text_tasks(spark, size)):
        stats = None
        if (size or 0) > SEGMENTED_BYTES:
            stats = _frequent_statistics(df, text, min_df, max_features, bigrams)
        if stats is None:
            stats = cut_lineage(term_statistics(df, text, bigrams).filter(F.col("df") >= min_df))
    kept = most_frequent_terms(stats, max_features)
    # At most max_features rows reach this ordering.
    rare_first = Window.orderBy("df", "term")
    fitted = kept.select(
        "term",
        "df",
        "ctf",
        smooth_idf(F.col("df"), F.lit(n_docs)).alias("idf"),
        (F.row_number().over(rare_first) - 1).alias("ix"),
    )
    return cut_lineage(fitted)


def count_entries(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, bigrams: bool = True
) -> tuple[DataFrame | None, np.ndarray]:
    """``(key, gaps, more)``, the packed counts of the known terms of each row, and the idf of
    each term; no rows but ``None`` if the vocabulary does not fit a task. Nothing is shuffled."""
    small = _fits_a_task(vocabulary)
    rows = vocabulary.select("ix", "idf", *["term"] * small).toArrow()
    ix = rows.column("ix").to_numpy()
    idf = np.zeros(int(ix.max(initial=-1)) + 1)
    idf[ix] = rows.column("idf").to_numpy()
    if not small:
        return None, idf
    terms = [""] * len(idf)
    for k, term in zip(ix.tolist(), rows.column("term").to_pylist()):
        terms[k] = term
    state = df.sparkSession.sparkContext.broadcast(_lookup(terms, bigrams))
    n = max(len(terms), 1)
    tokens = df.select(words(F.col(text)).alias("_words"), F.col(key))
    kind = tokens.schema[key].dataType.simpleString()
    packed = tokens.mapInArrow(
        lambda batches: _packed(batches, state.value, n), f"`{key}` {kind}, gaps binary, more binary"
    )
    return packed, idf


def _packed(batches, state, terms: int):
    import pyarrow as pa

    words, pairs = state
    for batch in batches:
        for first, rows in parts(batch.column(0), LOOKUP_WORDS):
            ids, row = known_terms(rows, words, pairs)
            columns = [batch.column(1).slice(first, len(rows)), *packed_counts(ids, row, len(rows), terms)]
            yield pa.RecordBatch.from_arrays(columns, [batch.schema.names[1], "gaps", "more"])


def entries_column(spark, idf: np.ndarray) -> Column:
    """``v array<struct<ix, tf, w>>`` of packed counts: the normalised entries, rarest first."""
    sent = spark.sparkContext.broadcast(idf)

    @F.arrow_udf("array<struct<ix: int, tf: int, w: double>>")
    def entries(gaps, more):
        import pyarrow as pa

        length, ix, tf = unpacked_counts(gaps, more)
        columns = [pa.array(ix, pa.int32()), pa.array(tf, pa.int32()), pa.array(weighed(length, ix, tf, sent.value), pa.float64())]
        ends = pa.array(np.append(0, np.cumsum(length)).astype(np.int32))
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["ix", "tf", "w"]))

    return entries("gaps", "more")


def packed_column(entries: Column) -> Column:
    """``struct<gaps, more>`` of an array of entries in the order of their terms."""

    @F.arrow_udf("struct<gaps: binary, more: binary>")
    def packed(v):
        import pyarrow as pa

        flat = v.flatten()
        ix, tf = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        return pa.StructArray.from_arrays(packed_entries(lengths(v), ix, tf), ["gaps", "more"])

    return packed(entries)


def _repeated_keys(df: DataFrame, key: str) -> DataFrame | None:
    """The keys that more than one row has, or ``None``."""
    again = cut_lineage(df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col(key).alias("_key")))
    return None if again.isEmpty() else again


def packed_tfidf(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, bigrams: bool = True
) -> tuple[DataFrame, np.ndarray, int]:
    """``(key, gaps, more)`` of each key, the idf of each term, and the tasks the texts need.

    Terms outside the vocabulary drop out; rows with the same key are one document. A task that
    reads texts looks their terms up if it can hold the vocabulary, by its measured size. Rows
    whose key is repeated, or all rows beyond a larger vocabulary, go by a shuffle of their texts.
    """
    size = df.agg(F.sum(F.octet_length(text))).first()[0]
    n = text_tasks(df.sparkSession, size)
    again = _repeated_keys(df, key)
    same = None if again is None else F.col(key).eqNullSafe(F.col("_key"))
    once = df if again is None else df.join(again, same, "left_anti")
    packed, idf = count_entries(once, key, text, vocabulary, bigrams)
    rest = df if packed is None else None if again is None else df.join(again, same, "left_semi")
    if rest is not None:
        entries = _shuffled_entries(rest, key, text, vocabulary, n, bigrams)
        gathered = entries.select(key, packed_column(F.col("v")).alias("c")).select(key, "c.gaps", "c.more")
        packed = gathered if packed is None else packed.unionByName(gathered)
    return packed, idf, n


def tfidf_entries(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, bigrams: bool = True
) -> DataFrame:
    """``(key, v)`` with ``v array<struct<ix, tf, w>>`` the normalised entries, rarest first.

    A document without any known term keeps an empty array. Only packed counts are partitioned
    by key, once, and in as many partitions as the texts need, by their measured size, so a
    task holds no more of a larger table.
    """
    packed, idf, n = packed_tfidf(df, key, text, vocabulary, bigrams)
    return packed.repartition(n, key).select(key, entries_column(df.sparkSession, idf).alias("v"))


def _shuffled_entries(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, n: int, bigrams: bool
) -> DataFrame:
    """The same by ``n`` partitions of the texts by key: terms are counted and gathered by key
    without a second shuffle. The vocabulary is broadcast if its measured size allows it, and
    joined by shuffle beyond that."""
    by_key = df.select(key, text).repartition(n, key)
    terms = grams(by_key, text, key, bigrams=bigrams)
    rows = terms.select(key, F.explode_outer("terms").alias("term"))
    known = broadcast_if_small(vocabulary.select("term", "ix", "idf"), F.octet_length("term"))
    found = rows.join(known, "term", "left")
    counted = found.groupBy(key, "ix").agg(
        F.count(F.lit(1)).cast("int").alias("tf"), F.first("idf").alias("idf")
    )
    weight = (F.lit(1.0) + F.log(F.col("tf"))) * F.col("idf")
    entry = F.when(F.col("ix").isNotNull(), F.struct("ix", "tf", weight.alias("w")))
    # The norm is an aggregate of its own: as a fold over ``v`` it would be
    # recomputed for every element it divides.
    gathered = counted.groupBy(key).agg(
        F.sort_array(F.collect_list(entry)).alias("v"),
        F.sqrt(F.sum(weight * weight)).alias("norm"),
    )
    return gathered.select(
        key,
        F.transform(
            "v",
            lambda e: F.struct(
                e["ix"].alias("ix"), e["tf"].alias("tf"), (e["w"] / F.col("norm")).alias("w")
            ),
        ).alias("v"),
    )
