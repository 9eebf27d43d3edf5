"""Prediction over arriving JSONL files: the batch scorer on a stream.

Scoring is per row. What a stream needs besides is memory of the ids: a keyed state holds
how often an id has come, for ``REMEMBER`` after it last came, so an id that a later file
repeats is caught across batches and restarts. Columns and contract are checked per
micro-batch before that batch is written.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recordlens.domain import ID, LABELS, SCORING_COLUMNS
from recordlens.operators.contracts import check_contract
from recordlens.operators.scoring import Loader
from recordlens.plans.predict import predict
from recordlens.session import cut_lineage
from recordlens.sources.records import check_keys, parse_lines
from recordlens.sources.sinks import write_predictions

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: How long an id is remembered after it was last seen.
REMEMBER = 30 * 24 * 3600 * 1000

REPEATS = ("error", "drop")
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def stream_lines(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.text(folder)


def count_occurrences(lines: DataFrame, key: str = ID, remember_ms: int = REMEMBER) -> DataFrame:
    """``value`` and ``occurrence``: how many lines with the same key came before, in any batch.

    The state is one number per key that came within ``remember_ms``. Lines of one key are
    numbered in the order of their text, so a batch that is replayed numbers them alike.
    Lines without the key are not numbered (0) and share no state.
    """

    def number(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n = state.get[0] if state.exists else 0
        for part in parts:
            part = part.sort_values("value")
            yield pd.DataFrame({"value": part["value"].to_numpy(), "occurrence": range(n, n + len(part))})
            n += len(part)
        state.update((n,))
        state.setTimeoutDuration(remember_ms)

    found = F.get_json_object("value", f"$.{key}")
    # A line without a key is a key of its own.
    known = lines.select("value", F.coalesce(F.concat(F.lit("k"), found), F.concat(F.lit("-"), F.sha2("value", 256))).alias("id"))
    numbered = known.groupBy("id").applyInPandasWithState(
        number, "value string, occurrence long", "n long", "append", GroupStateTimeout.ProcessingTimeTimeout
    )
    keyless = F.get_json_object("value", f"$.{key}").isNull()
    return numbered.withColumn("occurrence", F.when(keyless, F.lit(0)).otherwise(F.col("occurrence")))


def predict_stream(
    spark: SparkSession,
    folder: str,
    target: str,
    checkpoint: str,
    loader: Loader,
    labels: Sequence[str] = LABELS,
    repeats: str = "error",
    remember_ms: int = REMEMBER,
) -> StreamingQuery:
    """Score every file that arrives in ``folder``; each batch writes its own folder,
    so a batch replayed after a failure overwrites itself.

    An id that came before stops the stream (``repeats="error"``), or its line is left out
    (``"drop"``).
    """
    if repeats not in REPEATS:
        raise ValueError(f"repeats must be one of {', '.join(REPEATS)}")

    def write(batch: DataFrame, batch_id: int) -> None:
        numbered = cut_lineage(batch)
        if numbered.isEmpty():
            return
        check_keys(numbered, SCORING_COLUMNS)
        again = numbered.filter("occurrence > 0")
        if repeats == "error" and not again.isEmpty():
            raise ValueError(f"{ID} repeats in {again.count()} rows")
        rows = cut_lineage(parse_lines(numbered.filter("occurrence = 0").select("value")))
        output = cut_lineage(predict(rows, loader, labels))
        check_contract(output, rows.count(), labels)
        write_predictions(output, f"{target}/batch={batch_id}")

    kept = stream_lines(spark, folder).filter(F.trim("value", F.lit(" \t\r\n")) != "")
    stream = (
        count_occurrences(kept, remember_ms=remember_ms)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
    )
    # Ids are forgotten when files arrive; batches without a file would never end.
    was = spark.conf.get(_EMPTY_BATCHES)
    spark.conf.set(_EMPTY_BATCHES, "false")
    try:
        return stream.start()
    finally:
        spark.conf.set(_EMPTY_BATCHES, was)
