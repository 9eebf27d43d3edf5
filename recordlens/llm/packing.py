"""Packing documents into sequences by patterns.

Documents become token ids with an end id; longer ones are cut into pieces of the sequence
length. Only the histogram of piece lengths, one number per length, reaches the driver.
There, patterns of few lengths that nearly fill a sequence are enumerated, repeat counts
are fitted to the histogram by non-negative least squares and rounded down, and what is
left is packed largest first, each time with the best-fitting lengths, a pattern being
repeated as often as the histogram allows. The work there depends on the number of lengths,
not of documents. Pieces then find their place from their rank among pieces of their length.

Defined results: a null text is empty and is the end id alone; rows repeating an id are
packed as rows of their own; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.store import stored
from recordlens.llm.token_ids import token_ids, utf8

_STARTS_PER_LENGTH = 6
_LENGTHS_PER_PATTERN = 8


def pieces(
    docs: DataFrame, tokenizer: str, end_id: int, size: int, id_col: str = "doc_id",
    text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Documents as pieces of at most ``size`` ids, numbered by length within each task."""
    kind = f"{id_col} long, piece int, start long, length long, ids_crc32 long, part int, place long"
    fields = [(id_col, pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("part", pa.int32()), ("place", pa.int64())]
    if with_ids:
        kind += ", ids array<long>"
        fields.append(("ids", pa.list_(pa.int64())))
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = token_ids(tokenizer), np.array([end_id], np.uint32)
        part, seen = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                rows = []
                for key, found in zip(some.column(0).to_pylist(), encoder.encode(utf8(some.column(1)))):
                    ids = np.concatenate([found, end])
                    for piece, start in enumerate(range(0, len(ids), size)):
                        own = ids[start : start + size]
                        row = (key, piece, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), part, seen[len(own)])
                        rows.append(row + ((own.tolist(),) if with_ids else ()))
                        seen[len(own)] += 1
                yield pa.RecordBatch.from_pydict({n: list(c) for n, c in zip(schema.names, zip(*rows))}, schema)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(cut, kind)


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, size: int = 4096, id_col: str = "doc_id",
    text: str = "text", with_ids: bool = False,
) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``; ``with_ids`` adds their ids."""
    cut = stored(pieces(docs, tokenizer, end_id, size, id_col, text, with_ids), "pieces")
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # Rank among all pieces of a length: the tasks before, then the place in the task.
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    bases = counts.select("part", "length", before.alias("base"))
    ranked = cut.join(bases, ["part", "length"]).withColumn("rank", F.col("base") + F.col("place"))

    totals = np.zeros(size + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():
        totals[row["length"]] = row["n"]
    slots = ranked.sparkSession.sparkContext.broadcast(slot_table(pattern_plan(totals)))

    columns = [id_col, "piece", "start", "length", "ids_crc32"] + (["ids"] if with_ids else [])
    out = ranked.select(*columns, "rank")
    names = [*columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, sequence, offset = slots.value
        for batch in batches:
            rank = batch.column(len(columns)).to_numpy(zero_copy_only=False)
            length = batch.column(columns.index("length")).to_numpy(zero_copy_only=False)
            at = np.searchsorted(key, (length << _RANK_BITS) + rank, "right") - 1
            found = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + found, names)

    kinds = dict(out.dtypes)
    return out.mapInArrow(place, ", ".join([f"{c} {kinds[c]}" for c in columns] + ["sequence_id long", "offset long"]))


# Ranks below 2^50 leave room for lengths below 2^13 in a signed 64-bit key.
_RANK_BITS = 50


def slot_table(plan: list[tuple[int, list[int]]]):
    """Where the pieces of each length go, as runs of ranks: sorted keys (length, first
    rank), first ranks, first sequences and offsets."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for times, lengths in plan:
        offset = 0
        for length in lengths:
            rows.append(((length << _RANK_BITS) + used[length], used[length], sequence, offset))
            used[length] += times
            offset += length
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in (zip(*rows) if rows else ([], [], [], [])))


def pattern_plan(totals: np.ndarray) -> list[tuple[int, list[int]]]:
    """``(times, lengths)`` that use each length as often as ``totals`` says."""
    size = len(totals) - 1
    left = totals.copy()
    plan = []
    patterns = _patterns(np.flatnonzero(totals), size, totals)
    if patterns:
        repeats = np.floor(_fit(patterns, totals)).astype(np.int64)
        for k in np.argsort(-repeats, kind="stable"):
            times = min(int(repeats[k]), _possible(patterns[k], left))
            if times > 0:
                plan.append((times, patterns[k]))
                _take(patterns[k], left, times)
    while left.any():
        lengths = _best_fit(left, size)
        times = _possible(lengths, left)
        plan.append((times, lengths))
        _take(lengths, left, times)
    return plan


def _possible(lengths: list[int], left: np.ndarray) -> int:
    return min(int(left[n]) // k for n, k in Counter(lengths).items())


def _take(lengths: list[int], left: np.ndarray, times: int) -> None:
    for n in lengths:
        left[n] -= times


def _best_fit(left: np.ndarray, size: int) -> list[int]:
    """The largest length left, then each time the largest that still fits."""
    present = np.flatnonzero(left)
    lengths, used, room = [], Counter(), size
    while True:
        at = int(np.searchsorted(present, room, "right")) - 1
        while at >= 0 and used[int(present[at])] >= left[present[at]]:
            at -= 1
        if at < 0:
            return lengths
        n = int(present[at])
        lengths.append(n)
        used[n] += 1
        room -= n


def _patterns(present: np.ndarray, size: int, totals: np.ndarray) -> list[list[int]]:
    """Few lengths that fill a sequence but for less than the shortest length, or nearly so:
    every length with some second lengths spread over those that fit, then best fits."""
    found = set()
    for n in present.tolist():
        fitting = present[: int(np.searchsorted(present, size - n, "right"))]
        if not len(fitting):
            found.add((n,))
            continue
        picks = np.linspace(0, len(fitting) - 1, min(_STARTS_PER_LENGTH, len(fitting))).astype(int)
        for second in fitting[picks].tolist():
            lengths, room = [n, second], size - n - second
            while room > 0 and len(lengths) < _LENGTHS_PER_PATTERN:
                at = int(np.searchsorted(present, room, "right")) - 1
                if at < 0:
                    break
                lengths.append(int(present[at]))
                room -= lengths[-1]
            if room * 100 <= size:
                found.add(tuple(sorted(lengths, reverse=True)))
    return [list(p) for p in sorted(found, reverse=True)]


def _fit(patterns: list[list[int]], totals: np.ndarray, steps: int = 300) -> np.ndarray:
    """Non-negative repeat counts whose use of lengths is nearest to ``totals`` in squares,
    by multiplicative steps, which never leave the non-negative side."""
    column = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    row = np.concatenate([np.array(p) for p in patterns])
    wanted = np.bincount(column, totals[row], len(patterns))
    repeats = np.ones(len(patterns))
    for _ in range(steps):
        use = np.bincount(row, repeats[column], len(totals))
        repeats *= wanted / np.maximum(np.bincount(column, use[row], len(patterns)), 1e-12)
    return repeats
