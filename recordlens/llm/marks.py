"""A bit map of fixed size that says which keys may be in a set.

It is the only thing these operators broadcast about a corpus: ``BITS / 8`` bytes
whatever the input. A set bit may be another key's, so it only decides which rows
take the exact path; on a corpus so large that most bits are set, all rows do.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 26
_BITS_PER_ROW = 8 * 4096


def _slot(key: Column) -> Column:
    return F.pmod(key, F.lit(BITS)) + 1


def marks(df: DataFrame, key: Column) -> DataFrame:
    """The bit map of the 64-bit ``key`` of every row, at most ``BITS / 32768`` rows of 4 KiB."""
    slots = df.select(_slot(key).alias("slot"))
    return slots.groupBy(F.bitmap_bucket_number("slot").alias("_mark_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("_mark_bits")
    )


def with_mark(df: DataFrame, bit_map: DataFrame, key: Column, name: str) -> DataFrame:
    """Add a boolean column ``name``: the key may be in the set. No row of ``df`` is shuffled."""
    row = F.floor((_slot(key) - 1) / F.lit(_BITS_PER_ROW)) + 1
    position = F.pmod(_slot(key) - 1, F.lit(_BITS_PER_ROW)).cast("int")
    byte = F.conv(
        F.hex(F.expr("substring(_mark_bits, _mark_at div 8 + 1, 1)")), 16, 10
    ).cast("int")
    joined = (
        df.withColumns({"_mark_want": row, "_mark_at": position})
        .join(F.broadcast(bit_map), F.col("_mark_want") == F.col("_mark_row"), "left")
        .withColumn(
            name,
            F.coalesce(
                (F.floor(byte / F.pow(F.lit(2), F.col("_mark_at") % 8)) % 2) == 1,
                F.lit(False),
            ),
        )
    )
    return joined.drop("_mark_want", "_mark_at", "_mark_row", "_mark_bits")


def sent(bit_map: DataFrame) -> Broadcast:
    """The bit map for use inside Python tasks, by ``marked``."""
    bits = np.zeros(BITS // 8, np.uint8)
    size = _BITS_PER_ROW // 8
    for row in bit_map.toLocalIterator():
        at = (row["_mark_row"] - 1) * size
        bits[at : at + size] = np.frombuffer(row["_mark_bits"], np.uint8)
    return bit_map.sparkSession.sparkContext.broadcast(bits)


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the 64-bit ``keys`` may be in the set, as ``with_mark`` says."""
    slots = keys.view(np.uint64) & np.uint64(BITS - 1)
    return (bits[slots >> np.uint64(3)] >> (slots & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
