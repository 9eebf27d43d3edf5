"""Reading record splits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.domain import RECORD_SCHEMA


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """JSON lines with a fixed schema: blank lines are skipped, a malformed line fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of JSON files as text, column ``value``."""
    return spark.read.text(path)


def parse_lines(lines: DataFrame, schema: T.StructType = RECORD_SCHEMA) -> DataFrame:
    """Lines as ``read_jsonl`` reads them, for streams that have text at hand."""
    kept = lines.filter(F.trim("value", F.lit(" \t\r\n")) != "")
    return kept.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def check_keys(lines: DataFrame, needed: Iterable[str]) -> None:
    """Fail unless every needed key occurs in some line.

    A schema given to the reader adds absent columns as NULL, so the lines themselves
    are asked, in one aggregate over their outermost keys.
    """
    keys = F.json_object_keys("value")
    seen = lines.agg(*[F.bool_or(F.array_contains(keys, c)).alias(c) for c in needed]).first()
    absent = sorted(c for c, found in seen.asDict().items() if not found)
    if absent:
        raise ValueError(f"no line of the input has the keys {', '.join(absent)}")


def union_splits(splits: Mapping[str, DataFrame]) -> DataFrame:
    """One table of all splits with a ``split`` column; absent columns become NULL."""
    tagged = [df.withColumn("split", F.lit(name)) for name, df in splits.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def with_file_order(scan: DataFrame, column: str = "input_order") -> DataFrame:
    """Tag the rows of a file scan with their place: file, start of the split, place in the task.

    Files come in the order of their paths. A task may read several splits of several files,
    and a file may be read by many tasks; rows of a split are read in order.
    """
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"),
    )
    return scan.select("*", place.alias(column))


def with_input_order(df: DataFrame, column: str = "input_order") -> DataFrame:
    """Tag rows with their scan position, so a sink can restore input order."""
    return df.withColumn(column, F.monotonically_increasing_id())
