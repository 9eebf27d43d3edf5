"""The supplied tables seen as records, scored rows and JSON texts.

Each view exists twice: as a DataFrame and as the SQL CTE of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _select(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(e).alias(name) for name, e in columns.items()])


def _sql(columns: dict[str, str], source: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {name}" for name, e in columns.items()) + f" FROM {source}"


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table for CPU-heavy work. One that Spark would read in fewer tasks than it
    has cores is dealt out to all of them first."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _split(number: Column, train: int, validation: int) -> Column:
    return (
        F.when(number < train, "train").when(number < validation, "validation").otherwise("test")
    )


DOC_LABELS = ["en", "de", "fr", "es", "it"]


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: group = source, label = language, split by source."""
    d = texts(spark, sf_dir, "documents")
    split = _split(F.substring("source", 4, 10).cast("int"), 14, 17)
    return d.select(
        F.col("doc_id").alias("record_id"),
        F.col("source").alias("server_slug"),
        F.lit(None).cast("string").alias("name"),
        F.col("text").alias("description"),
        F.lit(None).cast("string").alias("input_schema"),
        F.when(split != "test", F.col("lang")).alias("category"),
        split.alias("split"),
    )


DOCUMENT_RECORDS = """
split_docs AS (
  SELECT *, CASE WHEN CAST(substr(source, 4) AS INT) < 14 THEN 'train'
                 WHEN CAST(substr(source, 4) AS INT) < 17 THEN 'validation'
                 ELSE 'test' END AS split
  FROM documents),
records AS (
  SELECT doc_id AS record_id, source AS server_slug, CAST(NULL AS VARCHAR) AS name,
         text AS description, CAST(NULL AS VARCHAR) AS input_schema,
         CASE WHEN split <> 'test' THEN lang END AS category, split
  FROM split_docs)
"""

PART_LABELS = ["ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"]

# One column per part, built the same way in both dialects.
_PART_SCHEMA = """
  CASE p_partkey % 12
    WHEN 0 THEN NULL
    WHEN 1 THEN ''
    WHEN 2 THEN '   '
    WHEN 3 THEN '{bad'
    WHEN 4 THEN '[1]'
    WHEN 5 THEN '"x"'
    WHEN 6 THEN '{}'
    WHEN 7 THEN concat('{"description":"', p_type, '","properties":{}}')
    WHEN 8 THEN concat('{"properties":{"', p_name, '":true}}')
    ELSE concat('{"description":"', p_type, ' part","type":"object","properties":{"', p_name,
                '":{"type":"string","description":"', p_brand, '","enum":["', p_type, '",',
                CAST(p_size AS STRING), ',true,null]},"size":{"type":["integer","null"]},"code":{"description":""}},',
                '"required":["size"]}')
  END
"""

_PART_DESCRIPTION = """
  CASE p_partkey % 16 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  '
       ELSE concat(' ', p_type, ' ', p_name, ' ') END
"""

_PART_COLUMNS = {
    "record_id": "p_partkey",
    "server_slug": "p_brand",
    "name": "p_name",
    "description": _PART_DESCRIPTION,
    "input_schema": _PART_SCHEMA,
    "label": "p_type",
    "split": "CASE WHEN CAST(substr(p_brand, 7) AS INT) < 18 THEN 'train' "
    "WHEN CAST(substr(p_brand, 7) AS INT) < 22 THEN 'validation' ELSE 'test' END",
}

PART_RECORDS = f"""
part_rows AS ({_sql(_PART_COLUMNS, "part")}),
records AS (
  SELECT record_id, server_slug, name, description, input_schema,
         CASE WHEN split <> 'test' THEN label END AS category, split
  FROM part_rows)
"""


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as records: group = brand, six labels, JSON schemas of every status."""
    rows = _select(texts(spark, sf_dir, "part"), _PART_COLUMNS)
    return rows.select(
        "record_id",
        "server_slug",
        "name",
        "description",
        "input_schema",
        F.when(F.col("split") != "test", F.col("label")).alias("category"),
        "split",
    )


ORDER_LABELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NEVER"]

_SCORED_COLUMNS = {
    "record_id": "o_orderkey",
    "server_slug": "o_orderstatus",
    "name": "CAST(o_custkey AS STRING)",
    "actual_category": "o_orderpriority",
    "predicted_category": "CASE WHEN o_orderkey % 101 = 0 THEN 'unknown' "
    "WHEN o_orderkey % 103 = 0 THEN NULL WHEN o_orderkey % 7 < 5 THEN o_orderpriority "
    "WHEN o_totalprice < 60000 THEN '1-URGENT' WHEN o_totalprice < 120000 THEN '2-HIGH' "
    "WHEN o_totalprice < 200000 THEN '3-MEDIUM' ELSE '5-LOW' END",
    "confidence": "CAST(o_orderkey * 7919 % 1000 AS DOUBLE) / 1000",
    "description": "CASE WHEN o_orderstatus = 'F' THEN NULL "
    "ELSE concat(o_orderstatus, ' \"', o_orderpriority, '\"') END",
    "input_schema": "CAST(NULL AS STRING)",
}

SCORED_ORDERS = f"scored AS ({_sql(_SCORED_COLUMNS, 'orders')})"


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as scored rows: priority is the actual label, a rule the prediction."""
    return _select(table(spark, sf_dir, "orders"), _SCORED_COLUMNS)


LINE_LABELS = ["A", "N", "R", "X"]

_CANDIDATE_COLUMNS = {
    "candidate": "l_linenumber",
    "actual": "l_returnflag",
    "predicted": "CASE WHEN l_quantity * l_linenumber > 60 THEN l_returnflag "
    "WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N' ELSE 'R' END",
}

CANDIDATE_LINES = f"scored AS ({_sql(_CANDIDATE_COLUMNS, 'lineitem')})"


def candidate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as predictions of seven candidates (line number)."""
    return _select(table(spark, sf_dir, "lineitem"), _CANDIDATE_COLUMNS)


_EVENT_COLUMNS = {
    "event_id": "event_id",
    "split": "event_type",
    "input_schema": "CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' "
    "WHEN 3 THEN '{bad' WHEN 4 THEN concat(props, ' x') WHEN 5 THEN concat('[', props, ']') "
    "WHEN 6 THEN '\"x\"' WHEN 7 THEN concat(' ', props, ' ') ELSE props END",
}

EVENT_JSON = f"records AS ({_sql(_EVENT_COLUMNS, 'events')})"


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event properties as JSON texts of every validity status."""
    return _select(table(spark, sf_dir, "events"), _EVENT_COLUMNS)


def sql_labels(labels: list[str]) -> str:
    """The label domain as a VALUES list ``dim(label_id, label)``."""
    rows = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"dim(label_id, label) AS (VALUES {rows})"
