"""Audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.functions.text import percent_finding
from recordlens.operators import audit
from recordlens.workload.registry import query
from recordlens.workload.tables import (
    DOC_LABELS,
    DOCUMENT_RECORDS,
    EVENT_JSON,
    PART_LABELS,
    PART_RECORDS,
    document_records,
    event_json,
    part_records,
    sql_labels,
    table,
)

_PAIRS = "pairs(a, b) AS (VALUES ('train','validation'), ('train','test'), ('validation','test'))"

_HASHED = """
hashed AS (
  SELECT *, sha256(coalesce(name, '') || chr(10) || coalesce(description, '') || chr(10)
                   || coalesce(input_schema, '')) AS content_hash
  FROM records)
"""


def _overlap_sql(source: str, key: str) -> str:
    return f"""
    SELECT a || '_' || b AS pair,
           (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {source} WHERE split = a
                                  INTERSECT
                                  SELECT DISTINCT {key} FROM {source} WHERE split = b)) AS n
    FROM pairs"""


@query(
    "content_leakage_across_splits",
    f"WITH {DOCUMENT_RECORDS}, {_HASHED}, {_PAIRS} {_overlap_sql('hashed', 'content_hash')}",
)
def content_leakage(spark, sf_dir):
    records = audit.with_content_hash(document_records(spark, sf_dir))
    return audit.split_overlap(records, "content_hash")


@query(
    "part_content_leakage_across_splits",
    f"WITH {PART_RECORDS}, {_HASHED}, {_PAIRS} {_overlap_sql('hashed', 'content_hash')}",
)
def part_content_leakage(spark, sf_dir):
    records = audit.with_content_hash(part_records(spark, sf_dir))
    return audit.split_overlap(records, "content_hash")


@query(
    "group_overlap_across_splits",
    f"WITH {DOCUMENT_RECORDS}, {_PAIRS} {_overlap_sql('records', 'server_slug')}",
)
def group_overlap(spark, sf_dir):
    return audit.split_overlap(document_records(spark, sf_dir), "server_slug")


@query(
    "group_isolation",
    f"WITH {PART_RECORDS}, {_PAIRS}, o AS ({_overlap_sql('records', 'server_slug')}) "
    "SELECT bool_and(n = 0) AS passed FROM o",
)
def group_isolation(spark, sf_dir):
    return audit.group_isolation(part_records(spark, sf_dir))


@query(
    "name_isolation",
    f"WITH {PART_RECORDS}, {_PAIRS}, o AS ({_overlap_sql('records', 'name')}) "
    "SELECT bool_and(n = 0) AS passed FROM o",
)
def name_isolation(spark, sf_dir):
    return audit.group_isolation(part_records(spark, sf_dir), "name")


@query(
    "unique_groups_per_split",
    f"WITH {PART_RECORDS} SELECT split, count(*) AS n FROM "
    "(SELECT DISTINCT split, server_slug FROM records) GROUP BY split",
)
def unique_groups(spark, sf_dir):
    return audit.unique_groups(part_records(spark, sf_dir))


@query(
    "dataset_sizes",
    f"WITH {DOCUMENT_RECORDS} SELECT split, count(*) AS n FROM records GROUP BY split",
)
def dataset_sizes(spark, sf_dir):
    return audit.dataset_sizes(document_records(spark, sf_dir))


@query(
    "split_union",
    f"WITH {PART_RECORDS} SELECT record_id, server_slug, name, description, input_schema, "
    "category, split FROM records",
)
def split_union(spark, sf_dir):
    from recordlens.sources.records import union_splits

    records = part_records(spark, sf_dir)
    parts = {s: records.filter(F.col("split") == s).drop("split") for s in ("train", "validation")}
    # The test split has no label column at all.
    parts["test"] = records.filter(F.col("split") == "test").drop("split", "category")
    return union_splits(parts)


@query(
    "missing_values",
    f"WITH {PART_RECORDS} SELECT split, col AS \"column\", count(*) FILTER (v IS NULL) AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT split, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM records"
        for c in ("record_id", "server_slug", "name", "description", "input_schema", "category")
    )
    + ") GROUP BY split, col",
)
def missing_values(spark, sf_dir):
    return audit.missing_values(part_records(spark, sf_dir))


@query(
    "empty_text_fields",
    f"WITH {PART_RECORDS} SELECT split, col AS \"column\", "
    "count(*) FILTER (trim(coalesce(v, '')) = '') AS n FROM ("
    + " UNION ALL ".join(
        f"SELECT split, '{c}' AS col, {c} AS v FROM records"
        for c in ("name", "description", "input_schema")
    )
    + ") GROUP BY split, col",
)
def empty_text_fields(spark, sf_dir):
    return audit.empty_text_fields(part_records(spark, sf_dir))


@query(
    "duplicate_record_ids",
    "WITH r AS (SELECT event_type AS split, user_id FROM events) "
    "SELECT split, CAST(sum(n - 1) AS BIGINT) AS n FROM "
    "(SELECT split, user_id, count(*) AS n FROM r GROUP BY split, user_id) GROUP BY split",
)
def duplicate_record_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("split"), "user_id")
    return audit.rows_after_first(rows, "user_id")


@query(
    "duplicates_within_split",
    f"WITH {DOCUMENT_RECORDS}, {_HASHED} SELECT split, CAST(count(*) - count(DISTINCT content_hash) "
    "AS BIGINT) AS n FROM hashed GROUP BY split",
)
def duplicates_within_split(spark, sf_dir):
    records = audit.with_content_hash(document_records(spark, sf_dir))
    return audit.rows_after_first(records, "content_hash")


@query(
    "later_copies",
    f"WITH {DOCUMENT_RECORDS}, {_HASHED} SELECT record_id, split, content_hash, "
    "row_number() OVER (PARTITION BY split, content_hash ORDER BY record_id) > 1 AS is_duplicate FROM hashed",
)
def later_copies(spark, sf_dir):
    records = audit.with_content_hash(document_records(spark, sf_dir))
    return audit.later_copies(records.select("record_id", "split", "content_hash"), "content_hash")


@query(
    "later_copies_of_repeated_ids",
    """WITH rows AS (SELECT CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey % 500 AS VARCHAR) END AS record_id,
        CASE WHEN l_quantity >= 3 THEN CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS k, l_returnflag AS split FROM lineitem),
    flagged AS (SELECT *, row_number() OVER (PARTITION BY split, k ORDER BY record_id NULLS LAST) > 1 AS d FROM rows)
    SELECT split, k, record_id, count(*) AS n, count(*) FILTER (d) AS n_duplicate FROM flagged GROUP BY ALL""",
)
def later_copies_of_repeated_ids(spark, sf_dir):
    """Ids that repeat within and across splits, NULL ids and NULL keys."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, (F.col("l_orderkey") % 500).cast("string")).alias("record_id"),
        F.when(F.col("l_quantity") >= 3, F.col("l_quantity").cast("long").cast("string")).alias("k"),
        F.col("l_returnflag").alias("split"),
    )
    flagged = audit.later_copies(rows, "k")
    return flagged.groupBy("split", "k", "record_id").agg(
        F.count("*").alias("n"), F.count_if("is_duplicate").alias("n_duplicate")
    )


_STATUS = """
CASE WHEN input_schema IS NULL OR trim(input_schema) = '' THEN 'missing'
     WHEN NOT json_valid(input_schema) THEN 'malformed'
     WHEN json_type(input_schema) = 'OBJECT' THEN 'valid_object' ELSE 'non_object' END
"""

_STATUS_DIM = "statuses(status) AS (VALUES ('valid_object'), ('missing'), ('malformed'), ('non_object'))"


def _validity_sql(view: str) -> str:
    return f"""WITH {view}, {_STATUS_DIM},
    found AS (SELECT split, {_STATUS} AS status FROM records)
    SELECT s.split, d.status, count(f.status) AS n
    FROM (SELECT DISTINCT split FROM records) s CROSS JOIN statuses d
    LEFT JOIN found f ON f.split = s.split AND f.status = d.status
    GROUP BY s.split, d.status"""


@query("schema_validity", _validity_sql(PART_RECORDS))
def schema_validity(spark, sf_dir):
    return audit.schema_validity(part_records(spark, sf_dir))


@query("event_json_validity", _validity_sql(EVENT_JSON))
def event_json_validity(spark, sf_dir):
    return audit.schema_validity(event_json(spark, sf_dir))


def _distribution_sql(view: str, labels: list[str]) -> str:
    return f"""WITH {view}, {sql_labels(labels)}, t AS (SELECT * FROM records WHERE split = 'train')
    SELECT label_id, label, count(t.category) AS n,
           round(count(t.category) * 100.0 / (SELECT count(*) FROM t), 4) AS percentage
    FROM dim LEFT JOIN t ON t.category = label GROUP BY label_id, label"""


@query("label_distribution", _distribution_sql(PART_RECORDS, PART_LABELS))
def label_distribution(spark, sf_dir):
    train = part_records(spark, sf_dir).filter("split = 'train'")
    return audit.label_distribution(train, PART_LABELS)


@query("language_distribution", _distribution_sql(DOCUMENT_RECORDS, DOC_LABELS))
def language_distribution(spark, sf_dir):
    train = document_records(spark, sf_dir).filter("split = 'train'")
    return audit.label_distribution(train, DOC_LABELS)


def _consistency_sql(view: str, key_cte: str, key: str) -> str:
    return f"""WITH {view} {key_cte},
    s AS (SELECT {key} AS k, split, list_sort(list(DISTINCT category)) AS labels
          FROM hashed WHERE split IN ('train', 'validation') GROUP BY ALL)
    SELECT count(*) AS shared_groups, count(*) FILTER (a.labels <> b.labels) AS conflicting_groups
    FROM s a JOIN s b ON a.k = b.k AND a.split = 'train' AND b.split = 'validation'"""


@query(
    "label_consistency",
    _consistency_sql(DOCUMENT_RECORDS, f", {_HASHED}", "content_hash"),
)
def label_consistency(spark, sf_dir):
    records = audit.with_content_hash(document_records(spark, sf_dir))
    return audit.label_consistency(records, "content_hash")


@query(
    "label_consistency_by_name",
    _consistency_sql(PART_RECORDS, ", hashed AS (SELECT * FROM records)", "name"),
)
def label_consistency_by_name(spark, sf_dir):
    return audit.label_consistency(part_records(spark, sf_dir), "name")


@query(
    "label_sets_by_content",
    f"WITH {PART_RECORDS}, {_HASHED} SELECT content_hash, "
    "array_to_string(list_sort(list(DISTINCT category)), ',') AS labels FROM hashed "
    "WHERE split <> 'test' GROUP BY content_hash",
)
def label_sets_by_content(spark, sf_dir):
    records = audit.with_content_hash(part_records(spark, sf_dir)).filter("split <> 'test'")
    return audit.label_sets(records, "content_hash").withColumn("labels", F.array_join("labels", ","))


_SINGLE = """
SELECT count(*) FILTER (n = 1) AS single_label_groups, count(*) AS total_groups,
       round(count(*) FILTER (n = 1) * 100.0 / count(*), 4) AS percentage
FROM g
"""

_EVENT_GROUPS = """
g AS (SELECT date_trunc('hour', ts) AS h, user_id, count(DISTINCT event_type) AS n
      FROM events GROUP BY ALL)
"""


@query("single_label_groups", f"WITH {_EVENT_GROUPS} {_SINGLE}")
def single_label_groups(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        F.struct("user_id", F.date_trunc("hour", "ts").alias("h")).alias("k"), "event_type"
    )
    return audit.single_label_groups(events, "k", "event_type")


@query(
    "single_label_brands",
    f"WITH {PART_RECORDS}, g AS (SELECT server_slug, count(DISTINCT category) AS n FROM records "
    f"WHERE split = 'train' GROUP BY server_slug) {_SINGLE}",
)
def single_label_brands(spark, sf_dir):
    return audit.single_label_groups(part_records(spark, sf_dir).filter("split = 'train'"))


@query(
    "single_label_finding",
    f"WITH {_EVENT_GROUPS}, f AS ({_SINGLE}) "
    "SELECT printf('%.2f%% of groups hold exactly one label.', percentage) AS finding FROM f",
)
def single_label_finding(spark, sf_dir):
    found = single_label_groups(spark, sf_dir)
    return found.select(
        percent_finding(F.col("percentage"), "of groups hold exactly one label.").alias("finding")
    )


_WORDS = ["Read", "Write", "Economy", "Promo", "Small", "Ring"]
_FIELDS = ["name", "description", "input_schema", "server_slug"]


@query(
    "literal_label_mentions",
    f"WITH {PART_RECORDS}, t AS (SELECT * FROM records WHERE split = 'train') "
    + " UNION ALL ".join(
        f"SELECT '{f}' AS field, '{w}' AS label, count(*) FILTER "
        f"(contains(lower(coalesce({f}, '')), '{w.lower()}')) AS n FROM t"
        for f in _FIELDS
        for w in _WORDS
    ),
)
def literal_label_mentions(spark, sf_dir):
    train = part_records(spark, sf_dir).filter("split = 'train'")
    return audit.literal_mentions(train, _FIELDS, _WORDS)


@query(
    "document_word_mentions",
    f"WITH {DOCUMENT_RECORDS} "
    + " UNION ALL ".join(
        f"SELECT 'description' AS field, '{w}' AS label, count(*) FILTER "
        f"(contains(lower(coalesce(description, '')), '{w.lower()}')) AS n FROM records"
        for w in _WORDS
    ),
)
def document_word_mentions(spark, sf_dir):
    return audit.literal_mentions(document_records(spark, sf_dir), ["description"], _WORDS)


_NAMES = ["Small Ring", "large ring", "Bolt", "ring"]


@query(
    "exact_name_labels",
    f"WITH {PART_RECORDS} "
    + " UNION ALL ".join(
        f"SELECT '{w}' AS label, count(*) FILTER (lower(coalesce(name, '')) = '{w.lower()}') AS n FROM records"
        for w in _NAMES
    ),
)
def exact_name_labels(spark, sf_dir):
    return audit.exact_name_labels(part_records(spark, sf_dir), "name", _NAMES)


@query(
    "zero_filled_label_counts",
    f"WITH {DOCUMENT_RECORDS}, {sql_labels(DOC_LABELS)} "
    "SELECT label_id, label, count(category) AS n FROM dim LEFT JOIN records ON category = label "
    "GROUP BY label_id, label",
)
def zero_filled_label_counts(spark, sf_dir):
    records = document_records(spark, sf_dir)
    counted = records.groupBy(F.col("category").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return audit.zero_fill(counted, DOC_LABELS)
