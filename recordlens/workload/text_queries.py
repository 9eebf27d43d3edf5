"""Text, identity and JSON-schema queries.

Whole texts are compared by their MD5, so a difference anywhere shows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from recordlens.domain import MAX_TOKENS, encode_label, decode_label
from recordlens.functions import probability, schema_text, text
from recordlens.workload.registry import query
from recordlens.workload.tables import (
    DOCUMENT_RECORDS,
    PART_LABELS,
    PART_RECORDS,
    document_records,
    part_records,
    sql_labels,
    table,
    texts,
)

_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || chr(8192) || chr(8193) || chr(8194) || chr(8195) || chr(8196) || chr(8197) || chr(8198) || chr(8199) || chr(8200) || chr(8201) || chr(8202) || chr(8232) || chr(8233) || chr(8239) || chr(8287) || chr(12288)"


def _strip(c: str) -> str:
    return f"trim({c}, {_SPACE})"


def _field(c: str) -> str:
    return f"coalesce({c}, '')"


def _fields(df):
    return [F.col(c) for c in ("name", "description", "input_schema")]


@query(
    "null_to_empty",
    f"WITH {PART_RECORDS} SELECT record_id, {_field('description')} AS description, "
    f"{_field('input_schema')} AS input_schema FROM records",
)
def null_to_empty(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select(
        "record_id",
        text.field(F.col("description")).alias("description"),
        text.field(F.col("input_schema")).alias("input_schema"),
    )


@query(
    "stripped_page_text",
    f"SELECT page_id, length(s) AS n, md5(s) AS digest, s = '' AS blank FROM "
    f"(SELECT page_id, {_strip('''regexp_replace(html, '<[^>]*>', chr(160), 'g')''')} AS s FROM pages)",
)
def stripped_page_text(spark, sf_dir):
    # Tags become no-break spaces, so both ends hold mixed whitespace.
    pages = texts(spark, sf_dir, "pages")
    bare = F.regexp_replace("html", "<[^>]*>", " ")
    s = pages.select("page_id", text.strip(bare).alias("s"))
    return s.select(
        "page_id",
        F.length("s").cast("long").alias("n"),
        F.md5("s").alias("digest"),
        text.is_blank(F.col("s")).alias("blank"),
    )


@query(
    "content_hashes",
    f"WITH {PART_RECORDS} SELECT record_id, sha256({_field('name')} || chr(10) || "
    f"{_field('description')} || chr(10) || {_field('input_schema')}) AS content_hash FROM records",
)
def content_hashes(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select("record_id", text.content_hash(*_fields(r)).alias("content_hash"))


@query(
    "similarity_texts",
    f"WITH {PART_RECORDS} SELECT record_id, {_strip(_field('name'))} || chr(10) || "
    f"{_strip(_field('description'))} || chr(10) || {_strip(_field('input_schema'))} AS text FROM records",
)
def similarity_texts(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select("record_id", text.similarity_text(*_fields(r)).alias("text"))


@query(
    "baseline_texts",
    f"WITH {PART_RECORDS} SELECT record_id, 'Tool name: ' || {_strip(_field('name'))} || chr(10) || "
    f"'Description: ' || {_strip(_field('description'))} || chr(10) || 'Input schema: ' || "
    f"{_strip(_field('input_schema'))} AS text FROM records",
)
def baseline_texts(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select("record_id", text.baseline_text(*_fields(r)).alias("text"))


_SPEC = "json_extract(input_schema, '$.properties.\"' || k || '\"')"

_SHOWN_LIST = """
'[' || array_to_string(list_transform(json_extract({v}, '$[*]'), lambda x:
  CASE json_type(x) WHEN 'VARCHAR' THEN '''' || (x->>'$') || '''' WHEN 'NULL' THEN 'None'
       WHEN 'BOOLEAN' THEN CASE WHEN x::VARCHAR = 'true' THEN 'True' ELSE 'False' END
       ELSE x::VARCHAR END), ', ') || ']'
"""

_PROSE = f"""
CASE
 WHEN input_schema IS NULL THEN 'Schema unavailable: {schema_text.NULL_SCHEMA}'
 WHEN input_schema = '' THEN 'Schema unavailable: Expecting value: line 1 column 1 (char 0)'
 WHEN NOT json_valid(input_schema) THEN 'Schema unavailable: {schema_text.UNPARSEABLE}'
 WHEN json_type(input_schema) = 'ARRAY' THEN 'Schema unavailable: ''list'' object has no attribute ''get'''
 WHEN json_type(input_schema) = 'VARCHAR' THEN 'Schema unavailable: ''str'' object has no attribute ''get'''
 WHEN len(list_filter(json_keys(input_schema, '$.properties'), lambda k: json_type({_SPEC}) <> 'OBJECT')) > 0
   THEN 'Schema unavailable: ''bool'' object has no attribute ''get'''
 ELSE coalesce('Schema description: ' || nullif(input_schema->>'$.description', '') || chr(10), '')
   || CASE WHEN coalesce(len(json_keys(input_schema, '$.properties')), 0) = 0 THEN 'Parameters: none'
      ELSE 'Parameters:' || chr(10) || array_to_string(list_transform(json_keys(input_schema, '$.properties'), lambda k:
        '- ' || k || ': '
        || CASE json_type({_SPEC}, '$.type') WHEN 'ARRAY' THEN {_SHOWN_LIST.format(v=f"json_extract({_SPEC}, '$.type')")}
                WHEN 'VARCHAR' THEN {_SPEC}->>'$.type' ELSE 'unknown' END
        || CASE WHEN list_contains(json_extract_string(input_schema, '$.required[*]'), k)
                THEN ' (required)' ELSE ' (optional)' END
        || coalesce(' — ' || nullif({_SPEC}->>'$.description', ''), '')
        || CASE WHEN json_type({_SPEC}, '$.enum') = 'ARRAY'
                THEN ' — allowed values: ' || {_SHOWN_LIST.format(v=f"json_extract({_SPEC}, '$.enum')")} ELSE '' END
      ), chr(10)) END
END
"""


@query("schema_prose", f"WITH {PART_RECORDS} SELECT record_id, {_PROSE} AS prose FROM records")
def schema_prose(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select("record_id", schema_text.schema_prose(F.col("input_schema")).alias("prose"))


MODEL_TEXT_SQL = (
    "'Tool name: ' || coalesce(name, 'None') || chr(10) || 'Description: ' || "
    f"coalesce(description, 'None') || chr(10) || {_PROSE}"
)


@query(
    "model_texts",
    f"WITH {PART_RECORDS} SELECT record_id, {MODEL_TEXT_SQL} AS text FROM records",
)
def model_texts(spark, sf_dir):
    r = part_records(spark, sf_dir)
    return r.select("record_id", text.model_text(*_fields(r)).alias("text"))


@query(
    "document_model_texts",
    f"WITH {DOCUMENT_RECORDS} SELECT record_id, md5('Tool name: None' || chr(10) || 'Description: ' || "
    f"coalesce(description, 'None') || chr(10) || 'Schema unavailable: {schema_text.NULL_SCHEMA}') "
    "AS digest FROM records",
)
def document_model_texts(spark, sf_dir):
    r = document_records(spark, sf_dir)
    return r.select("record_id", F.md5(text.model_text(*_fields(r))).alias("digest"))


_TOKENS = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]{{2,}}')"


def _tokens(c: str) -> str:
    return _TOKENS.format(c=c)


@query(
    "word_tokens",
    f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS digest FROM "
    f"(SELECT doc_id, {_tokens('text')} AS t FROM documents)",
)
def word_tokens(spark, sf_dir):
    t = texts(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("t"))
    return t.select(
        "doc_id",
        F.size("t").cast("long").alias("n"),
        F.md5(F.array_join("t", " ")).alias("digest"),
    )


@query(
    "one_and_two_grams",
    f"SELECT conv_id, turn, len(g) AS n, md5(array_to_string(g, '|')) AS digest FROM (SELECT conv_id, turn, "
    "list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS g FROM "
    f"(SELECT conv_id, turn, {_tokens('text')} AS t FROM conversations))",
)
def one_and_two_grams(spark, sf_dir):
    c = texts(spark, sf_dir, "conversations")
    t = c.select("conv_id", "turn", text.words(F.col("text")).alias("t"))
    g = t.select("conv_id", "turn", text.with_bigrams(F.col("t")).alias("g"))
    return g.select(
        "conv_id",
        "turn",
        F.size("g").cast("long").alias("n"),
        F.md5(F.array_join("g", "|")).alias("digest"),
    )


@query(
    "truncated_tokens",
    f"SELECT doc_id, len(t) AS n_all, len(t[1:{MAX_TOKENS}]) AS n_kept, "
    f"md5(array_to_string(t[1:{MAX_TOKENS}], ' ')) AS digest FROM "
    f"(SELECT doc_id, {_tokens('text')} AS t FROM documents)",
)
def truncated_tokens(spark, sf_dir):
    t = texts(spark, sf_dir, "documents").select("doc_id", text.words(F.col("text")).alias("t"))
    cut = text.truncate_tokens(F.col("t"), MAX_TOKENS)
    return t.select(
        "doc_id",
        F.size("t").cast("long").alias("n_all"),
        F.size(cut).cast("long").alias("n_kept"),
        F.md5(F.array_join(cut, " ")).alias("digest"),
    )


@query(
    "token_length_profile",
    f"SELECT min(n) AS shortest, round(avg(n), 6) AS mean, max(n) AS longest, "
    f"count(*) FILTER (n > {MAX_TOKENS}) AS n_over_limit FROM "
    f"(SELECT len({_tokens('text')}) AS n FROM documents)",
)
def token_length_profile(spark, sf_dir):
    from recordlens.operators.scoring import token_profile

    p = token_profile(texts(spark, sf_dir, "documents"), "text", MAX_TOKENS)
    return p.withColumn("mean", F.round("mean", 6))


@query(
    "head_sample",
    "SELECT doc_id, md5(text) AS digest FROM documents ORDER BY doc_id LIMIT 1000",
)
def head_sample(spark, sf_dir):
    from recordlens.operators.scoring import head_sample as sample

    d = sample(table(spark, sf_dir, "documents"), "doc_id", 1000)
    return d.select("doc_id", F.md5("text").alias("digest"))


@query(
    "label_ids",
    f"WITH {sql_labels(PART_LABELS)} SELECT p_partkey, label_id, label FROM part JOIN dim ON p_type = label",
)
def label_ids(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    coded = p.select("p_partkey", encode_label(F.col("p_type"), PART_LABELS).alias("label_id"))
    return coded.withColumn("label", decode_label(F.col("label_id"), PART_LABELS))


_SOFTMAX = """
e AS (SELECT vec_id, list_transform(embedding, lambda z: CAST(z AS DOUBLE)) AS z FROM embeddings),
p AS (SELECT vec_id, z, list_transform(z, lambda v: exp(v - list_max(z))) AS x FROM e)
"""


@query(
    "softmax_top_class",
    f"WITH {_SOFTMAX} SELECT vec_id, list_position(z, list_max(z)) - 1 AS label_id, "
    "round(CAST(CAST(1.0 / list_sum(x) AS FLOAT) AS DOUBLE), 6) AS confidence FROM p",
)
def softmax_top_class(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        "vec_id",
        probability.argmax(F.col("embedding")).cast("long").alias("label_id"),
        F.round(probability.top_probability(F.col("embedding")), 6).alias("confidence"),
    )
