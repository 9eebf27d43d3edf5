import hashlib

import pytest
from pyspark.sql import functions as F

from recordlens.functions import probability, schema_text, text

NULL_TEXT = "Schema unavailable: the JSON object must be str, bytes or bytearray, not NoneType"

PROSE = [
    (None, NULL_TEXT),
    ("{}", "Parameters: none"),
    ('{"properties":{}}', "Parameters: none"),
    ('{"description":"D"}', "Schema description: D\nParameters: none"),
    ('{"description":""}', "Parameters: none"),
    ('{"required":null}', "Parameters: none"),
    (
        '{"properties":{"z":{"type":"string"},"a":{}},"required":["a"]}',
        "Parameters:\n- z: string (optional)\n- a: unknown (required)",
    ),
    (
        '{"properties":{"m":{"type":"string","description":"mode","enum":["x","y"]}}}',
        "Parameters:\n- m: string (optional) — mode — allowed values: ['x', 'y']",
    ),
    (
        '{"properties":{"t":{"type":["string","null"]}}}',
        "Parameters:\n- t: ['string', 'null'] (optional)",
    ),
    (
        '{"properties":{"e":{"enum":["a",1,true,null]}}}',
        "Parameters:\n- e: unknown (optional) — allowed values: ['a', 1, True, None]",
    ),
    (
        '{"properties":{"e":{"enum":[2.0,"it\'s","q\\"x",{"k":[1]}]}}}',
        "Parameters:\n- e: unknown (optional) — allowed values: "
        "[2.0, \"it's\", 'q\"x', {'k': [1]}]",
    ),
    # What Python cannot print is escaped.
    (
        '{"properties":{"e":{"enum":["a\u00a0b\\u0007\u2028é \\n",{"k":"\u200b"}]}}}',
        "Parameters:\n- e: unknown (optional) — allowed values: "
        + str(["a\u00a0b\u0007\u2028é \n", {"k": "\u200b"}]),
    ),
    # A repeated key keeps its first place and its last value.
    (
        '{"properties":{"p":{"type":"a"},"q":{},"p":{"type":"b"}}}',
        "Parameters:\n- p: b (optional)\n- q: unknown (optional)",
    ),
    ("[1]", "Schema unavailable: 'list' object has no attribute 'get'"),
    ('{"properties":{"p":true}}', "Schema unavailable: 'bool' object has no attribute 'get'"),
    (
        '{"required":null,"properties":{"p":{}}}',
        "Schema unavailable: 'NoneType' object is not iterable",
    ),
    ("{bad", "Schema unavailable: malformed JSON"),
    ("", "Schema unavailable: Expecting value: line 1 column 1 (char 0)"),
]

STATUS = [
    (None, "missing"),
    ("", "missing"),
    ("  \t", "missing"),
    (" ", "missing"),
    ("{bad", "malformed"),
    ('{"a":1} x', "malformed"),
    ('{"a":1}]', "malformed"),
    ('{"a":1}] {}', "malformed"),
    ('{"a":1}} {', "malformed"),
    ("{'a':1}", "malformed"),
    ("1,2", "malformed"),
    ("[1]", "non_object"),
    ("null", "non_object"),
    ("NaN", "non_object"),
    ("1", "non_object"),
    ('"x"', "non_object"),
    ("{}", "valid_object"),
    ('{"a":1}', "valid_object"),
    (' {"a":1}\n', "valid_object"),
    ('{"a":1,"a":2}', "valid_object"),
]


def _map(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    rows = df.select("i", fn(F.col("s")).alias("o")).orderBy("i").collect()
    return [r["o"] for r in rows]


def test_schema_prose(spark):
    got = _map(spark, [s for s, _ in PROSE], schema_text.schema_prose)
    assert got == [want for _, want in PROSE]


def test_schema_status(spark):
    got = _map(spark, [s for s, _ in STATUS], lambda c: schema_text.schema_status(c, text.is_blank(c)))
    assert got == [want for _, want in STATUS]


def test_strip_equals_python(spark):
    values = ["\t a b \n", "　x ", " ", "", "\x1fa\x85", "a b", "​z"]
    assert _map(spark, values, text.strip) == [v.strip() for v in values]


def test_two_null_conventions(spark):
    df = spark.createDataFrame([("n", None, None)], "name string, description string, input_schema string")
    cols = [F.col(c) for c in df.columns]
    row = df.select(
        text.model_text(*cols).alias("m"),
        text.baseline_text(*cols).alias("b"),
        text.similarity_text(*cols).alias("s"),
        text.content_hash(*cols).alias("h"),
    ).first()
    assert row["m"] == f"Tool name: n\nDescription: None\n{NULL_TEXT}"
    assert row["b"] == "Tool name: n\nDescription: \nInput schema: "
    assert row["s"] == "n\n\n"
    assert row["h"] == hashlib.sha256(b"n\n\n").hexdigest()


def test_hash_is_unstripped_and_null_is_empty(spark):
    df = spark.createDataFrame(
        [("a", None, "s"), ("a", "", "s"), ("a", " ", "s")], "n string, d string, s string"
    )
    h = [r[0] for r in df.select(text.content_hash(F.col("n"), F.col("d"), F.col("s"))).collect()]
    assert h[0] == h[1] != h[2]


def test_tokens_and_pairs(spark):
    df = spark.createDataFrame([(1, "The Été_1 of a b2"), (2, ""), (3, "one")], "i int, s string")
    t = df.select("i", text.words(F.col("s")).alias("t"))
    got = {r["i"]: list(r["g"]) for r in t.select("i", text.with_bigrams(F.col("t")).alias("g")).collect()}
    assert got[1] == ["the", "été_1", "of", "b2", "the été_1", "été_1 of", "of b2"]
    assert got[2] == [] and got[3] == ["one"]


def test_softmax_first_maximum(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([1000.0, 0.0, 0.0],)], "z array<float>")
    rows = df.select(
        probability.argmax(F.col("z")).alias("i"),
        probability.softmax(F.col("z")).alias("p"),
        probability.top_probability(F.col("z")).alias("c"),
    ).collect()
    assert [r["i"] for r in rows] == [1, 0]
    for r in rows:
        assert sum(r["p"]) == pytest.approx(1.0, abs=1e-6)
        assert max(r["p"]) == pytest.approx(r["c"], abs=1e-7)


def test_mentions_has_no_word_boundary(spark):
    assert _map(spark, ["ALREADY", "rea d", None], lambda c: text.mentions(c, "Read")) == [True, False, False]
