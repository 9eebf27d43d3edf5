import json

import pytest
from pyspark.sql import functions as F

from recordlens.domain import LABELS
from recordlens.operators import contracts
from recordlens.operators.scoring import letter_share_scorer, score
from recordlens.plans import evaluate as E
from recordlens.plans.predict import predict_file
from recordlens.sources import records as R
from recordlens.sources import sinks
from recordlens.streaming.predict import predict_stream


def write_lines(path, rows, extra=()):
    path.write_text("\n".join([*(json.dumps(r) for r in rows), *extra]) + "\n")
    return str(path)


def rows(n):
    return [
        {"record_id": f"r{(i * 7) % n:03d}", "name": "abc" * i, "description": None, "input_schema": '{"type":"object"}'}
        for i in range(n)
    ]


def test_jsonl_skips_blank_lines_and_fails_on_bad_ones(spark, tmp_path):
    good = write_lines(tmp_path / "a.jsonl", rows(3), ["", "   \t"])
    assert R.read_jsonl(spark, good).count() == 3
    bad = write_lines(tmp_path / "b.jsonl", rows(3), ["{oops"])
    with pytest.raises(Exception):
        R.read_jsonl(spark, bad).collect()


def test_missing_columns_stop_a_prediction(spark, tmp_path):
    source = write_lines(tmp_path / "in.jsonl", [{"record_id": "1", "name": "n"}, {"record_id": "2", "other": 1}])
    with pytest.raises(ValueError, match="description, input_schema"):
        predict_file(spark, source, str(tmp_path / "out"), letter_share_scorer("abcdef"))
    assert not (tmp_path / "out").exists()
    empty = write_lines(tmp_path / "empty.jsonl", [])
    with pytest.raises(ValueError, match="record_id"):
        predict_file(spark, empty, str(tmp_path / "out"), letter_share_scorer("abcdef"))
    # One line that has a key is enough.
    some = write_lines(tmp_path / "some.jsonl", [{"record_id": "1"}, *rows(2)])
    R.check_keys(R.read_lines(spark, some), ["record_id", "name", "description", "input_schema"])


def test_missing_columns_stop_a_stream(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    write_lines(folder / "a.jsonl", [{"record_id": "1", "name": "n"}])
    query = predict_stream(
        spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt"), letter_share_scorer("abcdef")
    )
    with pytest.raises(Exception, match="description, input_schema"):
        query.awaitTermination(120)
    assert not (tmp_path / "out").exists()


def test_null_texts_are_scored_as_nothing(spark):
    df = spark.createDataFrame([("1", "aab"), ("2", None)], "id string, t string")
    got = {r["id"]: r for r in score(df, letter_share_scorer("abcdef"), F.col("t")).collect()}
    assert got["1"]["predicted_category"] == "Read"
    assert got["2"]["predicted_category"] is None and got["2"]["confidence"] is None


def test_union_fills_the_missing_label(spark):
    a = spark.createDataFrame([("1", "Read")], "record_id string, category string")
    b = spark.createDataFrame([("2",)], "record_id string")
    got = R.union_splits({"train": a, "test": b}).orderBy("record_id").collect()
    assert [tuple(r) for r in got] == [("1", "Read", "train"), ("2", None, "test")]


def test_predictions_keep_input_order(spark, tmp_path):
    data = rows(101)
    source = write_lines(tmp_path / "in.jsonl", data)
    assert predict_file(spark, source, str(tmp_path / "out"), letter_share_scorer("abcdef")) == 101
    lines = []
    for part in sorted((tmp_path / "out").glob("part-*.csv")):
        text = part.read_text().splitlines()
        assert text[0] == "record_id,category"
        lines += text[1:]
    assert [x.split(",")[0] for x in lines] == [r["record_id"] for r in data]
    assert {x.split(",")[1] for x in lines} <= set(LABELS)


@pytest.mark.parametrize(
    "output, n, error",
    [
        ([("1", "Read"), ("1", "Read")], 2, "record_id repeats in 1 rows"),
        ([("1", "Read"), ("2", "read")], 2, "1 rows have a category outside"),
        ([("1", "Read"), ("2", None)], 2, "1 rows have a category outside"),
        ([("1", "Read")], 2, "2 records went in and 1 predictions"),
    ],
)
def test_contract(spark, output, n, error):
    df = spark.createDataFrame(output, "record_id string, category string")
    with pytest.raises((ValueError, RuntimeError), match=error):
        contracts.check_contract(df, n)


def test_broken_contract_writes_nothing(spark, tmp_path):
    data = rows(5) + rows(1)
    source = write_lines(tmp_path / "in.jsonl", data)
    with pytest.raises(ValueError, match="repeats"):
        predict_file(spark, source, str(tmp_path / "out"), letter_share_scorer("abcdef"))
    assert not (tmp_path / "out").exists()


def test_metrics_upsert(spark, tmp_path):
    path = str(tmp_path / "metrics")

    def section(value):
        return spark.createDataFrame([("accuracy", None, value)], "metric string, label string, value string")

    sinks.update_metrics(section("1"), path, "baseline")
    sinks.update_metrics(section("2"), path, "tuned")
    sinks.update_metrics(section("3"), path, "baseline")
    got = {(r["section"], r["metric"]): r["value"] for r in sinks.read_metrics(spark, path).collect()}
    assert got == {
        ("baseline", "accuracy"): "3",
        ("tuned", "accuracy"): "2",
        ("document", "primary_metric"): "macro_f1",
        ("document", "evaluation_split"): "validation",
    }


def test_evaluation_outputs(spark, records, tmp_path):
    text = 'line one\nsays "two", three'
    data = records(
        [(str(i), "g", "aab", text, None, "Read" if i % 2 else "Write", "validation") for i in range(10)]
    ).drop("split")
    scored = E.score_validation(data, letter_share_scorer("abcdef"))
    assert {"actual_category", "predicted_category", "confidence"} <= set(scored.columns)
    out = str(tmp_path / "eval")
    E.evaluate(scored, out, "tuned")
    wrong = sinks.read_csv(
        spark, f"{out}/validation_errors",
        "record_id string, server_slug string, name string, actual_category string, predicted_category string, "
        "confidence double, description string, input_schema string",
    )
    n_wrong = scored.filter("actual_category <> predicted_category").count()
    assert wrong.count() == n_wrong >= 5
    assert {r["description"] for r in wrong.collect()} == {text}
    report = json.loads(spark.read.text(f"{out}/error_analysis").first()[0])
    assert report["validation_error_count"] == n_wrong and len(report["examples"]) <= 8
    assert all(report["failure_mode_descriptions"].values()) and "4 errors" in report["example_selection"]
    assert spark.read.option("header", True).csv(f"{out}/confusion").columns[1] == "Predicted_Read"


def test_stream_scores_each_file(spark, tmp_path):
    folder = tmp_path / "arriving"
    folder.mkdir()
    write_lines(folder / "a.jsonl", rows(11))
    query = predict_stream(
        spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ckpt"), letter_share_scorer("abcdef")
    )
    query.awaitTermination(120)
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "batch=0")).count() == 11
