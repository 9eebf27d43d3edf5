"""Streams across batches, restarts and late rows; input order over many files."""

import json

import pytest
from pyspark.sql import functions as F

from recordlens.domain import LABELS
from recordlens.operators.scoring import letter_share_scorer
from recordlens.plans.predict import predict_file
from recordlens.sources.sinks import read_csv
from recordlens.streaming import drift
from recordlens.streaming.predict import predict_stream

SCORER = letter_share_scorer("aeiost")


def line(record_id, text="a text"):
    return json.dumps({"record_id": record_id, "name": text, "description": "d", "input_schema": "{}"})


def run(spark, tmp, **options):
    query = predict_stream(spark, str(tmp / "in"), str(tmp / "out"), str(tmp / "state"), SCORER, LABELS, **options)
    query.awaitTermination()


def ids(spark, tmp):
    return sorted(r["record_id"] for r in read_csv(spark, str(tmp / "out" / "batch=*"), "record_id string, category string").collect())


def test_an_id_of_an_earlier_batch_is_dropped_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text("\n".join(line(f"r{k}") for k in range(5)))
    run(spark, tmp_path, repeats="drop")
    (tmp_path / "in" / "b.jsonl").write_text("\n".join([line("r3"), line("r9"), line("r9", "other")]))
    run(spark, tmp_path, repeats="drop")
    assert ids(spark, tmp_path) == ["r0", "r1", "r2", "r3", "r4", "r9"]


def test_an_id_of_an_earlier_batch_stops_the_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text(line("r1"))
    run(spark, tmp_path)
    (tmp_path / "in" / "b.jsonl").write_text(line("r1", "again"))
    with pytest.raises(Exception, match="record_id repeats in 1 rows"):
        run(spark, tmp_path)
    assert ids(spark, tmp_path) == ["r1"]


def events(spark, path, rows):
    spark.createDataFrame(rows, "ts string, kind string, v double").select(
        F.to_timestamp("ts").alias("ts"), "kind", "v"
    ).coalesce(1).write.mode("append").parquet(path)


def test_drift_equals_a_batch_without_the_late_rows_after_a_restart(spark, tmp_path):
    source, target, state = (str(tmp_path / n) for n in ("events", "out", "state"))

    def run():
        rows = spark.readStream.schema("ts timestamp, kind string, v double").parquet(source)
        drift.count_stream(rows, "ts", "kind", F.col("v") < 0.5, target, state, "1 day", "1 day").awaitTermination()

    first = [("2024-01-01 01:00:00", "a", 0.1), ("2024-01-02 01:00:00", "b", 0.9), (None, "a", 0.0), ("2024-01-05 00:00:00", None, None)]
    second = [("2024-01-01 02:00:00", "a", 0.1), ("2024-01-05 03:00:00", "a", 0.2), ("2024-01-06 03:00:00", "b", 0.2)]
    events(spark, source, first)
    run()
    events(spark, source, second)
    run()
    got = {(str(r["start"])[:10], r["label"]): (r["n"], r["n_review"]) for r in drift.counts(spark, target).collect()}
    # The watermark stood at the 4th when the row of the 1st came again: it is late.
    assert got == {
        ("2024-01-01", "a"): (1, 1), ("2024-01-02", "b"): (1, 0), ("2024-01-05", None): (1, 0),
        ("2024-01-05", "a"): (1, 1), ("2024-01-06", "b"): (1, 1),
    }
    expected = spark.createDataFrame([("a", 0.75), ("b", 0.25)], "label string, expected_share double")
    shifts = {(str(r["start"])[:10], r["label"]): r["shift"] for r in drift.drift(drift.counts(spark, target), expected).collect()}
    assert shifts["2024-01-05", "a"] == pytest.approx(0.5 - 0.75) and shifts["2024-01-05", None] == pytest.approx(0.5)
    assert shifts["2024-01-01", "b"] == pytest.approx(-0.25) and len(shifts) == 9


@pytest.mark.parametrize("split", ["2k", "128m"])
def test_a_folder_of_files_gives_back_its_order(spark, tmp_path, split):
    folder = tmp_path / "files"
    folder.mkdir()
    want = []
    for name, n in (("a", 5), ("b", 300), ("c", 1), ("d", 120)):
        own = [f"{name}{k}" for k in range(n)]
        (folder / f"{name}.jsonl").write_text("\n".join(line(i) for i in own) + "\n")
        want += own
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert predict_file(spark, str(folder), str(tmp_path / "out"), SCORER) == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    got = [x.split(",")[0] for p in parts for x in p.read_text().splitlines()[1:]]
    assert got == want
