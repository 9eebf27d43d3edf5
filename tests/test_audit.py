import pytest

from recordlens.domain import LABELS
from recordlens.operators import audit
from recordlens.plans.audit_report import audit_document, write_audit


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def sample(records):
    return records(
        [
            ("1", "g1", "read_file", "d", "{}", "Read", "train"),
            ("2", "g1", "read_file", "d", "{}", "Read", "train"),
            ("3", "g2", "read_file", "d", "{}", "Read", "train"),
            ("4", "g2", "read_file", "d ", "{}", "Write", "train"),
            ("5", None, "write", None, None, "Write", "train"),
            ("6", "g2", "write", "", None, None, "train"),
            ("7", "g3", "read_file", "d", "{}", "Write", "validation"),
            ("8", "g3", "read_file", "d", "{}", "Read", "validation"),
            ("9", "g3", "read_file", "d ", "{}", "Write", "validation"),
            ("9", "g1", "other", "x", "{bad", None, "test"),
            ("9", "g4", "other", "x", "[1]", None, "test"),
        ]
    )


def test_duplicates_and_conflicts(sample):
    hashed = audit.with_content_hash(sample)
    assert rows_of(audit.rows_after_first(hashed, "content_hash")) == [
        ("test", 0), ("train", 3), ("validation", 1)
    ]
    assert rows_of(audit.split_overlap(hashed, "content_hash")) == [
        ("train_test", 0), ("train_validation", 2), ("validation_test", 0)
    ]
    # {Read} against {Read, Write} conflicts, {Write} against {Write} does not.
    assert rows_of(audit.label_consistency(hashed, "content_hash")) == [(2, 1)]
    flags = {r["record_id"]: r["is_duplicate"] for r in audit.later_copies(
        hashed.filter("split = 'train'"), "content_hash").collect()}
    assert flags == {"1": False, "2": True, "3": True, "4": False, "5": False, "6": True}


def test_later_copies_with_repeated_and_null_ids(spark):
    rows = [("a", "h1", "train"), ("a", "h1", "train"), ("a", "h2", "train"), ("a", "h2", "test"),
            (None, "h3", "train"), (None, "h1", "train"), ("b", None, "train"), ("a", None, "train")]
    df = spark.createDataFrame(rows, "record_id string, k string, split string")
    got = sorted((str(r["record_id"]), str(r["k"]), r["split"], r["is_duplicate"]) for r in audit.later_copies(df, "k").collect())
    assert got == sorted([
        ("a", "h1", "train", False), ("a", "h1", "train", True), ("a", "h2", "train", False), ("a", "h2", "test", False),
        ("None", "h3", "train", False), ("None", "h1", "train", True), ("b", "None", "train", True), ("a", "None", "train", False),
    ])


def test_ids_and_groups(sample):
    assert rows_of(audit.rows_after_first(sample, "record_id")) == [
        ("test", 1), ("train", 0), ("validation", 0)
    ]
    assert rows_of(audit.unique_groups(sample)) == [("test", 2), ("train", 3), ("validation", 1)]
    assert rows_of(audit.group_isolation(sample)) == [(False,)]
    # NULL keys and NULL labels are left out: g1 {Read}, g2 {Read, Write}.
    assert rows_of(audit.single_label_groups(sample.filter("split = 'train'"))) == [(1, 2, 50.0)]


def test_distribution_counts_null_labels_in_the_total(sample):
    got = {r["label"]: (r["n"], r["percentage"]) for r in audit.label_distribution(
        sample.filter("split = 'train'")).collect()}
    assert got["Read"] == (3, 50.0) and got["Write"] == (2, 33.3333) and got["Other"] == (0, 0.0)
    assert list(got) and set(got) == set(LABELS)


def test_columns_depend_on_the_split(sample):
    assert audit.audited_columns(sample)[-1] == "category"
    assert "category" not in audit.audited_columns(sample.drop("category"))


def test_published_shares(spark):
    counts = {"Read": 14084, "Write": 5433, "Execute": 1175, "Destructive": 1264, "Financial": 111, "Other": 76}
    shares = {"Read": 63.6048, "Write": 24.536, "Execute": 5.3064, "Destructive": 5.7084, "Financial": 0.5013, "Other": 0.3432}
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(counts.items()), "category string, n int")
    df = df.select("category", F.explode(F.sequence(F.lit(1), "n")).alias("i"))
    got = {r["label"]: r["percentage"] for r in audit.label_distribution(df).collect()}
    assert got == shares


def test_report(spark, sample, tmp_path):
    document = audit_document(sample.filter("record_id <> '9'"))
    assert {r["split"]: r["n"] for r in document["dataset_sizes"]} == {"train": 6, "validation": 2}
    # Rows 1-4 are equal once stripped; 5 and 6 are equal as well.
    assert document["near_duplicate_summary"] == [{"near_duplicate_records": 6, "percentage": 100.0}]
    first = document["near_duplicate_examples"][0]
    assert (first["record_id_a"], first["record_id_b"], first["similarity"]) == ("1", "2", 1.0)
    assert [r["finding"].split()[0] for r in document["interpretation"]] == ["A", "50.00%", "server_slug", "Splits"]
    assert document["near_duplicate_method"]["threshold"] == 0.9 and "stay" in document["near_duplicate_note"]
    by_field = {(r["field"], r["label"]): r["n"] for r in document["literal_mentions"]}
    assert by_field["name", "Read"] == 4 and by_field["name", "Write"] == 2 and by_field["server_slug", "Read"] == 0
    assert {r["label"]: r["n"] for r in document["exact_name_labels"]}["Write"] == 2
    assert {(r["split"], r["status"]): r["n"] for r in document["schema_validity"]}["train", "missing"] == 2
    assert {(r["split"], r["column"]): r["n"] for r in document["empty_text_fields"]}["train", "description"] == 2
    assert {(r["split"], r["column"]): r["n"] for r in document["missing_values"]}["train", "server_slug"] == 1
    assert "0.9" in {r["metric"]: r["definition"] for r in document["definitions"]}["near_duplicates"]
    write_audit(sample.filter("record_id <> '9'"), str(tmp_path / "audit"))
    assert spark.read.text(str(tmp_path / "audit")).count() == 1
