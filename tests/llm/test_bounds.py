"""Bounds and caps that earlier versions had: alphabets, slices, column names, reading tasks."""

import random

import pyarrow as pa
from pyspark.sql import functions as F
from recordlens.llm import decontaminate as D
from recordlens.llm import language as L
from recordlens.llm import memory as M
from recordlens.llm import warc as W
from recordlens.llm.near_dedup import drop_near_copies


def scripts(seed):
    """Words of 600 CJK letters, of Latin letters, and of Hangul nobody learns."""
    r = random.Random(seed)
    word = lambda low, n: "".join(chr(low + r.randrange(n)) for _ in range(r.randint(2, 5)))
    text = lambda low, n: " ".join(word(low, n) for _ in range(1500))
    return text(0x4E00, 600), text(0x61, 26), text(0xAC00, 600)


def test_letters_of_an_unseen_script_match_nothing():
    chinese, latin, korean = scripts(1)
    model = L.LanguageModel({"en": [latin], "zh": [chinese]})
    assert len(model.alphabet) > 500
    names, _, bits = model.predict([t.encode() for t in (chinese, latin, korean)])
    assert names[:2] == ["zh", "en"]
    assert bits[0] < 8 and bits[1] < 8 and bits[2] > 11


def test_dense_and_sorted_transitions_agree():
    chinese, latin, _ = scripts(2)
    texts = [t[i : i + 90].encode() for t in scripts(3) + (chinese, latin) for i in range(0, 900, 90)]
    room, most = L.DENSE_BYTES, L.DENSE_LETTERS
    try:
        L.DENSE_BYTES, L.DENSE_LETTERS = 1 << 40, 1 << 20
        dense = L.LanguageModel({"en": [latin], "zh": [chinese]})
        L.DENSE_BYTES = 0
        loose = L.LanguageModel({"en": [latin], "zh": [chinese]})
    finally:
        L.DENSE_BYTES, L.DENSE_LETTERS = room, most
    assert all(t.table is not None for t in dense.tables) and all(t.table is None for t in loose.tables)
    assert dense.predict(texts) == loose.predict(texts)


def test_slices_hold_bounded_text_and_every_row():
    r = random.Random(4)
    texts = [None if r.random() < 0.1 else "x" * r.choice([0, 10, 1 << 20, 9 << 20]) for _ in range(60)]
    batch = pa.RecordBatch.from_pydict({"i": list(range(60)), "t": texts})
    emptied = []
    M.emptied(lambda: emptied.append(1))
    got = list(M.slices(iter([batch, batch.slice(0, 0)]), 1))
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(60))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= M.SLICE_BYTES for b in got)
    assert emptied


def test_columns_named_like_those_inside_come_back(spark):
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(words), " ".join(words[:-1] + ["z"]), "other text altogether here now", None]
    names = ["_marked", "_mark_want", "_mark_at", "_mark_row", "_mark_bits", "_doc", "_gone"]
    rows = [(k, t, *[f"{n}{k}" for n in names]) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    got = drop_near_copies(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(map(tuple, got.collect())) == [rows[0], *rows[2:]]


def test_a_benchmark_of_several_parts(spark, monkeypatch):
    monkeypatch.setattr(D, "PART_WORDS", 30)
    items = [(f"i{k}", " ".join(f"b{k}x{j}" for j in range(14))) for k in range(9)]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    texts = ["clean words only"] * 5 + [f"so {t[1]} it is" for t in items] + ["b1x1 b2x2 b3x3"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r["doc_id"] for r in D.drop_contaminated(docs, benchmark).collect()}
    assert kept == {0, 1, 2, 3, 4, 14}
    plan = D.drop_contaminated(docs, benchmark)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_archives_are_read_by_as_many_tasks_as_they_have_parts(spark, monkeypatch):
    monkeypatch.setattr(W, "TASK_BYTES", 2000)
    r = random.Random(5)
    rows = [(k, f"http://h/{k}", "".join(r.choices("abcdefghij <>", k=800))) for k in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = W.read_records(W.write_archives(pages))
    assert got.count() == 60
    tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks >= 8
