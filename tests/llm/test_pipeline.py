"""The whole run against its stages rebuilt in plain Python."""

import re
import zlib
from collections import defaultdict

import numpy as np

import corpus_pipeline
from conftest import lower_ascii, normalised
from recordlens.llm.language import learn
from recordlens.llm.queries import third_of, word_bpe
from test_dedup import near
from test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(text))
    m = min(10, len(words))
    return {tuple(words[k : k + m]) for k in range(len(words) - m + 1)} if words else set()


def rebuilt(docs, items, model):
    """Ids and texts that reach the last stage."""
    names, _, bits = model.predict([(t or "").encode() for _, t in docs])
    docs = [d for d, n, b in zip(docs, names, bits) if n != "und" and b <= corpus_pipeline.MOST_BITS]
    first = {}
    for i, t in sorted(docs):
        first.setdefault(normalised(t), (i, t))
    docs = sorted(first.values())
    kept = {i for i, _, _, k in near([t for _, t in docs], [i for i, _ in docs]) if k}
    runs = defaultdict(set)
    for _, t in items:
        for w in windows(t):
            runs[len(w)].add(w)
    out = []
    for i, t in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))
        hit = any(tuple(words[k : k + m]) in some for m, some in runs.items() for k in range(len(words) - m + 1))
        if i in kept and not hit:
            out.append((i, t))
    return out


def test_run_equals_plain_python(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = learn(docs.where(third_of() != 1))
    left = rebuilt([tuple(r) for r in docs.select("doc_id", "text").collect()], items, model)
    assert 0 < len(left) < docs.count()
    tokenizer, want = Tokenizer.from_file(word_bpe()), []
    for i, t in left:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 1]
        for piece, a in enumerate(range(0, len(ids), 4096)):
            own = ids[a : a + 4096]
            want.append((i, piece, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    assert check_packing(rows, 4096) <= -(-sum(x[3] for x in want) // 4096) + 1


def test_stages_keep_the_columns(spark, documents):
    docs = documents(["one two", None, "1 2", "uno dos", "one  two"], langs=["en", None, "en", "es", "en"])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), SF).count() == 0
    ids = {r["doc_id"] for r in corpus_pipeline.STAGES[0][1](spark, docs, SF).collect()}
    assert 1 not in ids and 2 not in ids
    assert len(corpus_pipeline.STAGES) == 5


def test_a_stage_on_repeated_and_null_rows(spark, documents):
    docs = documents(["same text here"] * 3 + ["other words"], [4, 4, None, 4])
    left = corpus_pipeline.exact_dedup(spark, docs, SF)
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(4, "other words"), (4, "same text here")]
    assert corpus_pipeline.near_dedup(spark, left, SF).count() == 2
