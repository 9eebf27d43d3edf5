import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordlens.operators import features, neighbors


def python_vectors(texts, min_df=2, max_features=10**6):
    """Plain dense reference: unit TF-IDF rows over word 1-2-grams."""
    docs = []
    for t in texts:
        w = re.findall(r"\w\w+", t.lower())
        docs.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df, ctf = Counter(), Counter()
    for d in docs:
        df.update(d.keys())
        ctf.update(d)
    kept = sorted((t for t in df if df[t] >= min_df), key=lambda t: (-ctf[t], t))[:max_features]
    at = {t: i for i, t in enumerate(kept)}
    x = np.zeros((len(texts), len(kept)))
    for i, d in enumerate(docs):
        for t, n in d.items():
            if t in at:
                x[i, at[t]] = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
        norm = np.linalg.norm(x[i])
        if norm:
            x[i] /= norm
    return kept, x


def python_neighbors(texts, threshold=0.9):
    _, x = python_vectors(texts)
    sim = np.round(x @ x.T, neighbors.DECIMALS)
    np.fill_diagonal(sim, -1)
    out = {}
    for i in range(len(texts)):
        j = int(sim[i].argmax())
        if sim[i, j] >= threshold:
            out[i] = (j, float(sim[i, j]))
    return out


def corpus(n, seed, hot=0):
    """Random texts, exact copies, near copies, and one template for ``hot`` rows."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(r.choices(words, k=r.randint(5, 60))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        if r.random() < 0.2:
            out.append(t)
        if r.random() < 0.3:
            w = t.split()
            w[r.randrange(len(w))] = r.choice(words)
            out.append(" ".join(w))
    template = r.choices(words, k=40)
    for _ in range(hot):
        w = list(template)
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    out += ["", "zz", "!!"]
    r.shuffle(out)
    return out


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


@pytest.mark.parametrize("limit", [50, 10**6])
def test_weights_equal_python(spark, limit):
    texts = corpus(40, 1)
    kept, x = python_vectors(texts, max_features=limit)
    df = frame(spark, texts)
    vocab = features.fit_vocabulary(df, "text", 2, limit)
    terms = {r["ix"]: r["term"] for r in vocab.collect()}
    assert sorted(terms.values()) == sorted(kept)
    at = {t: i for i, t in enumerate(kept)}
    seen = 0
    for r in features.tfidf_entries(df, "id", "text", vocab).collect():
        assert len(r["v"]) == np.count_nonzero(x[r["id"]])
        for e in r["v"]:
            assert e["w"] == pytest.approx(x[r["id"], at[terms[e["ix"]]]], abs=1e-12)
            seen += 1
    assert seen == np.count_nonzero(x)


@pytest.mark.parametrize("seed, hot, frequent", [(2, 0, 256), (3, 120, 256), (3, 120, 8), (4, 300, 20)])
def test_neighbors_equal_brute_force(spark, seed, hot, frequent, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 32)
    texts = corpus(150, seed, hot)
    found = neighbors.nearest_neighbors(frame(spark, texts), "id", "text", frequent=frequent)
    got = {r["id"]: (r["other"], r["similarity"]) for r in found.collect()}
    assert got == python_neighbors(texts)


def test_hot_group_of_copies(spark):
    """A third of the rows are one text; another third differ in a word of their own."""
    texts = [f"alpha beta gamma delta common{i % 50} unique{i} tail{i * 7 % 50}" for i in range(200)]
    texts += ["the very same text each time"] * 200
    texts += [f"shared words in every row but own{i}" for i in range(200)]
    found = neighbors.nearest_neighbors(frame(spark, texts), "id", "text")
    got = {r["id"]: (r["other"], r["similarity"]) for r in found.collect()}
    assert got == python_neighbors(texts)


def test_top_rows_below_the_threshold(spark):
    r = random.Random(7)
    texts = [" ".join(r.choices([f"w{k}" for k in range(30)], k=12)) for _ in range(40)]
    found = neighbors.nearest_for_top(frame(spark, texts), "id", "text", k=5)
    got = sorted((-x["similarity"], x["id"], x["other"]) for x in found.collect())[:5]
    every = python_neighbors(texts, threshold=0.0)
    assert got == sorted((-s, i, j) for i, (j, s) in every.items())[:5]


def test_top_rows_with_nothing_in_common(spark):
    texts = [f"only{i} here{i}" for i in range(28)] + ["same words", "same words too"]
    found = neighbors.nearest_for_top(frame(spark, texts), "id", "text", k=20)
    got = sorted((-x["similarity"], x["id"], x["other"]) for x in found.collect())
    every = sorted((-s, i, j) for i, (j, s) in python_neighbors(texts, threshold=0.0).items())
    assert got == every[:20] and got[-1][0] == 0.0
    few = frame(spark, ["a b", "c d"])
    assert sorted(map(tuple, neighbors.nearest_for_top(few, "id", "text").collect())) == [(0, 1, 0.0), (1, 0, 0.0)]
    assert neighbors.nearest_for_top(few.limit(1), "id", "text").count() == 0


def test_join_hot_keys_keeps_every_row(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    lookup = rows.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = neighbors.join_hot_keys(rows, lookup, "k", share=0.01)
    assert got.count() == 3000 and got.filter("v <> k * 2").count() == 0


def test_no_cartesian_products(spark):
    texts = corpus(30, 5)
    plan = neighbors.nearest_neighbors(frame(spark, texts), "id", "text")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_candidates_leave_a_task_only_if_they_can_match(spark):
    """Every row shares a prefix term with every fourth other one, but few are similar."""
    r = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    texts = [f"mark{i % 4} " + " ".join(r.choices(words, k=30)) for i in range(240)]
    texts += [f"{t} {words[i]}" for i, t in enumerate(texts[:30])]
    vectors = neighbors.vector_table(frame(spark, texts), "id", "text")
    groups = neighbors._vector_groups(vectors).join(vectors.select("id", "v"), "id")
    leading = neighbors._leading(groups, 0.9)
    met = neighbors._candidates(leading, neighbors._blocks(leading, 256), 0.9, 256)
    got = {(r["i"], r["j"]) for r in met.collect() if not r["blocks"]}
    want = {tuple(sorted((i, j))) for i, (j, _) in python_neighbors(texts).items()}
    assert len(want) > 20 and want <= {tuple(sorted(p)) for p in got}
    assert len(got) < 3 * len(want)


def test_partitions_grow_with_the_text(spark, monkeypatch):
    from recordlens import session

    monkeypatch.setattr(session, "TASK_TEXT_BYTES", 1000)
    df = frame(spark, corpus(150, 5))
    size = df.agg(F.sum(F.octet_length("text"))).first()[0]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    vocab = features.fit_vocabulary(df, "text", 2, 1000)
    entries = features.tfidf_entries(df, "id", "text", vocab)
    assert entries.rdd.getNumPartitions() == -(-size // 1000) > 8
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    assert entries.count() == df.count()


def test_frequent_terms_of_segments_are_those_of_the_whole(spark, monkeypatch):
    """What no segment has twice is not dealt out, and the vocabulary is the same."""
    from recordlens.operators import arrow_terms

    monkeypatch.setattr(arrow_terms, "SEGMENT_WORDS", 1500)
    df = frame(spark, corpus(300, 8))
    told = []
    stored = features.stored
    monkeypatch.setattr(features, "stored", lambda found, name: told.append(stored(found, name)) or told[-1])
    # ``corpus`` has 400 words; pairs of them make most of the terms.
    for limit in (60, 300):
        want = features.fit_vocabulary(df, "text", 2, limit).collect()
        monkeypatch.setattr(features, "SEGMENTED_BYTES", 0)
        assert features._frequent_statistics(df, "text", 2, limit, True) is not None
        assert sorted(features.fit_vocabulary(df, "text", 2, limit).collect()) == sorted(want)
        monkeypatch.undo()
        monkeypatch.setattr(arrow_terms, "SEGMENT_WORDS", 1500)
    assert told[0].count() * 4 < features.term_statistics(df, "text").count()
    # Terms that no segment told of may belong to a vocabulary without a cut.
    assert features._frequent_statistics(df, "text", 2, 10**6, True) is None
    assert features._frequent_statistics(df.limit(0), "text", 2, 10, True) is None


def test_rows_of_one_key_are_one_document(spark):
    texts = corpus(40, 6)
    rows = [(None if i % 9 == 0 else i // 2 if i % 5 == 0 else i, None if i % 7 == 0 else t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, text string")
    vocab = features.fit_vocabulary(df, "text", 2, 200)
    got = features.tfidf_entries(df, "id", "text", vocab).collect()
    want = features._shuffled_entries(df, "id", "text", vocab, 3, True).collect()
    order = lambda rows: sorted(rows, key=lambda r: (r["id"] is not None, r["id"]))
    assert [r["id"] for r in order(got)] == [r["id"] for r in order(want)]
    for a, b in zip(order(got), order(want)):
        assert [(e["ix"], e["tf"]) for e in a["v"]] == [(e["ix"], e["tf"]) for e in b["v"]]
        assert [e["w"] for e in a["v"]] == pytest.approx([e["w"] for e in b["v"]], abs=1e-12)


def test_large_vocabulary_goes_by_shuffle(spark, monkeypatch):
    from recordlens import session

    df = frame(spark, corpus(40, 7))
    want = {r["id"]: r for r in neighbors.nearest_neighbors(df, "id", "text").collect()}
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    assert {r["id"]: r for r in neighbors.nearest_neighbors(df, "id", "text").collect()} == want and want


def test_only_rows_concerned_are_compared_in_blocks(spark):
    """Rows with many possible partners stand in blocks with others, which are not sent along."""
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    template = [f"t{k}" for k in range(40)]
    texts = [" ".join(["mark", *r.sample(words, 30)]) for _ in range(200)]
    texts += [" ".join(["mark", *template, words[k]]) for k in range(30)]
    vectors = neighbors.vector_table(frame(spark, texts), "id", "text")
    groups = neighbors._vector_groups(vectors).join(vectors.select("id", "v"), "id")
    leading = neighbors._leading(groups, 0.9)
    found = neighbors._candidates(leading, neighbors._blocks(leading, 8), 0.9, 8).collect()
    who = {i for f in found if f["blocks"] for i in f["who"]}
    assert set(range(200, 230)) <= who and len(who) < 60
    got = {r["id"]: (r["other"], r["similarity"]) for r in neighbors.nearest_neighbors(frame(spark, texts), "id", "text", frequent=8).collect()}
    assert got == python_neighbors(texts) and len(got) >= 30


def test_packed_counts_are_read_back():
    from recordlens.operators import arrow_terms

    r = np.random.default_rng(0)
    for n, terms in ((7, 50), (1, 5), (60, 10**6), (3, 3)):
        m = int(r.integers(0, 300))
        row, ids = np.sort(r.integers(0, n, m)), r.integers(0, terms, m)
        both = arrow_terms.packed_counts(ids, row, n, terms)
        for lo, hi in ((0, n), (n // 2, n), (0, 0)):
            length, ix, tf = arrow_terms.unpacked_counts(*(x.slice(lo, hi - lo) for x in both))
            want = Counter((a, b) for a, b in zip(row.tolist(), ids.tolist()) if lo <= a < hi)
            assert len(length) == hi - lo
            assert dict(zip(zip(np.repeat(np.arange(lo, hi), length).tolist(), ix.tolist()), tf.tolist())) == want
