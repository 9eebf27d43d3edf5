"""Two-sided search and hard negatives against a dense computation; calibration against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from recordlens.operators import calibration, leakage


def texts(seed, n, hot):
    """Random texts; with ``hot`` most hold the same frequent words in other numbers."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        if hot and r.random() < 0.6:
            out.append(" ".join(["aa"] * r.randint(1, 6) + ["bb"] * r.randint(1, 6) + ["cc"] * r.randint(1, 4)))
        else:
            out.append(" ".join(r.choices([f"w{k}" for k in range(30)], k=r.randint(0, 9))))
    return out + out[:5]


def dense(texts):
    """Unit vectors of 1-2-grams in two texts or more, as the operators define them."""
    grams = []
    for t in texts:
        w = (t or "").split()
        grams.append(Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])]))
    df = Counter(g for c in grams for g in c)
    terms = {t: k for k, t in enumerate(sorted(t for t, n in df.items() if n >= 2))}
    out = np.zeros((len(texts), len(terms)))
    for i, c in enumerate(grams):
        for t, n in c.items():
            if t in terms:
                out[i, terms[t]] = (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def best(sim, allowed, ids, threshold):
    sim = np.where(allowed, np.round(sim, 9), -1)
    return {ids[k]: (ids[int(row.argmax())], row.max()) for k, row in enumerate(sim) if row.max() >= threshold}


@pytest.mark.parametrize("hot,frequent", [(False, 256), (True, 8)])
def test_near_other_split_equals_dense(spark, hot, frequent):
    left, right = texts(1, 90, hot), texts(2, 40, hot) + texts(1, 90, hot)[3:9]
    x = dense(left + right)
    sim = np.round(x[: len(left)] @ x[len(left) :].T, 9)
    want = {k: (int(row.argmax()), row.max()) for k, row in enumerate(sim) if row.max() >= 0.8}
    frames = [spark.createDataFrame(list(enumerate(t)), "id long, text string").repartition(3) for t in (left, right)]
    got = leakage.near_other_split(*frames, "id", "text", threshold=0.8, frequent=frequent).collect()
    assert len(got) == len(want) > 5
    assert {r["id"]: r["other"] for r in got} == {k: v[0] for k, v in want.items()}
    for r in got:
        assert r["similarity"] == pytest.approx(want[r["id"]][1], abs=1e-8)
    kept = leakage.drop_near_other_split(*frames, "id", "text", threshold=0.8, frequent=frequent)
    assert {r["id"] for r in kept.collect()} == set(range(len(left))) - set(want)


@pytest.mark.parametrize("hot,frequent", [(False, 256), (True, 8)])
def test_hard_negatives_equal_dense(spark, hot, frequent):
    r = random.Random(7)
    all_texts = texts(3, 140, hot)
    n = len(all_texts)
    groups = ["big" if r.random() < 0.7 else r.choice(["g1", "g2", None]) for _ in range(n)]
    labels = [r.choice(["a", "b", "c", None, "outside"]) for _ in range(n)]
    used = [k for k in range(n) if groups[k] is not None and labels[k] in ("a", "b", "c")]
    x = dense([all_texts[k] for k in used])
    same = np.array([[groups[i] == groups[j] and labels[i] != labels[j] for j in used] for i in used])
    want = best(x @ x.T, same, used, 0.5)
    df = spark.createDataFrame(
        [(k, all_texts[k], groups[k], labels[k]) for k in range(n)], "id long, text string, grp string, label string"
    ).repartition(3)
    got = leakage.hard_negatives(df, "id", "text", "grp", "label", ["a", "b", "c"], frequent=frequent).collect()
    assert {r["id"]: r["other"] for r in got} == {k: v[0] for k, v in want.items()}
    assert len(got) > 20


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, "a b"), (2, "a b")], "id long, text string")
    assert leakage.near_other_split(some, some.limit(0), "id", "text").count() == 0
    assert leakage.drop_near_other_split(some, some.limit(0), "id", "text").count() == 2


def test_threshold_sweep_equals_plain_counts(spark):
    r = random.Random(4)
    labels = ["x", "y", "Other"]
    rows = [(r.choice([*labels, None]), r.choice([*labels, "bad", None]), r.choice([None, 0.1, 0.5, 0.75, 0.9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "a string, p string, c double")
    levels = [0.0, 0.5, 0.8, 1.0]
    got = {r["threshold"]: r for r in calibration.threshold_sweep(df, "a", "p", "c", "Other", levels, labels).collect()}
    for t in levels:
        given = [(a, p if c is not None and c >= t else "Other", c is not None and c >= t) for a, p, c in rows]
        f1 = 0
        for x in labels:
            hit = sum(a == x and g == x for a, g, _ in given)
            both = sum(a == x for a, _, _ in given) + sum(g == x for _, g, _ in given)
            f1 += 2 * hit / both if both else 0
        assert got[t]["macro_f1"] == pytest.approx(f1 / 3)
        assert got[t]["coverage"] == pytest.approx(sum(k for *_, k in given) / 300)
        assert got[t]["accuracy"] == pytest.approx(sum(a is not None and a == g for a, g, _ in given) / 300)
    pick = calibration.best_threshold(calibration.threshold_sweep(df, "a", "p", "c", "Other", levels, labels)).first()
    assert pick["macro_f1"] == max(r["macro_f1"] for r in got.values())


def test_temperature_undoes_a_known_scale(spark):
    r = np.random.default_rng(1)
    true = r.normal(size=(4000, 3)) * 1.5
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    y = [int(r.choice(3, p=q)) for q in p]
    rows = [([float(v) for v in z * 2.5], k) for z, k in zip(true, y)] + [(None, 0), ([1.0, None, 2.0], 1), ([1.0, 2.0, 3.0], 7)]
    df = spark.createDataFrame(rows, "z array<double>, y int").repartition(4).cache()
    grid = np.linspace(0.05, 1, 400)
    loss = [np.mean(np.log(np.exp(true * 2.5 * g).sum(1)) - (true * 2.5 * g)[np.arange(4000), y]) for g in grid]
    best_of_grid = 1 / grid[int(np.argmin(loss))]
    found = calibration.fit_temperature(df, "z", "y")
    assert found == pytest.approx(best_of_grid, rel=0.02) and 2.2 < found < 2.8
    before, after = (calibration.calibration_error(df, "z", "y", t).first() for t in (1.0, found))
    assert before["n"] == after["n"] == 4000 and before["accuracy"] == after["accuracy"]
    assert after["error"] < 0.03 < before["error"]
    assert calibration.fit_temperature(df.limit(0), "z", "y") == 1.0


def test_training_rows_are_kept_without_a_shuffle_of_their_texts(spark):
    train = spark.createDataFrame([(i, f"one two three{i} four{i % 7} five") for i in range(60)], "id long, text string")
    held = spark.createDataFrame([(i, f"one two three{i} four{i % 7} five") for i in range(5)], "id long, text string")
    kept = leakage.drop_near_other_split(train, held, "id", "text")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert sorted(r["id"] for r in kept.collect()) == list(range(5, 60))


def test_chunks_of_one_class_do_not_meet(spark, monkeypatch):
    """Of 16 chunks of training rows and 2 of others only pairs across, and at the border, are looked at."""
    from recordlens.operators import neighbors

    r = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = [(2 * i + (i % 9 == 0), " ".join(r.sample(words, 12))) for i in range(900)]
    vectors = neighbors.vector_table(spark.createDataFrame(rows, "id long, text string"), "id", "text")
    groups = neighbors._vector_groups(vectors).join(vectors.select("id", "v"), "id")
    leading = neighbors._leading(groups, 0.9)
    monkeypatch.setattr(neighbors, "CHUNKS", 18)
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)

    def marks(*_):
        def tile(key, table):
            import pyarrow as pa

            a, b = (k.as_py() for k in key)
            both = len({x % 2 for x in table.column("id").to_pylist()}) == 2
            columns = [[a], [b], [both], [a], [b], [[]]]
            return pa.table(dict(zip(["i", "j", "blocks", "b1", "b2", "who"], columns)), schema=pa.schema(
                [("i", pa.int64()), ("j", pa.int64()), ("blocks", pa.bool_()), ("b1", pa.int64()), ("b2", pa.int64()), ("who", pa.list_(pa.int64()))]
            ))

        return tile

    monkeypatch.setattr(neighbors, "_tile_pairs", marks)
    met = neighbors._candidates(leading, neighbors._blocks(leading, 256, 2), 0.9, 256, 2).collect()
    assert met and all(m["blocks"] for m in met) and len(met) < 18 * 19 / 2 / 2
