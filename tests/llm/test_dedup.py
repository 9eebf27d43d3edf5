from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import pytest

from conftest import AWKWARD, ascii_words, corpus, frame, lower_ascii, normalised, sha
from recordlens.llm import near_dedup as N
from recordlens.llm import substring_dedup as S
from recordlens.llm.components import components
from recordlens.llm.exact_dedup import drop_copies, exact_groups
from recordlens.llm.marks import marked, marks, sent, with_mark
from pyspark.sql import functions as F


def test_marks_keep_every_key(spark):
    some = spark.range(0, 5000).select((F.col("id") * 7919 - 10_000).alias("k"))
    rows = spark.range(0, 50_000).select((F.col("id") - 20_000).alias("k"))
    got = with_mark(rows, marks(some, F.xxhash64("k")), F.xxhash64("k"), "m")
    both = got.join(some.withColumn("in", F.lit(True)), "k", "left")
    assert both.filter("in AND NOT m").isEmpty()
    assert both.filter("in IS NULL AND m").count() < 50
    assert with_mark(rows, marks(some.limit(0), F.xxhash64("k")), F.xxhash64("k"), "m").filter("m").isEmpty()


def test_marks_sent_to_tasks_say_the_same(spark):
    some = spark.range(0, 3000).select((F.col("id") * 982_451_653_123 - 10**15).alias("k"))
    bits = sent(marks(some, F.col("k")))
    rows = with_mark(some.union(some.select(F.col("k") + 67_108_864 * 5 + F.col("k") % 3)), marks(some, F.col("k")), F.col("k"), "m").collect()
    got = marked(bits.value, np.array([r["k"] for r in rows], np.int64))
    assert got.tolist() == [r["m"] for r in rows] and 3000 <= got.sum() < len(rows)
    assert not marked(sent(marks(some.limit(0), F.col("k"))).value, np.array([0, -1], np.int64)).any()


def exact(texts, ids):
    groups = defaultdict(list)
    for i, t in zip(ids, texts):
        groups[normalised(t)].append(i)
    return sorted(
        (i, min(groups[normalised(t)]), len(groups[normalised(t)]), i == min(groups[normalised(t)]), sha(normalised(t)))
        for i, t in zip(ids, texts)
    )


def test_exact_groups_equal_brute_force(spark, documents):
    texts = corpus(60, 1) + ["hot copy"] * 200
    got = exact_groups(documents(texts))
    assert sorted(map(tuple, got.collect())) == exact(texts, range(len(texts)))


def test_exact_groups_with_null_and_repeated_ids(spark, documents):
    got = exact_groups(documents(["a", "a ", "a", "a", "b", "c"], [None, 4, 4, 9, None, 4])).collect()
    by = sorted((r["text_sha256"][:4], r["keep_id"], r["group_size"]) for r in got)
    assert sorted(x[2] for x in by) == [1, 1, 1, 3, 3, 3]
    assert sum(r["kept"] for r in got) == 4
    assert {r["keep_id"] for r in got if r["group_size"] == 3} == {4}


def test_drop_copies_keeps_one_row_whole(spark, documents):
    texts = corpus(40, 2)
    docs = documents(texts, [*range(len(texts) - 2), 0, None])
    got = drop_copies(docs)
    assert got.dtypes == docs.dtypes
    rows = got.collect()
    assert sorted(normalised(r["text"]) for r in rows) == sorted({normalised(t) for t in texts})
    assert {tuple(r) for r in rows} <= {tuple(r) for r in docs.collect()}


def test_exact_on_an_empty_table(spark, documents):
    empty = documents(["a"]).limit(0)
    assert exact_groups(empty).count() == 0 and drop_copies(empty).count() == 0


def shingles(text):
    words = ascii_words(lower_ascii(text))
    k = min(5, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def near(texts, ids):
    sets = [shingles(t) for t in texts]
    top = list(range(len(ids)))

    def root(k):
        while top[k] != k:
            k = top[k]
        return k

    for a in range(len(ids)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                top[max(root(a), root(b), key=lambda k: ids[k])] = min(root(a), root(b), key=lambda k: ids[k])
    return sorted((i, len(sets[k]), ids[root(k)], ids[root(k)] == i) for k, i in enumerate(ids))


@pytest.mark.parametrize("seed, crowd", [(3, 2048), (4, 6)])
def test_near_groups_equal_brute_force(spark, documents, monkeypatch, seed, crowd):
    monkeypatch.setattr(N, "CROWD", crowd)
    texts = corpus(70, seed)
    got = N.near_groups(documents(texts))
    assert sorted(map(tuple, got.collect())) == near(texts, list(range(len(texts))))


def test_pairs_in_a_crowded_template_are_found(spark, documents, monkeypatch):
    """Of 2,500 such pairs, three that share six values in none of the first 20 orders."""
    monkeypatch.setattr(N, "CROWD", 4)
    template = [f"t{k}" for k in range(169)]

    def text(p, side):
        return " ".join(template + [f"pair{p}x{k}" for k in range(4)] + [f"own{p}x{side}x{k}" for k in range(27)])

    texts = [text(p, side) for p in (653, 692, 1284) for side in range(2)] + [text(f"f{p}", 0) for p in range(12)]
    got = sorted(map(tuple, N.near_groups(documents(texts)).collect()))
    assert got == near(texts, list(range(len(texts)))) and sum(not row[3] for row in got) == 3


def test_a_star_of_near_copies_is_one_component(spark, documents):
    """Copies that are near their base but not near each other, close to the threshold."""
    base = [f"b{k}" for k in range(200)]
    texts = [" ".join(base)]
    for k in range(40):
        words = list(base)
        for at in range(3 + k, 200, 45):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    got = {r["doc_id"]: r["component_id"] for r in N.near_groups(documents(texts)).collect()}
    want = {i: c for i, _, c, _ in near(texts, list(range(len(texts))))}
    assert got == want and len(set(want.values())) == 1


def test_near_groups_with_null_and_repeated_ids(spark, documents):
    text = "one two three four five six"
    got = N.near_groups(documents([text, text, text, "x y", None, "z", "z"], [None, 7, 7, 7, 8, None, None])).collect()
    by = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by == {(None, 2, 7, False), (7, 2, 7, True), (7, 1, 7, True), (8, 0, 8, True), (None, 1, None, True)}


def test_drop_near_copies(spark, documents):
    texts = corpus(30, 5)
    docs = documents(texts)
    got = N.drop_near_copies(docs)
    assert got.dtypes == docs.dtypes
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _, _, kept in near(texts, list(range(len(texts)))) if kept]
    repeated = documents(["p q r s t u", "other", "p q r s t u", "solo", None, None], [5, 6, 6, 7, None, None])
    rows = sorted(((r["doc_id"], r["text"]) for r in N.drop_near_copies(repeated).collect()), key=str)
    assert rows == [(5, "p q r s t u"), (6, "other"), (7, "solo"), (None, None), (None, None)]


def test_near_on_empty_tables(spark, documents):
    assert N.near_groups(documents(["a"]).limit(0)).count() == 0
    assert N.near_groups(documents([None, "", " "])).filter("kept").count() == 3


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        cut = int(3000 * (1 - share) / 2)
        a, b = N.signatures([np.sort(pool[cut:]), np.sort(pool[: 3000 - cut])])
        assert abs((a == b).mean() - (3000 - 2 * cut) / 3000) < 0.12


def test_components_of_a_chain_and_a_hub(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 50)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 50)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(texts, window=20):
    seen, out = set(), []
    for i, text in enumerate(texts):
        words = ascii_words(text)
        keep = [True] * len(words)
        for at in range(len(words) - window + 1):
            run = tuple(words[at : at + window])
            if run in seen:
                keep[at : at + window] = [False] * window
            seen.add(run)
        left = " ".join(w for w, k in zip(words, keep) if k)
        out.append((i, len(words), keep.count(False), sha(left)))
    return out


def test_substrings_equal_brute_force(spark, documents):
    texts = [t for t in corpus(60, 6) if t is None or len(t) < 20_000]
    texts += ["same again " * 40, "x y z " * 30 + "end", " ".join(f"v{k}" for k in range(25)) * 2]
    texts += [f"own{k} " + " ".join(f"p{j}" for j in range(60)) + f" tail{k}" for k in range(40)]
    got = S.remove_repeats(documents(texts))
    assert sorted(map(tuple, got.collect())) == removed(texts)


@pytest.mark.parametrize("window", [3, 8, 20])
def test_stretches_of_documents_laid_end_to_end(window):
    r = np.random.default_rng(4)
    lengths = np.array([0, 5, 40, window, 0, window - 1, 200, 1, 60, 0])
    hashes = r.integers(0, 30, lengths.sum()).astype(np.uint64)
    anchor, want = min(S.ANCHOR, window), []
    for row, start in enumerate(np.cumsum(lengths) - lengths):
        runs, last = S.run_hashes(hashes[start : start + lengths[row]], anchor), None
        for k in range(lengths[row] - window + 1):
            place = k + int(np.argmin(runs[k : k + window - anchor + 1]))
            if place == last:
                want[-1][3] += 1
            else:
                want.append([int(runs[place]), row, int(start) + k, 1])
            last = place
    assert [list(x) for x in zip(*(c.tolist() for c in S.stretches(hashes, lengths, window)))] == want


def test_only_stretches_that_may_repeat_are_cut_out(spark, documents, monkeypatch):
    def refuse(text):
        raise AssertionError("a stretch was cut out that has no second place")

    monkeypatch.setattr(S, "xxhash", SimpleNamespace(xxh3_128_digest=refuse))
    texts = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(20)]
    assert sorted(map(tuple, S.remove_repeats(documents(texts)).collect())) == removed(texts)


def low_run(n, seed):
    """Of random runs of ``n`` words, the one with the lowest hash, so that it is an anchor."""
    r = np.random.default_rng(seed)
    runs = [[f"a{k}" for k in r.integers(0, 1 << 30, n)] for _ in range(20_000)]
    return min(runs, key=lambda run: int(S.run_hashes(S.word_hashes([w.encode() for w in run]), n)[0]))


def test_windows_of_a_stretch_covered_by_two_others_are_known_later(spark, documents):
    """Spans that overlap cover B, but the windows across them are first seen in B."""
    passage = [f"p{k}" for k in range(12)] + low_run(8, 1) + [f"p{k}" for k in range(20, 32)]

    def edited(*places):
        return " ".join(f"new{k}" if k in places else w for k, w in enumerate(passage))

    texts = [edited(22), edited(7), edited(), edited(2, 28)]
    got = sorted(map(tuple, S.remove_repeats(documents(texts)).collect()))
    assert got == removed(texts) and [r[2] for r in got] == [0, 0, 32, 25]


def test_automata_stay_bounded_however_many_texts_share_an_anchor(spark, documents, monkeypatch):
    class Bounded(S.Automaton):
        def add(self, words):
            super().add(words)
            assert self.texts <= 2048

    monkeypatch.setattr(S, "Automaton", Bounded)
    r, run = np.random.default_rng(2), low_run(8, 3)
    texts = []
    for k in range(2300):
        words = [*(f"b{x}" for x in r.integers(0, 1 << 30, 12)), *run, *(f"c{x}" for x in r.integers(0, 1 << 30, 12))]
        if k % 50 == 0:
            words[3:12], words[20:29] = [f"q{x}" for x in range(9)], [f"q{x}" for x in range(k % 7, k % 7 + 9)]
        texts.append(" ".join(words))
    got = sorted(map(tuple, S.remove_repeats(documents(texts)).collect()))
    assert got == removed(texts) and sum(x[2] for x in got) > 0


def test_crowded_anchors_equal_brute_force(spark, documents, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 1)
    texts = [t for t in corpus(60, 8) if t is None or len(t) < 20_000]
    texts += ["x y z " * 30 + "end", " ".join(f"v{k}" for k in range(25)) * 2]
    got = S.remove_repeats(documents(texts, [None, *range(1, len(texts))])).collect()
    want = [(None, *row[1:]) if row[0] == 0 else row for row in removed(texts)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_substring_texts_and_odd_rows(spark, documents):
    run = " ".join(f"r{k}" for k in range(20))
    docs = documents([run, run, f"lead {run}  tail", None], [3, None, 9, 4])
    got = {r["doc_id"]: (r["n_removed"], r["text"]) for r in S.remove_repeats(docs, with_text=True).collect()}
    assert got == {None: (0, run), 3: (20, ""), 9: (20, "lead tail"), 4: (0, "")}
    same = S.remove_repeats(documents([run, run], [1, 1])).collect()
    assert [r["n_removed"] for r in same] == [0, 0]
    assert S.remove_repeats(docs.limit(0)).count() == 0


def test_automaton_matches_are_maximal():
    a = S.Automaton()
    a.add(list("abcdefgh"))
    a.add(list("xyabczz"))
    assert a.matches(list("qabcdeqxyabq"), 3) == [[1, 6], [7, 11]]
    assert a.matches(list("hxy"), 3) == []


def test_awkward_texts_pass_through_all(spark, documents):
    for op in (exact_groups, N.near_groups, S.remove_repeats):
        assert op(documents(AWKWARD)).count() == len(AWKWARD)
