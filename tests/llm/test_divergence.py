"""Divergence of sources against plain Python, and blocks spilled at any size against one block."""

import random
from collections import Counter, defaultdict
from itertools import groupby

from conftest import AWKWARD, lower_ascii
from recordlens.llm import divergence as D

import re

SCHEMA = "doc_id long, lang string, source string, text string, term string, count long, p long, kept long"


def terms(text):
    return re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower_ascii(text))


def brute(rows, least):
    tf, df, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        tf[lang, source].update(terms(text))
        df[lang].update(set(terms(text)))
    out = set()
    gap = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = [s for x, s in groups if x == lang]
        shares = {}
        whole = Counter()
        for s in sources:
            n = sum(tf[lang, s][t] for t in kept)
            shares[s] = {t: 1 + 10**9 * (tf[lang, s][t] + 2) // (n + 2 * len(kept)) for t in kept}
            whole.update({t: tf[lang, s][t] for t in kept})
        n = sum(whole.values())
        q = {t: 1 + 10**9 * (whole[t] + 2) // (n + 2 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(gap(shares[s][t], shares[o][t]) for t in kept), o.encode()) for o in sources if o != s)
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)}
            own = sorted((-gap(shares[s][t], q[t]), t.encode()) for t in kept if tf[lang, s][t] and shares[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(own[:10])}
    return out


def corpus(seed, n):
    r = random.Random(seed)
    words = ["alpha", "Beta", "ÄÖ", "d'e", "x1y", "ß", "漢字", "zz"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = []
    for _ in range(n):
        lang = r.choice(["en", "en", "de", None, "rare"]) if r.random() < 0.98 else "lone"
        source = r.choice(["hot"] * 6 + ["s1", "s2", "é", None])
        own = words[: 4 + 3 * (ord((source or "n")[0]) % 7)]
        rows.append((lang, source, " ".join(r.choices(own, k=r.randint(0, 12)))))
    rows += [("en", "hot", t) for t in AWKWARD if t is None or len(t) < 10_000] + [("en", "bare", "123 !!"), ("only", "one", "a b")]
    return rows + rows[:20]


def test_divergences_equal_plain_python(spark):
    rows = corpus(1, 400)
    docs = spark.createDataFrame([(k, *r, "x", 1, 2, 3) for k, r in enumerate(rows)], SCHEMA).repartition(4)
    got = [tuple(r) for r in D.divergences(docs).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, D.LEAST_DOCS)


def test_an_empty_table(spark):
    docs = spark.createDataFrame([(1, "en", "s", "a", "x", 1, 2, 3)], SCHEMA)
    assert D.divergences(docs.limit(0)).count() == 0
    assert [tuple(r) for r in D.divergences(docs).collect()] == []


def test_any_number_of_spilled_runs_merges_to_the_same():
    r = random.Random(3)
    rows = [(lang or "", source or "", (text or "").encode()) for lang, source, text in corpus(2, 300)]
    found = []
    for blocks in (1, 7, 60):
        parts = [D.Block(5) for _ in range(blocks)]
        for row in rows:
            r.choice(parts).add(*row)
        names = ["shard", "lang", "terms", "docs", "ends", "sources", "counts", "names"]
        runs = sorted((dict(zip(names, run)) for b in parts for run in b.runs()), key=lambda x: (x["shard"], x["lang"]))
        merged = []
        for (_, lang), own in groupby(runs, key=lambda x: (x["shard"], x["lang"])):
            some = list(D.merged(list(own), 3))
            assert [t for t, *_ in some] == sorted((t for t, *_ in some), key=str.encode)
            merged += [(lang, t, n, tuple(s), tuple(c)) for t, n, s, c in some]
        found.append(sorted(merged))
    assert found[0] == found[1] == found[2] and len(found[0]) > 30


def test_long_texts_are_read_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 50)
    text = " ".join(random.Random(4).choices(["one", "Two", "é" * 80, "x9y"], k=500))
    assert [w.decode() for piece in D._pieces(text.encode()) for w in piece] == terms(text)
