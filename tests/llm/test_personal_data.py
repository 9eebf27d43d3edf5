"""Personal data: base spans against plain patterns, the vote model against plain Python."""

import math
import random
import re

import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F
from recordlens.llm import personal_data as P

SCHEMA = "doc_id long, text string, kind string, start string, base string, candidates string, id string, votes string, n string"

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = [True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True,
                    16 <= len(digits) <= 19 and luhn(digits), 8 <= len(digits) <= 15][kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, *["x"] * 7) for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def found(spark, texts):
    got = P.find_personal_data(frame(spark, texts)).collect()
    return {r["doc_id"]: ([tuple(s) for s in r["base"]], [tuple(s) for s in r["added"]]) for r in got}


def noisy(seed, n):
    r = random.Random(seed)
    parts = ["a.b@c.de", "x@y", "@", "a%b@c.d%e@f.g", "1.2.3.4", "001.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "4111111111111111",
             "4111 1111 1111 1111", "4111-1111-1111-1112", "5500005555555559 4111111111111111", "+1 (234) 555-6789", "+49 30 123456",
             "+1", "++12345678", "+1 (826) 555-4081 190.137.223.204", "é", "𝒳", "ab", "9" * 25, "0" * 16, "-", ".", "..", "a..b@c..d",
             "1700000000000", "a@b.c.", "b@c.d@e.f", "1.2.3", "0x4111111111111111"]
    return ["".join(r.choice(["", " ", " ", "\n"]) + r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_base_spans_equal_plain_patterns(spark):
    texts = noisy(1, 400) + AWKWARD + ["a@" * 5000, "a.b@c.d " * 300]
    got = found(spark, texts)
    assert {k: v[0] for k, v in got.items()} == {k: base(t) for k, t in enumerate(texts)}
    for spans, added in got.values():
        for kind, start, end in added:
            assert not any(s < end and start < e for _, s, e in spans)
            assert sum(s < end and start < e for _, s, e in added) == 1


def test_long_runs_without_a_match_take_one_pass(spark):
    texts = ["a" * 2_000_000, "7" * 1_000_000, "a." * 500_000 + "@", "+" + "1 " * 500_000, "1." * 60_000]
    got = found(spark, texts)
    assert all(spans == [] for k, (spans, _) in got.items() if k in (0, 1, 2, 3))
    assert len(got[4][0]) == 15_000


CLEAN = ["Licensed under version 3.0 of 2007.", "Section 12.4.1 has 1,000,000 rows.", "The year 2024-01-02 10:11:12.",
         'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e"', "look at me. Then at that dot"]


def test_votes_add_what_the_base_misses_and_leave_clean_text(spark):
    r = random.Random(3)
    number = lambda: "".join(r.choice("0123456789") for _ in range(16))
    texts = [f"word word {number()} word" for _ in range(60)] + CLEAN * 8
    at = len(texts)
    texts += ["pay by card 5500005555555550 5500005555555559 now", "mail jane.roe [at] mail.example [dot] com today",
              "host 10[.]20[.]30[.]40 answers", "+1 (826) 555-4081 190.137.223.204"]
    got = found(spark, texts)
    for k in range(60):
        assert sum(map(len, got[k])) == 1
    for k in range(60, at):
        assert got[k] == ([], []), texts[k]
    words = lambda k: sorted(texts[k][s:e] for _, s, e in got[k][0] + got[k][1])
    assert words(at) == ["5500005555555550", "5500005555555559"]
    assert words(at + 1) == ["jane.roe [at] mail.example [dot] com"]
    assert words(at + 2) == ["10[.]20[.]30[.]40"]
    assert words(at + 3) == ["+1 (826) 555-4081", "190.137.223.204"]


def plain_estimate(rows):
    """The same rounds over ``(kind, votes, n)`` in plain Python."""
    share = [P.PRIOR_SHARE] * 4
    rates = {name: [P.PRIOR[name]] * 4 for name in P.LABELERS}
    for _ in range(P.ROUNDS):
        real = []
        for kind, votes, n in rows:
            odds = math.log(share[kind] / (1 - share[kind]))
            for name, v in zip(P.LABELERS, votes):
                a, b = rates[name][kind]
                odds += math.log(a / b) if v == "1" else math.log((1 - a) / (1 - b)) if v == "0" else 0
            real.append(1 / (1 + math.exp(-odds)))
        moved = 0
        for kind in {r[0] for r in rows}:
            own = [(v, n, p) for (k, v, n), p in zip(rows, real) if k == kind]
            new = (sum(n * p for _, n, p in own) + P.PRIOR_SHARE * P.PRIOR_SPANS) / (sum(n for _, n, _ in own) + P.PRIOR_SPANS)
            moved, share[kind] = max(moved, abs(new - share[kind])), new
            for j, name in enumerate(P.LABELERS):
                pair = []
                for i, weigh in enumerate((lambda p: p, lambda p: 1 - p)):
                    yes = sum(n * weigh(p) for v, n, p in own if v[j] == "1")
                    all_of = sum(n * weigh(p) for v, n, p in own if v[j] != "-")
                    pair.append((yes + P.PRIOR[name][i] * P.PRIOR_VOTES) / (all_of + P.PRIOR_VOTES))
                moved = max(moved, *(abs(a - b) for a, b in zip(pair, rates[name][kind])))
                rates[name][kind] = tuple(pair)
        if moved < P.STILL:
            break
    return share, rates


def test_estimate_equals_plain_python(spark):
    r = random.Random(9)
    rows = list({(r.randint(0, 3), "".join(r.choice("10-") for _ in P.LABELERS)): r.randint(1, 90) for _ in range(300)}.items())
    rows = [(k, v, n) for (k, v), n in rows if k != 3]
    share, rates = P.estimate(spark.createDataFrame(rows, "kind int, votes string, n long"))
    want_share, want_rates = plain_estimate(rows)
    assert share == pytest.approx(want_share, abs=1e-9)
    for name in P.LABELERS:
        for a, b in zip(rates[name], want_rates[name]):
            assert a == pytest.approx(b, abs=1e-9)


def test_ids_repeat_and_tables_may_be_empty(spark):
    docs = frame(spark, ["a@b.c", "a@b.c", None, "a@b.c"], [1, 1, None, None])
    got = P.find_personal_data(docs).collect()
    assert sorted(len(r["base"]) for r in got) == [0, 1, 1, 1]
    assert P.find_personal_data(docs.limit(0)).count() == 0


def test_main_path_is_native(spark):
    out = P.find_personal_data(frame(spark, ["a@b.c 4111111111111112"]))
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert out.select(P.written(F.col("base")).alias("w")).first()["w"] == "email:0:5"
