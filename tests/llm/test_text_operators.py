import random
import re

import numpy as np
import pytest

from conftest import AWKWARD, corpus, lower_ascii, sha
from recordlens.llm import decontaminate as D
from recordlens.llm import html_extract as H
from recordlens.llm import language as L
from recordlens.llm.word_pieces import WordPieces, count_pieces
from pyspark.sql import functions as F


def naive_phrases(sample, text):
    """Phrases after the first, by plain search; an unknown symbol closes its phrase."""
    phrases, at = -1, 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in sample:
            end += 1
        phrases += 1
        at = max(end, at + 1)
    return phrases + (text[-1] not in sample)


def test_cross_parsing_equals_plain_search():
    r = random.Random(1)
    sample = "".join(r.choices("abc ", k=400)).strip()
    model = L.LanguageModel({"x": [sample]})
    symbols = " ".join(sample.split())
    for _ in range(50):
        text = " ".join("".join(r.choices("abcd", k=r.randint(1, 9))) for _ in range(r.randint(1, 30)))
        bits, lettered = model.costs([text.encode()])
        unknown = text.replace("d", "\0")
        assert lettered[0]
        assert bits[0, 0] * len(text) / model.bits[0] == pytest.approx(naive_phrases(symbols, unknown))


def test_long_texts_are_parsed_whole():
    model = L.LanguageModel({"a": ["aaaa bbbb"], "c": ["cccc dddd"]})
    text = "aaaa " * 300 + "cccc " * 2000
    assert model.predict([text.encode()])[0] == ["c"]


def learned(spark, documents):
    r = random.Random(2)
    words = {"en": ["the", "thing", "with", "that"], "de": ["der", "nicht", "schön", "und"], "fr": ["être", "que", "vous", "les"]}
    texts, langs = [], []
    for lang, own in words.items():
        for _ in range(40):
            texts.append(" ".join(r.choices(own, k=30)))
            langs.append(lang)
    return documents(texts, langs=langs), words


def test_languages(spark, documents):
    docs, words = learned(spark, documents)
    model = L.learn(docs)
    assert model.languages == ["de", "en", "fr"]
    texts = [" ".join(w).upper() for w in words.values()] + AWKWARD + ["漢字"]
    got = {r["doc_id"]: r for r in L.identify(documents(texts), model).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == ["en", "de", "fr"]
    for k, text in enumerate(texts):
        lettered = any(c.isalpha() for c in text or "")
        assert (got[k]["lang_pred"] == "und") == (not lettered) and 0 <= got[k]["score"] <= 1
    kept = L.keep_identified(documents(texts), model, most_bits=11.0)
    ids = {r["doc_id"] for r in kept.collect()}
    assert {0, 1, 2} <= ids and len(texts) - 1 not in ids and 3 not in ids
    assert kept.dtypes == documents(texts).dtypes


def test_copies_take_one_place_of_the_sample(spark, documents):
    texts = ["ab ab"] * 40 + [f"{c * 4} {c * 3}" for c in "cdefghijklmnopqrstuvwxyz"]
    model = L.learn(documents(texts, langs=["en"] * len(texts)), order=F.col("n_chars"))
    assert len(model.alphabet) == 2 + L.ROWS_PER_LANGUAGE - 1


def test_nothing_to_learn(spark, documents):
    model = L.learn(documents(["a", None], langs=[None, "en"]))
    assert {r["lang_pred"] for r in L.identify(documents(["abc", None]), model).collect()} == {"und"}
    assert L.identify(documents(["a"]).limit(0), model).count() == 0


def passages(texts, items, window):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower_ascii(t))

    out = []
    for i, text in enumerate(texts):
        own = words(text)
        hit, found = set(), set()
        for item, t in items:
            w = words(t)
            m = min(window, len(w))
            runs = {tuple(w[k : k + m]) for k in range(len(w) - m + 1)} if w else set()
            for k in range(len(own) - m + 1):
                if w and tuple(own[k : k + m]) in runs:
                    hit |= set(range(k, k + m))
                    found.add(item)
        out.append((i, len(own), len(hit), sha(",".join(sorted(str(x) for x in found)))))
    return out


@pytest.mark.parametrize("part_words", [200_000, 12])
def test_passages_equal_brute_force(spark, documents, monkeypatch, part_words):
    monkeypatch.setattr(D, "PART_WORDS", part_words)
    r = random.Random(3)
    items = [(k, " ".join(r.choices("abcdefgh", k=r.choice([1, 2, 4, 11, 30])))) for k in range(12)]
    items += [(20, items[0][1]), (21, None), (22, "!!"), (23, items[5][1]), (23, items[6][1])]
    texts = [" ".join(r.choices("abcdefgh", k=40)) for _ in range(10)]
    texts += [f"Q, {t!s}. z" for _, t in items] + AWKWARD
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_passages(documents(texts), benchmark).collect()
    rows = sorted((x["doc_id"], x["n_words"], sum(b - a for a, b in x["spans"]), sha(",".join(sorted(x["items"])))) for x in got)
    assert rows == passages(texts, items, 10)
    kept = D.drop_contaminated(documents(texts), benchmark)
    assert sorted(x["doc_id"] for x in kept.collect()) == [i for i, _, n, _ in rows if not n]
    assert kept.dtypes == documents(texts).dtypes


def test_no_benchmark(spark, documents):
    benchmark = spark.createDataFrame([(1, None)], "item_id long, text string")
    for none in (benchmark, benchmark.limit(0)):
        assert D.find_passages(documents(AWKWARD), none).filter("size(items) > 0").isEmpty()
        assert D.drop_contaminated(documents(AWKWARD), none).count() == len(AWKWARD)


def greedy(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pieces = continuing if at else initial
        end = max((e for e in range(at + 1, len(word) + 1) if word[at:e] in pieces), default=None)
        if end is None:
            return None
        n, at = n + 1, end
    return n


def test_piece_counts_equal_greedy_matching():
    r = random.Random(4)
    for _ in range(60):
        pieces = [{bytes(r.choices(b"abc", k=r.randint(1, 5))) for _ in range(r.randint(0, 12))} for _ in range(2)]
        automaton = WordPieces(*pieces)
        for _ in range(60):
            word = bytes(r.choices(b"abc", k=r.randint(1, 12)))
            assert automaton.count(word) == greedy(word, *pieces), (word, pieces)


def test_piece_counts_of_documents(spark, documents):
    import public_tokenizers
    from recordlens.llm.word_pieces import byte_level_pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    initial, continuing = map(set, byte_level_pieces(path))
    texts = [t for t in AWKWARD if t is None or len(t) < 1000] + ["Schön être 漢字 unbelievable's"]
    got = {r["doc_id"]: tuple(r)[1:] for r in count_pieces(documents(texts), path).collect()}
    for k, text in enumerate(texts):
        counts = [greedy(w, initial, continuing) for w in (text or "").encode().split()]
        assert got[k] == (len(counts), sum(c or 1 for c in counts), counts.count(None))
    assert count_pieces(documents(["a"]).limit(0), path).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head>
<body><header class="site"><p>Site name</p></header><nav><ul><li><a href="/a">A</a></ul></nav>
<div id="cookie-notice"><p>We use cookies on this site to do things</p></div><div class="ad">Buy</div>
<div class="wrap"><div class="post-%d content"><h1>Head &amp; line</h1><p>One  <b>bold</b><br>two &lt;x&gt;<p>Three, four
five six seven eight nine ten eleven.<ul><li>first<li>second</ul><form><p>mail</p></form></div>
<aside><p>More</p></aside><div class="comments"><p>Nice one, this is a long comment about it</p></div></div>
<!-- <p>hidden</p> --><footer>&copy; me</footer>"""
TEXT = "Head & line\nOne bold two <x>\nThree, four five six seven eight nine ten eleven.\nfirst\nsecond"


def test_pages(spark):
    rows = [(k, f"http://h{k % 2}.example/{k}", PAGE % k, "x") for k in range(6)]
    rows += [(10, None, PAGE % 3, "x"), (11, "http://h0.example/odd", None, None), (12, "not a url", "", "x")]
    rows += [(13, "http://h1.example/other", "<body><p>Only this", "x"), (None, "", "plain <b>text</b> here", None)]
    rows += [(14, "http://h9.example", "<p>a<p hidden>b</p><div style='display: none'>c</div>d &nbsp; e", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r["page_id"]: r for r in H.extract(pages).collect()}
    for k in [*range(6), 10]:
        assert got[k]["text"] == TEXT and got[k]["n_chars"] == len(TEXT)
    assert got[0]["path"].endswith("div.content.post-N")
    assert (got[11]["text"], got[12]["text"], got[13]["text"]) == ("", "", "Only this")
    assert got[None]["text"] == "plain text here" and got[14]["text"] == "a\nd e"
    assert H.extract(pages.limit(0)).count() == 0


def test_broken_markup():
    for source in ("<", "<p", "a<b", "<p>x</p", "<!-- x", "<script>x", '<a href="x>y</a> z', "</div></p>t", "<p>" * 3000 + "deep"):
        assert isinstance(H.main_text(source, None), str)
    assert H.main_text("<p>a &amp b</p>&#233;", None) == "a & b\né"
    page = "<article><header><h1>T</h1></header><section><p>one two three</p></section><section><p>four</p></section></article>"
    assert H.main_text(page, H._best(H.container_scores(page))) == "T\none two three\nfour"


def test_supplied_pages(spark):
    """Every supplied page keeps its article and nothing else."""
    import html as codec

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in H.extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        parts = [" ".join(codec.unescape(re.sub(r"<(br|b|/b)>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in parts if x)
    assert len(got) == rows.count() and np.array(list(got)).size
