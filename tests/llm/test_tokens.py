import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import AWKWARD, corpus
from recordlens.llm import grammar
from recordlens.llm import packing as P
from recordlens.llm import token_ids as token_ids_module
from recordlens.llm import token_files as T
from recordlens.llm import warc as W
from recordlens.llm.grammar import Shard, compress
from recordlens.llm.token_ids import token_ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def plain(word_bpe):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(word_bpe)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aAbzéÉßÀ÷ \t\n ́.,'!s<|>_12Σςİﬁ\x1c\x85漢"), max_size=40))
def test_ids_equal_the_library(word_bpe, plain, text):
    assert token_ids(word_bpe).encode([text.encode()])[0].tolist() == plain(text)


def test_other_vocabularies_are_encoded_whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Some  Text, with\nspaces"
    assert token_ids(path).encode([text.encode()])[0].tolist() == Tokenizer.from_file(path).encode(text).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=60), max_size=8), st.integers(2, 12))
def test_grammars_round_trip(documents, least):
    ids = [np.array([*d, 2], np.uint32) for d in documents]
    shard = Shard.from_bytes(compress(list(range(len(ids))), ids, 2, 7, least=least, rounds=8).to_bytes())
    assert [d.tolist() for d in shard.documents()] == [d.tolist() for d in ids]
    assert [shard.document(k).tolist() for k in range(len(ids))] == [d.tolist() for d in ids]


def test_grammars_end_when_no_pair_is_frequent():
    r = np.random.default_rng(5)
    ids = [np.append(r.integers(3, 60, 20).astype(np.uint32), np.uint32(2)) for _ in range(400)]
    ids += [np.append(np.arange(100, 1100, dtype=np.uint32), np.uint32(2))] * 40
    shard = compress(list(range(len(ids))), ids, 2, 2000)
    assert all(np.array_equal(a, b) for a, b in zip(shard.documents(), ids))
    assert shard.lengths.max() > 16
    pairs = Counter()
    for part in np.split(shard.symbols, np.cumsum(shard.n_symbols)[:-1]):
        last = None
        for at, pair in enumerate(zip(part.tolist(), part[1:].tolist())):
            if pair[0] == pair[1] and last == (at - 1, pair):
                last = None
                continue
            last = at, pair
            pairs[pair] += pair[0] != 2
    assert max(pairs.values()) < 12


def test_grammars_compress_and_wide_ids():
    ids = np.tile(np.array([70_000, 5, 9, 70_001, 5], np.uint32), 4000)
    shard = compress([1], [np.append(ids, np.uint32(2))], 2, 80_000)
    assert len(shard.to_bytes()) < len(ids) and shard.document(0)[:-1].tolist() == ids.tolist()


def test_grammars_count_again_only_beside_replaced_places(monkeypatch):
    counted = []
    buckets = grammar._Pairs._buckets
    monkeypatch.setattr(grammar._Pairs, "_buckets", lambda self, left, right: (counted.append(len(left)), buckets(self, left, right))[1])
    r = np.random.default_rng(3)
    words = r.integers(3, 9_000, (3_000, 2)).astype(np.uint32)
    ids = [np.append(words[(3_000 * r.random(50_000) ** 3).astype(int)].ravel(), np.uint32(2))]
    shard = compress([1], ids, 2, 9_000)
    assert np.array_equal(shard.document(0), ids[0])
    assert len(counted) > 3 and sum(counted) < 2 * len(ids[0])


def test_rare_pairs_that_share_a_bucket_are_looked_at_once(monkeypatch):
    looked = []
    at = grammar._Pairs._at
    monkeypatch.setattr(grammar._Pairs, "_at", lambda self, places: (looked.append(set(self.symbols[places].tolist())), at(self, places))[1])
    left, right = np.random.default_rng(6).integers(1000, 30_000, (2, 4_000_000)).astype(np.uint32)
    bucket = grammar._Pairs(np.array([2], np.uint32), np.zeros(30_000, bool))._buckets(left, right)
    rare = np.flatnonzero(bucket == np.bincount(bucket).argmax())
    assert len(rare) >= 12
    ids = np.concatenate(
        [[left[k], right[k], 30_000 + n] for n, k in enumerate(rare)] + [[7, 8, 9, 10, 40_000 + n] for n in range(20)] + [[2]]
    ).astype(np.uint32)
    shard = compress([1], [ids], 2, 50_000)
    assert np.array_equal(shard.document(0), ids)
    seen = [len(places & set(left[rare].tolist())) for places in looked]
    assert len(shard.rules) == 3 and len(seen) > 2 and seen[0] > 0 and not any(seen[1:])


def test_words_before_punctuation_are_tokenized_once(word_bpe, plain, monkeypatch):
    seen = []
    word = token_ids_module._Stretches._word
    monkeypatch.setattr(token_ids_module._Stretches, "_word", lambda self, x: (seen.append(x), word(self, x))[1])
    text = "Zebraxolotl zebraxolotl... zebraxolotl!! zebraxolotl, çüzebrax çüzebrax?!"
    assert token_ids_module.TokenIds(word_bpe).encode([text.encode()])[0].tolist() == plain(text)
    assert len(seen) == 2


def test_frequent_words_stay_and_memory_is_bounded(word_bpe, plain, monkeypatch):
    asked = []
    missing = token_ids_module._Stretches.__missing__
    monkeypatch.setattr(token_ids_module._Stretches, "__missing__", lambda self, x: (asked.append(x), missing(self, x))[1])
    monkeypatch.setattr(token_ids_module, "REMEMBERED", 20)
    encoder = token_ids_module.TokenIds(word_bpe)
    for k in range(30):
        text = f"the of and {chr(97 + k % 26)}rare{chr(97 + k // 26)} " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + j)}" for j in range(9))
        assert encoder.encode([text.encode()])[0].tolist() == plain(text)
        assert len(encoder.seen) <= 10 and len(encoder.seen.later) <= 24
    assert asked.count(b"the") == asked.count(b"of") == 1
    for k in range(400):
        encoder.encode([" ".join(f"x{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(9)).encode()])
    assert b"the" not in encoder.seen


@pytest.mark.parametrize("shard_ids", [1_000_000, 700])
def test_files_round_trip(spark, documents, plain, word_bpe, monkeypatch, shard_ids):
    monkeypatch.setattr(T, "SHARD_IDS", shard_ids)
    texts = corpus(30, 1)
    keys = list(range(len(texts), 0, -1))
    files = T.write_ids(documents(texts, keys), word_bpe, 2)
    got = sorted(map(tuple, T.read_ids(files).collect()))
    want, start = [], 0
    for key, text in sorted(zip(keys, texts)):
        ids = [*plain(text), 2]
        want.append((key, start, len(ids), crc(ids)))
        start += len(ids)
    assert got == want
    again = {r["doc_id"]: r["ids"] for r in T.read_ids(files, with_ids=True).collect()}
    assert again[keys[0]] == [*plain(texts[0]), 2]


def test_files_with_null_and_repeated_ids(spark, documents, plain, word_bpe):
    got = T.read_ids(T.write_ids(documents(["b", "a", "c", None], [1, 1, None, 0]), word_bpe, 2))
    assert [(r["doc_id"], r["start"]) for r in got.orderBy("start").collect()] == [(None, 0), (0, 2), (1, 3), (1, 5)]
    assert T.read_ids(T.write_ids(documents(["a"]).limit(0), word_bpe, 2)).count() == 0


def check_packing(rows, size):
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in placed.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(placed)


@pytest.mark.parametrize("size", [16, 300, 4096])
def test_packing(spark, documents, plain, word_bpe, size):
    texts = corpus(40, 2)
    keys = [None, *range(1, len(texts) - 1), 1]
    rows = P.pack(documents(texts, keys), word_bpe, 1, size, with_ids=True).collect()
    want = []
    for key, text in zip(keys, texts):
        ids = [*plain(text), 1]
        want += [(key, n, a, ids[a : a + size]) for n, a in enumerate(range(0, len(ids), size))]
    got = [(r["doc_id"], r["piece"], r["start"], r["ids"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert all(r["length"] == len(r["ids"]) and r["ids_crc32"] == crc(r["ids"]) for r in rows)
    used, total = check_packing(rows, size), sum(r["length"] for r in rows)
    assert used <= -(-total // size) * 1.02 + 1


def test_packing_nothing(spark, documents, word_bpe):
    assert P.pack(documents(["a"]).limit(0), word_bpe, 1).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 10**9), max_size=30))
def test_plans_use_every_length_exactly(histogram):
    totals = np.zeros(65, np.int64)
    for length, n in histogram.items():
        totals[length] = n
    used = np.zeros(65, np.int64)
    plan = P.pattern_plan(totals)
    for times, lengths in plan:
        assert times > 0 and sum(lengths) <= 64
        np.add.at(used, lengths, times)
    assert (used == totals).all() and len(plan) < 2000


def test_least_squares_fit_finds_an_exact_mix():
    totals = np.zeros(11, np.int64)
    totals[[3, 7, 5]] = [100, 100, 40]
    assert P._fit([[7, 3], [5, 5]], totals).round(3).tolist() == [100, 20]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)


def test_archives(spark):
    long = "<p>é" + "x" * 200
    rows = [(k, f"http://a/{k}", long if k % 3 else f"own {k}" * 30) for k in range(60)]
    rows += [(100 + k, None, "short") for k in range(5)] + [(200, "u\nv", None), (201, "u", ""), (None, "n", long), (7, "again", long)]
    index = W.write_archives(pages(spark, rows))
    got = W.read_records(index, with_payload=True).collect()
    assert len(got) == len(rows)
    of = {}
    for page_id, _, html in rows:
        of.setdefault(page_id, []).append((html or "").encode())
    for r in got:
        assert any(len(p) == r["payload_bytes"] and W.hashlib.sha256(p).hexdigest() == r["payload_digest"] for p in of[r["page_id"]])
    revisits = [r for r in got if r["record_type"] == "revisit"]
    assert {r["refers_to"] for r in revisits} == {1}
    assert len(revisits) == sum(h == long for *_, h in rows) - 1
    assert all(r["refers_to"] is None for r in got if r["record_type"] == "response")
    assert all(bytes(r["payload"]).decode() == long for r in got if r["page_id"] == 1)
    some = W.read_records(index.where("page_id IN (3, 6, 200)")).collect()
    assert sorted(r["page_id"] for r in some) == [3, 6, 200]


def test_archive_files_are_gzip_members(spark):
    import gzip

    index = W.write_archives(pages(spark, [(1, "http://a/", "y" * 150), (2, "http://b/", "y" * 150)])).collect()
    for row in index:
        store, path = W.open_store(row["file"])
        with store.open_input_file(path) as f:
            text = gzip.decompress(f.read_at(row["length"], row["offset"])).decode()
        assert text.startswith("WARC/1.1\r\nWARC-Type: " + row["record_type"]) and text.endswith("\r\n\r\n")
        assert f"WARC-Payload-Digest: sha256:{row['payload_digest']}" in text


def test_reads_are_coalesced():
    ranges = [("a", 0, 10), ("a", 10, 10), ("a", 200_000, 10), ("b", 0, 5), ("b", 5, W.READ_BYTES)]
    assert [len(x) for x in W._coalesced(ranges)] == [2, 1, 1, 1]


def test_no_pages(spark):
    assert W.read_records(W.write_archives(pages(spark, [(1, "u", "h")]).limit(0))).count() == 0


def test_awkward_texts(spark, documents, word_bpe):
    assert P.pack(documents(AWKWARD), word_bpe, 1).select("doc_id").distinct().count() == len(AWKWARD)
    assert T.read_ids(T.write_ids(documents(AWKWARD), word_bpe, 2)).count() == len(AWKWARD)
