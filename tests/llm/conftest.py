"""Small documents with every awkward row, and plain Python versions of the contracts."""

import hashlib
import random
import re

import pytest

# Names that operators use inside, as further columns of the input.
CLASHING = ["id", "key", "node", "label", "tie", "spans", "n", "first", "length", "start", "host", "words"]

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(
    f"`{c}` string" for c in CLASHING
)


def frame(spark, texts, ids=None, langs=None):
    """Documents from texts, with the clashing columns filled by their row."""
    ids = list(range(len(texts))) if ids is None else ids
    langs = [None] * len(texts) if langs is None else langs
    rows = [
        (i, t, lang, None if k % 5 == 0 else f"s{k % 3}", None if t is None else len(t), *[f"{c}{k}" for c in CLASHING])
        for k, (i, t, lang) in enumerate(zip(ids, texts, langs))
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


AWKWARD = [None, "", " ", "\t\n ", "a", "A", "a ", "a  b", "a\tb", "a b c d", "a b c d e", "A b C d E",
           "é ü 12 !!", " ", "x" * 5000, "word " * 30_000, "<|endoftext|> and <|ENDOFTEXT|>", "!!! ??? ..."]


def corpus(n, seed):
    """Random word texts with exact copies, near copies around a base, shared passages."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    base = [r.choices(vocabulary, k=r.randint(1, 120)) for _ in range(n)]
    passage = r.choices(vocabulary, k=45)
    out = []
    for words in base:
        out.append(" ".join(words))
        if r.random() < 0.2:
            out.append(r.choice(["  ", "\n", "\t "]).join(words))
        for _ in range(r.choice([0, 0, 0, 1, 4])):
            changed = list(words)
            for _ in range(r.randint(1, 3)):
                changed[r.randrange(len(changed))] = r.choice(vocabulary).upper()
            out.append(" ".join(changed))
        if r.random() < 0.3:
            at = r.randint(0, len(words))
            out.append(" ".join(words[:at] + passage + words[at:]))
    r.shuffle(out)
    return out + AWKWARD + AWKWARD[:4]


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def ascii_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture
def documents(spark):
    return lambda texts, ids=None, langs=None: frame(spark, texts, ids, langs)


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
