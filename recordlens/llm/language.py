"""Language identification by cross-parsing.

For every language a suffix automaton is built from a bounded sample of labelled text. A
text is parsed against each automaton into longest matches: a phrase goes on while the
automaton can follow it, and the next one starts where it cannot. Text of a language needs
few phrases against its own sample. The phrases after the first are normalised by the bits
that point into the sample and by the length, and the language that needs least wins.

The automata are tables of transitions, so a task parses many stretches of text in step.
Texts are parsed whole, in stretches of ``STRETCH`` letters; the first phrase of a
stretch is free.

``LETTERS_PER_LANGUAGE``, ``ROWS_PER_LANGUAGE`` distinct texts and the first
``LETTERS_PER_ROW`` characters of each bound the sample, all its letters count, ``MOST_LANGUAGES`` the number of
languages; beyond that ``learn`` raises. Labels, ids and sources are never read
when predicting.

Defined results: null texts and texts without a letter are ``und`` with score 0; with
nothing to learn from all texts are; rows repeating an id stay rows of their own; of equal
languages the first by name wins; further columns are ignored by ``identify`` and carried
by ``keep_identified``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.memory import slices
from recordlens.llm.token_ids import utf8

LETTERS_PER_LANGUAGE = 40_000
ROWS_PER_LANGUAGE = 24
LETTERS_PER_ROW = 4_000
MOST_LANGUAGES = 200
#: Transitions are a dense table for a language of at most so many letters, while all dense
#: tables take at most so many bytes; else sorted pairs of state and letter.
DENSE_LETTERS = 250
DENSE_BYTES = 128 << 20
STRETCH = 512
BATCH_LETTERS = 2_000_000

UNKNOWN = "und"

_CLASSES: list[np.ndarray] = []


def _letter_class() -> np.ndarray:
    """Per code point: 1 for letters."""
    if not _CLASSES:
        _CLASSES.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.uint8, 0x110000))
    return _CLASSES[0]


def automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the empty string."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for symbol in symbols:
        state = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in nexts[at]:
            nexts[at][symbol] = state
            at = link[at]
        if at != -1:
            old = nexts[at][symbol]
            if length[at] + 1 == length[old]:
                link[state] = old
            else:
                copy = len(nexts)
                nexts.append(dict(nexts[old]))
                length.append(length[at] + 1)
                link.append(link[old])
                while at != -1 and nexts[at].get(symbol) == old:
                    nexts[at][symbol] = copy
                    at = link[at]
                link[old] = link[state] = copy
        last = state
    return nexts


def suffix_automaton(symbols: list[int], width: int) -> np.ndarray:
    """The automaton as a table by state and symbol; -1 where there is no transition."""
    nexts = automaton(symbols)
    table = np.full((len(nexts), width), -1, np.int32)
    for state, row in enumerate(nexts):
        if row:
            table[state, list(row)] = list(row.values())
    return table


class Transitions:
    """The automaton of one language over its own letters.

    ``own``: its symbol of each symbol of the whole alphabet, the last one for letters that
    its sample does not have and that it therefore cannot follow."""

    def __init__(self, sample: np.ndarray, width: int, room: int):
        letters = np.unique(sample)
        self.width = len(letters) + 1
        self.own = np.full(width, len(letters), np.int32)
        self.own[letters] = np.arange(len(letters))
        symbols = self.own[sample].tolist()
        self.table = self.keys = self.targets = None
        if self.width <= DENSE_LETTERS + 2 and 8 * len(symbols) * self.width <= room:
            self.table = suffix_automaton(symbols, self.width).reshape(-1)
            return
        rows = automaton(symbols)
        pairs = sorted((state * self.width + c, to) for state, row in enumerate(rows) for c, to in row.items())
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.targets = np.array([t for _, t in pairs], np.int32)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.table, self.keys, self.targets) if a is not None)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next state of each, -1 where there is none."""
        if self.table is not None:
            return self.table.take(state * np.int32(self.width) + symbol)
        if not len(self.keys):
            return np.full(len(symbol), -1, np.int32)
        wanted = state.astype(np.int64) * self.width + symbol
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.targets[at], np.int32(-1))


class LanguageModel:
    """Automata of several languages over one alphabet of all sampled letters: 0 is a gap between
    words, the last symbol any letter that no sample has, which no automaton can follow."""

    def __init__(self, samples: dict[str, list[str]]):
        letters = {c for texts in samples.values() for text in texts for c in text.lower() if c.isalpha()}
        self.alphabet = sorted(letters)
        self.width = len(self.alphabet) + 2
        self.languages = sorted(samples)
        self.tables: list[Transitions] = []
        self.bits: list[float] = []
        symbol, room = self._symbol_of(), DENSE_BYTES
        for language in self.languages:
            sample = self._symbols(symbol, " ".join(samples[language]))[:LETTERS_PER_LANGUAGE]
            self.tables.append(Transitions(sample, self.width, room))
            room -= self.tables[-1].nbytes
            self.bits.append(float(np.log2(max(2, len(sample)))))
        self.symbol = None

    def _symbol_of(self) -> np.ndarray:
        kind = np.uint8 if self.width <= 256 else np.int32
        symbol = np.where(_letter_class() == 1, self.width - 1, 0).astype(kind)
        for n, c in enumerate(self.alphabet):
            symbol[ord(c)] = n + 1
        return symbol

    @staticmethod
    def _symbols(symbol: np.ndarray, text: str) -> np.ndarray:
        """Symbols of a text, each run of gaps as one."""
        found = symbol[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        return found[np.concatenate([[True], (found[1:] != 0) | (found[:-1] != 0)])] if len(found) else found

    def costs(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Bits per symbol by text and language, and whether a text has a letter."""
        if self.symbol is None:
            self.symbol = self._symbol_of()
        found = [self._symbols(self.symbol, t.decode()) for t in texts]
        lettered = np.array([bool(f.any()) for f in found], bool)
        sizes = np.array([len(f) for f in found], np.int64)
        pieces = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(len(texts)), pieces)
        grid = np.zeros((len(owner), STRETCH), self.symbol.dtype)
        lengths = np.full(len(owner), STRETCH, np.int64)
        ends = np.cumsum(pieces)
        for k, symbols in enumerate(found):
            if pieces[k]:
                rows = grid[ends[k] - pieces[k] : ends[k]].reshape(-1)
                rows[: len(symbols)] = symbols
                lengths[ends[k] - 1] = len(symbols) - STRETCH * (pieces[k] - 1)
        order = np.argsort(-lengths, kind="stable")
        columns = np.ascontiguousarray(grid[order].T)
        # How many stretches are still going at each position.
        going = np.searchsorted(-lengths[order], -np.arange(STRETCH), "left")
        bits = np.zeros((len(texts), len(self.languages)))
        for n, table in enumerate(self.tables):
            phrases = _parse(table, columns, going)
            bits[:, n] = np.bincount(owner[order], phrases, len(texts)) * self.bits[n]
        return bits / np.maximum(sizes, 1)[:, None], lettered

    def predict(self, texts: list[bytes]) -> tuple[list[str], list[float], list[float]]:
        """Language, score (how clearly it wins, 0 to 1) and bits per symbol of each text."""
        names, scores, least = [], [], []
        for some in _batches(texts):
            costs, lettered = self.costs(some)
            for cost, has_letter in zip(costs, lettered):
                if not has_letter or not self.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    least.append(0.0)
                    continue
                best = int(np.argmin(cost))
                names.append(self.languages[best])
                weight = 1 / (cost + 0.1)
                scores.append(float(weight[best] / weight.sum()))
                least.append(float(cost[best]))
        return names, scores, least


def _batches(texts: list[bytes]) -> Iterator[list[bytes]]:
    some, held = [], 0
    for text in texts:
        some.append(text)
        held += len(text)
        if held >= BATCH_LETTERS:
            yield some
            some, held = [], 0
    if some:
        yield some


def _parse(table: Transitions, columns: np.ndarray, going: np.ndarray) -> np.ndarray:
    """Phrases of each stretch, all stretches one symbol at a time."""
    state = np.zeros(columns.shape[1], np.int32)
    phrases = np.zeros(columns.shape[1], np.int64)
    for position, n in enumerate(going.tolist()):
        if not n:
            break
        symbol = table.own[columns[position, :n]]
        at = table.follow(state[:n], symbol)
        stuck = np.flatnonzero(at < 0)
        if len(stuck):
            # A phrase ends here unless none has begun; the next starts with this symbol.
            phrases[stuck] += state[stuck] > 0
            again = table.follow(np.zeros(len(stuck), np.int32), symbol[stuck])
            phrases[stuck] += again < 0
            at[stuck] = np.maximum(again, 0)
        state[:n] = at
    return phrases


def learn(docs: DataFrame, text: str = "text", label: str = "lang", order: Column | None = None) -> LanguageModel:
    """A model from ``docs``, whose rows are those that may be learned from. Of each
    language the distinct texts first by ``order`` (a hash of the text by default) are
    sampled; of equal texts, and of texts that start alike, the first by ``order`` counts."""
    rows = docs.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(
        F.col(label).cast("string").alias("label"),
        (F.xxhash64(text) if order is None else order).alias("order"),
        F.substring(text, 1, LETTERS_PER_ROW).alias("text"),
    )
    rows = rows.withColumn("key", F.xxhash64("text"))
    distinct = rows.groupBy("label", "key").agg(F.min("order").alias("order"))
    first = Window.partitionBy("label").orderBy("order", "key")
    chosen = distinct.withColumn("k", F.row_number().over(first)).where(F.col("k") <= ROWS_PER_LANGUAGE)
    chosen = chosen.drop("order").orderBy("label", "k").limit(MOST_LANGUAGES * ROWS_PER_LANGUAGE + 1)
    # Only the chosen texts move, one of each.
    sample = rows.join(F.broadcast(chosen), ["label", "key"]).groupBy("label", "k").agg(F.min("text").alias("text"))
    samples: dict[str, list[str]] = {}
    for row in sample.orderBy("label", "k").collect():
        samples.setdefault(row["label"], []).append(row["text"])
    if len(samples) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages to learn")
    return LanguageModel(samples)


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``lang_pred``, ``score`` and ``bits_per_letter``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            names, scores, least = shared.value.predict(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(least, pa.float64())],
                [id_col, "lang_pred", "score", "bits_per_letter"],
            )

    kind = f"`{id_col}` {rows.dtypes[0][1]}, lang_pred string, score double, bits_per_letter double"
    return rows.mapInArrow(run, kind)


def keep_identified(
    docs: DataFrame, model: LanguageModel, text: str = "text", most_bits: float | None = None
) -> DataFrame:
    """The rows of ``docs`` written in one of the languages, with all their columns: those
    that are not ``und`` and, if ``most_bits`` is given, need no more bits per letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            names, _, least = shared.value.predict(utf8(batch.column(at)))
            keep = [n != UNKNOWN and (most_bits is None or b <= most_bits) for n, b in zip(names, least)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
