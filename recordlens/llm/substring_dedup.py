"""Removing passages that occur earlier in the corpus, by suffix automata over words.

A window of ``window`` words is removed where its words start earlier, by (id, position).
Sending every reference automaton to every document would cost shards times corpus, so
reference text and documents are brought together by anchors instead: the anchor of a
window is its smallest hash of ``ANCHOR`` consecutive words, so equal windows have equal
anchors wherever they stand. Consecutive windows with one anchor place form a stretch.

1. Anchors are counted; a bit map of fixed size keeps those that may occur twice, and only
   their stretches are cut out of the texts and go on.
2. Equal stretches, by a 128-bit digest of their words, are grouped with map-side combining,
   so a passage in a third of all documents is a few rows per task. All but the first of
   them are removed whole.
3. The first ones are dealt out by anchor: each group is a reference shard, whose suffix
   automaton grows in order of first occurrence. Each stretch is streamed through it for
   matching statistics, and maximal spans of at least ``window`` words are removed.
4. Anchors with more than ``CROWD`` distinct stretches have no automaton. The windows of
   their stretches become rows with a 128-bit digest of their words; the first of each
   digest is found with map-side combining, and all others are removed.

A task of step 3 holds the automaton of one anchor at a time, of at most ``CROWD`` stretches
of ``2 * window`` words; a task of step 4 holds nothing. A bit map decides between the two,
so some smaller anchors take step 4 too; both give the same result.

Defined results: null and short texts lose nothing; a null id sorts before all others; rows
that repeat an id and a text are one occurrence and get equal results; rows that repeat
only the id are ordered by a hash of the text; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.marks import marked, marks, sent, with_mark
from recordlens.llm.memory import parts
from recordlens.llm.store import stored
from recordlens.llm.token_ids import utf8
from recordlens.llm.word_hashes import run_hashes, word_hashes

WINDOW = 20
ANCHOR = 8
CROWD = 2048


#: Text whose words are hashed at once; a longer text stands alone.
PART_BYTES = 1 << 20


def stretches(
    hashes: np.ndarray, lengths: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, document, first window (a place in ``hashes``) and number of windows of each
    stretch of documents of ``lengths`` words, laid end to end in ``hashes``."""
    anchor = min(ANCHOR, window)
    ends = np.cumsum(lengths)
    if len(hashes) < window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none
    best = run_hashes(hashes, anchor)
    place = np.arange(len(best))
    # The leftmost smallest run of ``wide`` places, from two of half as many.
    wide, width = 1, window - anchor + 1
    while wide < width:
        step = min(wide, width - wide)
        less = best[step:] < best[:-step]
        best = np.where(less, best[step:], best[:-step])
        place = np.where(less, place[step:], place[:-step])
        wide += step
    # Windows end inside their document, so those of two documents have no place in common.
    windows = np.flatnonzero(np.arange(len(best)) + window <= np.repeat(ends, lengths)[: len(best)])
    first = np.flatnonzero(np.diff(place[windows], prepend=-1))
    starts = windows[first]
    return best[starts], np.searchsorted(ends, starts, "right"), starts, np.diff(first, append=len(windows))


def _words(column) -> tuple[list[bytes], np.ndarray]:
    """The words of all texts of ``column``, and how many each has."""
    split = [t.split() for t in utf8(column)]
    return list(itertools.chain.from_iterable(split)), np.fromiter(map(len, split), np.int64, len(split))


class Automaton:
    """A suffix automaton over words that grows by whole texts, kept apart by marks that
    occur once."""

    def __init__(self):
        self.nexts: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        self.last, self.texts = 0, 0

    def matches(self, words: list[bytes], least: int) -> list[list[int]]:
        """Maximal spans of at least ``least`` words that occur in the texts so far."""
        return self.known(words, least)[0]

    def known(self, words: list[bytes], least: int) -> tuple[list[list[int]], int]:
        """The spans of ``matches``, and how many windows of ``least`` words occur. Spans that
        overlap are one, so a text they cover can still have windows that are new."""
        nexts, link, length = self.nexts, self.link, self.length
        spans: list[list[int]] = []
        state = matched = windows = 0
        for at, word in enumerate(words):
            while state and word not in nexts[state]:
                state = link[state]
                matched = length[state]
            if word in nexts[state]:
                state = nexts[state][word]
                matched += 1
            if matched >= least:
                windows += 1
                start = at + 1 - matched
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = at + 1
                else:
                    spans.append([start, at + 1])
        return spans, windows

    def add(self, words: list[bytes]) -> None:
        self.texts += 1
        self._extend(self.texts)
        for word in words:
            self._extend(word)

    def _extend(self, symbol) -> None:
        nexts, link, length = self.nexts, self.link, self.length
        state = len(nexts)
        nexts.append({})
        length.append(length[self.last] + 1)
        link.append(0)
        at = self.last
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
        self.last = state


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``id, tie, spans`` of the documents of ``id, tie, text`` that repeat something."""

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 0):
                found = []
                for part in parts(some, 0, PART_BYTES):
                    words, lengths = _words(part.column(0))
                    found.append(stretches(word_hashes(words), lengths, window)[0])
                keys, counts = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["anchor", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 2, PART_BYTES):
                words, lengths = _words(some.column(2))
                keys, rows, starts, counts = stretches(word_hashes(words), lengths, window)
                often = np.flatnonzero(marked(again.value, keys))
                if not len(often):
                    continue
                keys, rows, starts, counts = keys[often], rows[often], starts[often], counts[often]
                joined = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
                begins = np.concatenate([[0], ends])[starts]
                texts = [joined[a:b] for a, b in zip(begins.tolist(), (ends[starts + counts + window - 2] - 1).tolist())]
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), some.column(1).take(at), pa.array(keys.view(np.int64)),
                     pa.array(starts - (np.cumsum(lengths) - lengths)[rows]), pa.array(counts), pa.array(texts, pa.binary()),
                     pa.array(list(map(xxhash.xxh3_128_digest, texts)), pa.binary())],
                    ["id", "tie", "anchor", "start", "n", "words", "digest"],
                )

    id_kind = dict(docs.dtypes)["id"]
    counted = docs.select("text").mapInArrow(anchors, "anchor long, n long")
    repeated = counted.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    # An anchor is a hash itself, so its own low bits are its slot.
    again = sent(marks(repeated, F.col("anchor")))
    found = docs.select("id", "tie", "text").mapInArrow(
        cut, f"id {id_kind}, tie long, anchor long, start long, n long, words binary, digest binary"
    )
    found = stored(found, "stretches")
    again.unpersist()

    order = F.struct("id", "tie", "start", "n")
    distinct = stored(
        found.groupBy("anchor", "digest")
        .agg(F.min(order).alias("first"), F.count("*").alias("copies"), F.first("words").alias("words")),
        "distinct-stretches",
    )

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, automaton, held = None, None, None
        for batch in batches:
            rows, begins, ends = [], [], []
            columns = batch.column("anchor").to_pylist(), batch.column("start").to_pylist(), batch.column("words").to_pylist()
            for row, (key, start, text) in enumerate(zip(*columns)):
                words = text.split(b" ")
                if key != anchor:
                    anchor, automaton, held = key, None, words
                    continue
                if automaton is None:
                    automaton = Automaton()
                    automaton.add(held)
                spans, seen = automaton.known(words, window)
                for begin, end in spans:
                    rows.append(row)
                    begins.append(start + begin)
                    ends.append(start + end)
                if seen < len(words) - window + 1:
                    automaton.add(words)
            if rows:
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(at), batch.column("tie").take(at), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                    ["id", "tie", "begin", "end"],
                )

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                some = batch.slice(first, 1024)
                rows, begins, digests = [], [], []
                for row, (start, text) in enumerate(zip(some.column(2).to_pylist(), some.column(3).to_pylist())):
                    words = text.split(b" ")
                    for k in range(len(words) - window + 1):
                        rows.append(row)
                        begins.append(start + k)
                        digests.append(xxhash.xxh3_128_digest(b" ".join(words[k : k + window])))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(at), some.column(1).take(at), pa.array(begins, pa.int64()), pa.array(digests, pa.binary())],
                    ["id", "tie", "begin", "digest"],
                )

    texts = stored(distinct.groupBy("anchor").agg(F.count("*").alias("texts")).where("texts > 1"), "anchors")
    crowded = marks(texts.where(F.col("texts") > CROWD), F.xxhash64("anchor"))
    flat = distinct.select("anchor", "first.id", "first.tie", "first.start", "words")
    flat = with_mark(flat, crowded, F.xxhash64("anchor"), "crowded")
    shards = (
        flat.where("NOT crowded").drop("crowded").join(texts.select("anchor"), "anchor", "left_semi")
        .repartition("anchor").sortWithinPartitions("anchor", "id", "tie", "start")
    )
    partly = shards.mapInArrow(match, f"id {id_kind}, tie long, begin long, end long")

    place = F.struct("id", "tie", "begin")
    every = flat.where("crowded").select("id", "tie", "start", "words").mapInArrow(
        windows, f"id {id_kind}, tie long, begin long, digest binary"
    )
    earliest = every.groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("copies"))
    earliest = earliest.where("copies > 1").select(F.col("digest").alias("d"), "first")
    later = (
        every.join(earliest, F.col("digest") == F.col("d")).where(~F.col("first").eqNullSafe(place))
        .select("id", "tie", "begin", (F.col("begin") + window).alias("end"))
    )
    partly = partly.unionByName(later)
    copied = distinct.where("copies > 1").select(F.col("digest").alias("d"), "first")
    wholly = (
        found.drop("anchor", "words").join(copied, F.col("digest") == F.col("d"))
        .where(~F.col("first").eqNullSafe(order))
        .select("id", "tie", F.col("start").alias("begin"), (F.col("start") + F.col("n") + window - 1).alias("end"))
    )
    spans = partly.unionByName(wholly)
    return spans.groupBy("id", "tie").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text: str = "text", with_text: bool = False
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_removed``, ``kept_sha256`` of the words kept,
    joined by one space, and that text itself if asked for."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    spans = stored(repeated_spans(rows, window), "repeated-spans")
    kind = f"`{id_col}` {dict(rows.dtypes)['id']}, n_words long, n_removed long, kept_sha256 string" + (
        ", text string" if with_text else ""
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in parts(batch, 1):
                n_words, n_removed, digests, texts = [], [], [], []
                places = some.column(2).flatten()
                begins, ends = places.field("begin").to_pylist(), places.field("end").to_pylist()
                sizes = pc.fill_null(pc.list_value_length(some.column(2)), 0).to_pylist()
                at = 0
                for content, size in zip(utf8(some.column(1)), sizes):
                    words = content.split()
                    n = len(words)
                    if size:
                        keep = bytearray(b"\1") * n
                        for begin, end in zip(begins[at : at + size], ends[at : at + size]):
                            keep[begin:end] = bytes(end - begin)
                        at += size
                        words = list(itertools.compress(words, keep))
                    left = b" ".join(words)
                    n_words.append(n)
                    n_removed.append(n - len(words))
                    digests.append(hashlib.sha256(left).hexdigest())
                    if with_text:
                        texts.append(left.decode())
                columns = [some.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
                names = [id_col, "n_words", "n_removed", "kept_sha256"]
                if with_text:
                    columns.append(pa.array(texts, pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names)

    # Only documents that may have spans are shuffled to meet them.
    rows = with_mark(rows, marks(spans, F.xxhash64("id", "tie")), F.xxhash64("id", "tie"), "marked")
    none = F.lit(None).cast("array<struct<begin:long,end:long>>").alias("spans")
    clean = rows.where("NOT marked").select("id", "text", none)
    other = spans.select(F.col("id").alias("i"), F.col("tie").alias("t"), "spans")
    marked = rows.where("marked").join(
        other, F.col("id").eqNullSafe(F.col("i")) & F.col("tie").eqNullSafe(F.col("t")), "left"
    )
    return clean.unionByName(marked.select("id", "text", "spans")).mapInArrow(remove, kind)
