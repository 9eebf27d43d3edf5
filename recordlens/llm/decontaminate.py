"""Finding passages of a benchmark in documents by Wu-Manber search over words.

Words are runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased. The
windows of the benchmark items are patterns; those of one length share a table. A block is
two neighbouring words: the shift table says how far the search may move when a block ends
at its position, which for most text is a whole window less one word. Where the shift is
zero, the bucket of the block, split by the window's first block, gives the patterns to
test, and the words themselves are compared.

The benchmark is taken in parts of at most ``PART_WORDS`` words, each sent to the tasks on
its own, so what a task holds never grows with the benchmark.

Defined results: null or wordless texts have no words and are not hit; items without words
are passed over; an item id that repeats counts once, a null one is written as an empty
string; rows repeating a doc id stay rows of their own; further columns are ignored by
``find_passages`` and carried by ``drop_contaminated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.memory import slices
from recordlens.llm.store import stored
from recordlens.llm.token_ids import utf8

PART_WORDS = 200_000

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TO_WORDS = bytes(
    c if c >= 0x80 or c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)

Part = list[tuple[str, list[bytes]]]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


class WordSearch:
    """Wu-Manber tables for patterns of one length."""

    def __init__(self, length: int):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, dict[tuple, set[str]]]] = {}

    def add(self, pattern: tuple, item: str) -> None:
        b, m = self.block, self.length
        first, last = pattern[:b], pattern[m - b :]
        tests = self.buckets.setdefault(last, {}).setdefault(first, {})
        if pattern not in tests:
            tests[pattern] = set()
            for end in range(b, m + 1):
                block = pattern[end - b : end]
                self.shift[block] = min(self.shift.get(block, self.far), m - end)
        tests[pattern].add(item)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """Where a pattern starts, and the items that have it."""
        m, b, far, n = self.length, self.block, self.far, len(words)
        shift = self.shift.get
        end = m
        while end <= n:
            block = (words[end - 2], words[end - 1]) if b == 2 else (words[end - 1],)
            move = shift(block, far)
            if move:
                end += move
                continue
            start = end - m
            for pattern, items in self.buckets[block].get(tuple(words[start : start + b]), {}).items():
                if words[start:end] == list(pattern):
                    yield start, items
            end += 1


class Passages:
    """The windows of one part of a benchmark."""

    def __init__(self, part: Part, window: int):
        self.searches: dict[int, WordSearch] = {}
        for item, words in part:
            m = min(window, len(words))
            search = self.searches.setdefault(m, WordSearch(m))
            for start in range(len(words) - m + 1):
                search.add(tuple(words[start : start + m]), item)

    def occur_in(self, words: list[bytes]) -> bool:
        return any(True for s in self.searches.values() for _ in s.search(words))

    def find(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Spans of hit words, and the items found."""
        spans, found = [], set()
        for m, search in self.searches.items():
            for start, items in search.search(words):
                spans.append([start, start + m])
                found |= items
        return merged(spans), found


def merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def benchmark_parts(benchmark: DataFrame, window: int, item: str, text: str) -> Iterator[Part]:
    """The benchmark in bounded parts, fetched one partition at a time. A longer item is cut
    into stretches that overlap by a window less one word, so each window is in one part."""
    part: Part = []
    held = 0
    for row in benchmark.select(F.col(item).cast("string"), F.col(text)).toLocalIterator():
        words = words_of((row[1] or "").encode())
        for start in range(0, max(1, len(words) - window + 1), PART_WORDS):
            stretch = words[start : start + PART_WORDS + window - 1]
            if not stretch:
                continue
            part.append((row[0] or "", stretch))
            held += len(stretch)
            if held >= PART_WORDS:
                yield part
                part, held = [], 0
    if part:
        yield part


def find_passages(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id",
    text: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row per document: id, ``n_words``, ``spans`` of hit words and ``items`` found."""
    sc = docs.sparkSession.sparkContext
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(text).alias("text"),
        F.expr("CAST(array() AS array<array<int>>)").alias("spans"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    kind = f"id {dict(rows.dtypes)['id']}, text string, n_words long, spans array<array<int>>, items array<string>"

    def scan(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = Passages(part.value, window)
            for batch in slices(batches, 1):
                for first in range(0, batch.num_rows, 512):
                    some = batch.slice(first, 512)
                    n_words, spans, items = [], [], []
                    was = some.column("spans").to_pylist(), some.column("items").to_pylist()
                    for content, old_spans, old_items in zip(utf8(some.column("text")), *was):
                        words = words_of(content)
                        found, names = tables.find(words)
                        n_words.append(len(words))
                        spans.append(merged(old_spans + found) if old_spans else found)
                        items.append(sorted(names.union(old_items)))
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id"), some.column("text"), pa.array(n_words, pa.int64()),
                         pa.array(spans, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))],
                        ["id", "text", "n_words", "spans", "items"],
                    )

        return run

    parts = benchmark_parts(benchmark, window, item_col, item_text)
    found = rows.mapInArrow(scan(sc.broadcast(next(parts, []))), kind)
    for part in parts:
        found = stored(found, "passages").drop("n_words").mapInArrow(scan(sc.broadcast(part)), kind)
    return found.select(F.col("id").alias(id_col), "n_words", "spans", "items")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, text: str = "text",
    item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with no word inside a benchmark window, with all their columns."""
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index(text)

    def keep(part):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = Passages(part.value, window)
            for batch in slices(batches, at):
                clean = [not tables.occur_in(words_of(t)) for t in utf8(batch.column(at))]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    parts = benchmark_parts(benchmark, window, item_col, item_text)
    found = docs.mapInArrow(keep(sc.broadcast(next(parts, []))), docs.schema)
    for part in parts:
        # Written between, so that a task holds the tables of one part at a time.
        found = stored(found, "decontaminated").mapInArrow(keep(sc.broadcast(part)), docs.schema)
    return found
