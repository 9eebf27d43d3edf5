"""Word-piece counts by a linear longest-match automaton.

A word is cut greedily: its longest leading piece from the initial pieces, then repeatedly
the longest from the continuing pieces; a word that cannot be cut so is one unknown piece.
The automaton is a trie of both kinds with failure links. Leaving a node by its link says
how many pieces that pops, so a word's count comes from one walk over its bytes and no
piece is ever built.

Defined results: a null text has no words; further columns are ignored; rows repeating an
id stay rows of their own.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlens.llm.token_ids import utf8

REMEMBERED = 700_000
_UNKNOWN = 1 << 40
_LOADED: dict[str, WordPieces] = {}


class WordPieces(dict):
    """Piece counts by word, worked out when first asked for."""

    def __init__(self, initial: Iterable[bytes], continuing: Iterable[bytes]):
        # Node 0 starts a word, node 1 is inside one.
        self.child: list[dict[int, int]] = [{}, {}]
        self.link, self.pops = [-1, -1], [0, 0]
        ends: set[int] = set()
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                node = root
                for byte in piece:
                    if byte not in self.child[node]:
                        self.child[node][byte] = len(self.child)
                        self.child.append({})
                    node = self.child[node][byte]
                if piece:
                    ends.add(node)
        self.link += [-1] * (len(self.child) - 2)
        self.pops += [0] * (len(self.child) - 2)
        level = [0, 1]
        while level:
            deeper = []
            for parent in level:
                for byte, node in self.child[parent].items():
                    deeper.append(node)
                    if node in ends:
                        self.link[node], self.pops[node] = 1, 1
                        continue
                    back, popped = self.link[parent], self.pops[parent]
                    while back >= 0 and byte not in self.child[back]:
                        popped += self.pops[back]
                        back = self.link[back]
                    if back >= 0:
                        self.link[node], self.pops[node] = self.child[back][byte], popped
            level = deeper

    def count(self, word: bytes) -> int | None:
        """Pieces of ``word``; None if it cannot be cut."""
        child, link, pops = self.child, self.link, self.pops
        node, popped = 0, 0
        for byte in word:
            while byte not in child[node]:
                if link[node] < 0:
                    return None
                popped += pops[node]
                node = link[node]
            node = child[node][byte]
        while node != 1:
            if link[node] < 0:
                return None
            popped += pops[node]
            node = link[node]
        return popped

    def __missing__(self, word: bytes) -> int:
        found = self.count(word)
        self[word] = 1 + _UNKNOWN if found is None else found
        return self[word]

    def totals(self, text: bytes) -> tuple[int, int, int]:
        """Words, pieces and unknown words of a text."""
        if len(self) > REMEMBERED:
            self.clear()
        words = text.split()
        unknown, pieces = divmod(sum(map(self.__getitem__, words)), _UNKNOWN)
        return len(words), pieces, unknown


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is
    printable, else one of the letters from U+0100 on, in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


def byte_level_pieces(path: str) -> tuple[list[bytes], list[bytes]]:
    """The pieces of a byte-level vocabulary file: those that start with a space, without it,
    begin words; the others continue them."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    letters = _byte_letters()
    pieces = [bytes(letters[c] for c in p) for p in vocab if all(c in letters for c in p)]
    return [p[1:] for p in pieces if p[:1] == b" "], [p for p in pieces if p[:1] != b" "]


def word_pieces(path: str) -> WordPieces:
    """One automaton per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordPieces(*byte_level_pieces(path))
    return _LOADED[path]


def count_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_words``, ``n_pieces`` and ``n_unknown`` words."""
    rows = docs.select(F.col(id_col), F.col(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = word_pieces(vocabulary)
        for batch in batches:
            counts = [automaton.totals(t) for t in utf8(batch.column(1))]
            columns = [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, "n_words", "n_pieces", "n_unknown"])

    kind = f"`{id_col}` {rows.dtypes[0][1]}, n_words long, n_pieces long, n_unknown long"
    return rows.mapInArrow(run, kind)
