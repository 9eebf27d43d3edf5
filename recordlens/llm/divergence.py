"""How far the sources of a language are from each other and from their language.

Terms are indexed in a single pass. A task counts terms of the documents it reads in a
block of postings (documents per language and term, occurrences per language, source and
term) until the block's memory is full, spills it as term-sorted runs, one for each hash
shard of the terms, and begins an empty block. The runs of a shard meet in one task, which
merges them with a heap into whole frequencies and keeps the terms of enough documents.
Runs hold a term once however often it occurs, so a term, a source or a language that
holds a third of all rows is as many entries as there are blocks.

A kept term that occurs ``c`` times in a group has the share ``p(c, N, V)`` there. The
divergence of two groups is summed over all kept terms without visiting terms that
neither has: as if no term occurred in either, plus for each group what its own counts
change while the other's stay at zero (from the histogram of its counts), plus for each
term in both the correction of the two. The corrections of a term's postings are streamed
in tasks, which sum them by pair before they leave; no pair of rows is ever joined.

All arithmetic is on integers. Counts may reach 9e13 before a product overflows.

Defined results: a null text, language or source is the empty one; a text without a term
is a document of its group all the same; ties are ranked by the UTF-8 order of the item;
repeated rows count as often as they occur, whatever their ids; a text of any length is
read in pieces; a language whose terms are all rare has no ``term`` rows and divergences
of 0; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from itertools import groupby, repeat
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordlens.llm.store import stored
from recordlens.session import broadcast_if_small

LEAST_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000

#: Bytes a block may hold, reckoned at ``ENTRY_BYTES`` an entry and the letters of its documents.
BLOCK_BYTES = 96 << 20
ENTRY_BYTES = 160
#: A text is split into words in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Pair corrections that are summed at once, and sums a task holds before it hands them on.
PAIRS_AT_ONCE = 1 << 20
PAIRS_HELD = 1 << 19

RUN = "shard int, lang string, terms binary, docs binary, ends binary, sources binary, counts binary, names array<string>"
FREQUENCY = "lang string, term string, docs long, sources array<string>, counts array<long>"
CORRECTION = "lang string, a string, b string, value long"

# Every ASCII character but letters ends a term; only A-Z is lower-cased.
_LETTERS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a UTF-8 text, a bounded piece at a time."""
    text = text.translate(_LETTERS)
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = text.find(b" ", at + PIECE_BYTES)
        if end < 0:
            break
        yield text[at:end].split()
        at = end
    yield (text[at:] if at else text).split()


class Block:
    """Postings of some documents in memory."""

    def __init__(self, shards: int):
        self.shards, self.bytes = shards, 0
        self.docs: dict[str, Counter] = {}
        self.counts: dict[str, dict[str, Counter]] = {}

    def add(self, lang: str, source: str, text: bytes) -> None:
        docs = self.docs.setdefault(lang, Counter())
        counts = self.counts.setdefault(lang, {}).setdefault(source, Counter())
        before, distinct = len(docs) + len(counts), set()
        for words in _pieces(text):
            counts.update(words)
            distinct.update(words)
        docs.update(distinct)
        grown = len(docs) + len(counts) - before
        self.bytes += ENTRY_BYTES * grown + min(len(text), sum(map(len, distinct)) if grown else 0)

    def runs(self) -> Iterator[tuple]:
        """The block as term-sorted runs, one for each language and shard."""
        for lang, docs in self.docs.items():
            terms = sorted(docs)
            if not terms:
                continue
            at = dict(zip(terms, range(len(terms))))
            names = sorted(self.counts[lang])
            parts = [self.counts[lang][name] for name in names]
            term = np.concatenate([np.fromiter(map(at.__getitem__, p), np.int64, len(p)) for p in parts])
            source = np.repeat(np.arange(len(names), dtype=np.int32), [len(p) for p in parts])
            count = np.concatenate([np.fromiter(p.values(), np.int64, len(p)) for p in parts])
            n_docs = np.fromiter(map(docs.__getitem__, terms), np.int64, len(terms))
            shard = np.fromiter((crc32(t) % self.shards for t in terms), np.int64, len(terms))
            order = np.lexsort((source, term, shard[term]))
            term, source, count = term[order], source[order], count[order]
            many = np.bincount(term, minlength=len(terms))
            by_shard = np.argsort(shard, kind="stable")
            bounds = np.flatnonzero(np.diff(shard[by_shard], prepend=-1, append=self.shards))
            done = 0
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = by_shard[a:b]
                ends = np.cumsum(many[own])
                upto = done + int(ends[-1])
                yield (
                    int(shard[own[0]]), lang, b"\n".join([terms[k] for k in own]), n_docs[own].tobytes(),
                    ends.astype(np.int64).tobytes(), source[done:upto].tobytes(), count[done:upto].tobytes(), names,
                )
                done = upto


def _texts(batches) -> Iterator[tuple[str, str, bytes]]:
    """Language, source and UTF-8 text of each row; a row at a time, null as empty."""
    import pyarrow as pa

    for batch in batches:
        langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        texts = batch.column(2).cast(pa.large_binary())
        for lang, source, text in zip(langs, sources, texts):
            yield lang or "", source or "", text.as_py() or b""


def _index(shards: int):
    def spill(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("shard", pa.int32()), ("lang", pa.string())]
            + [(n, pa.binary()) for n in ("terms", "docs", "ends", "sources", "counts")]
            + [("names", pa.list_(pa.string()))]
        )
        block = Block(shards)
        for lang, source, text in _texts(batches):
            block.add(lang, source, text)
            if block.bytes > BLOCK_BYTES:
                for run in block.runs():
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, run))], schema)
                block = Block(shards)
        for run in block.runs():
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, run))], schema)

    return spill


def merged(runs: list[dict], least: int) -> Iterator[tuple[str, int, list[str], list[int]]]:
    """Term, documents, sources and counts of the runs of one shard and language, by heap."""
    cursors, columns = [], []
    for number, run in enumerate(runs):
        terms = run["terms"].split(b"\n")
        cursors.append(zip(terms, repeat(number), range(len(terms))))
        columns.append(
            (np.frombuffer(run["docs"], np.int64), np.frombuffer(run["ends"], np.int64),
             np.frombuffer(run["sources"], np.int32), np.frombuffer(run["counts"], np.int64), run["names"])
        )
    for term, same in groupby(heapq.merge(*cursors), key=lambda entry: entry[0]):
        same = list(same)
        n_docs = sum(int(columns[number][0][k]) for _, number, k in same)
        if n_docs < least:
            continue
        total: Counter = Counter()
        for _, number, k in same:
            _, ends, sources, counts, names = columns[number]
            begin, end = int(ends[k - 1]) if k else 0, int(ends[k])
            for source, count in zip(sources[begin:end].tolist(), counts[begin:end].tolist()):
                total[names[source]] += count
        names = sorted(total)
        yield term.decode("utf-8", "replace"), n_docs, names, [total[n] for n in names]


def _merge(least: int):
    def merge(batches):
        import pyarrow as pa

        schema = pa.schema(
            [("lang", pa.string()), ("term", pa.string()), ("docs", pa.int64()),
             ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]
        )
        rows = (row for batch in batches for k in range(len(batch)) for row in batch.slice(k, 1).to_pylist())
        out = []
        for (_, lang), runs in groupby(rows, key=lambda r: (r["shard"], r["lang"])):
            for found in merged(list(runs), least):
                out.append(dict(zip(schema.names, (lang, *found))))
                if len(out) == 2000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        yield pa.RecordBatch.from_pylist(out, schema)

    return merge


def term_frequencies(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                     least_docs: int = LEAST_DOCS) -> DataFrame:
    """``lang, term, docs, sources, counts`` of each term in ``least_docs`` documents or more."""
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(lang).cast("string"), F.col(source).cast("string"), F.col(text).cast("string"))
    runs = texts.mapInArrow(_index(shards), RUN)
    dealt = runs.repartition(shards, "shard").sortWithinPartitions("shard", "lang")
    return dealt.mapInArrow(_merge(least_docs), FREQUENCY)


def share(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 2) / (total + 2 * kept))``, in steps that cannot overflow."""
    whole = total + 2 * kept
    first = (count + 2) * 10_000
    steps = F.call_function("div", first, whole) * 100_000
    return 1 + steps + F.call_function("div", F.pmod(first, whole) * 100_000, whole)


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _np_gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


class _Sums:
    """Corrections by pair of sources of one language."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.names: list[str] = []
        self.keys, self.values, self.pending = [], [], 0
        self.held_keys, self.held = np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, names: list[str], p: np.ndarray, zero: np.ndarray) -> None:
        for name in names:
            if name not in self.ids:
                self.ids[name] = len(self.names)
                self.names.append(name)
        ids = np.fromiter(map(self.ids.__getitem__, names), np.int64, len(names))
        step = max(1, PAIRS_AT_ONCE // max(1, len(ids)))
        for begin in range(0, len(ids), step):
            rows = np.arange(begin, min(begin + step, len(ids)))
            i, j = np.nonzero(rows[:, None] < np.arange(len(ids))[None, :])
            i += begin
            value = _np_gap(p[i], p[j]) - _np_gap(p[i], zero[j]) - _np_gap(zero[i], p[j]) + _np_gap(zero[i], zero[j])
            low, high = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
            self.keys.append(low << 31 | high)
            self.values.append(value)
            self.pending += len(value)
            if self.pending > PAIRS_AT_ONCE:
                self.fold()

    def fold(self) -> None:
        keys = np.concatenate([self.held_keys, *self.keys])
        values = np.concatenate([self.held, *self.values])
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        self.held_keys = keys[first]
        self.held = np.add.reduceat(values, first) if len(first) else values
        self.keys, self.values, self.pending = [], [], 0

    def rows(self, lang: str) -> Iterator[dict]:
        self.fold()
        for key, value in zip(self.held_keys.tolist(), self.held.tolist()):
            a, b = sorted((self.names[key >> 31], self.names[key & (1 << 31) - 1]))
            yield {"lang": lang, "a": a, "b": b, "value": value}


def _correct(batches):
    import pyarrow as pa

    schema = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    sums: dict[str, _Sums] = {}
    for batch in batches:
        for row in batch.to_pylist():
            postings = row["postings"]
            own = sums.setdefault(row["lang"], _Sums())
            p = np.fromiter((x["p"] for x in postings), np.int64, len(postings))
            zero = np.fromiter((x["zero"] for x in postings), np.int64, len(postings))
            own.add([x["source"] for x in postings], p, zero)
            if len(own.held) > PAIRS_HELD:
                yield pa.RecordBatch.from_pylist(list(sums.pop(row["lang"]).rows(row["lang"])), schema)
    for lang, own in sums.items():
        yield pa.RecordBatch.from_pylist(list(own.rows(lang)), schema)


def _ranked(rows: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.select(
        "lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank")
    )


def _groups(docs: DataFrame, lang: str, source: str, frequencies: DataFrame, postings: DataFrame) -> DataFrame:
    """``lang, source, total, kept, lang_total``: one row for each group that occurs."""
    occurring = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("source"),
    ).distinct()
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    sizes = frequencies.groupBy("lang").agg(
        F.count("*").alias("kept"),
        F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("lang_total"),
    )
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long")).alias(name)
    joined = occurring.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return joined.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))


def divergences(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text",
                least_docs: int = LEAST_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    Part ``pair``: the divergence of a source from each other source of its language. Part
    ``term``: the ``top`` terms that the source uses most beyond its language.
    """
    frequencies = stored(term_frequencies(docs, lang, source, text, least_docs), "term-frequencies")
    postings = frequencies.select(
        "lang", "term",
        F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b).alias("lang_count"),
        F.explode(F.arrays_zip("sources", "counts")).alias("posting"),
    ).select("lang", "term", "lang_count", F.col("posting.sources").alias("source"), F.col("posting.counts").alias("count"))
    groups = stored(_groups(docs, lang, source, frequencies, postings), "groups")
    sizes = F.octet_length("lang") + F.octet_length("source")

    weighted = postings.join(broadcast_if_small(groups, sizes), ["lang", "source"]).select(
        "lang", "source", "term", "count",
        share(F.col("count"), F.col("total"), F.col("kept")).alias("p"),
        share(F.lit(0), F.col("total"), F.col("kept")).alias("zero"),
        share(F.col("lang_count"), F.col("lang_total"), F.col("kept")).alias("q"),
    )
    terms = weighted.where("p > q").select(
        "lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")
    )
    terms = _ranked(terms, "term").where(F.col("rank") <= top)

    corrections = (
        weighted.groupBy("lang", "term")
        .agg(F.collect_list(F.struct("source", "p", "zero")).alias("postings"))
        .where(F.size("postings") > 1)
        .select("lang", "postings")
        .mapInArrow(_correct, CORRECTION)
        .groupBy("lang", "a", "b")
        .agg(F.sum("value").alias("both"))
    )
    histograms = (
        weighted.groupBy("lang", "source", "p").agg(F.count("*").alias("n"))
        .groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("shares"))
    )
    own = groups.where("kept > 0").join(histograms, ["lang", "source"], "left").select(
        "lang", "source", "kept", "shares", share(F.lit(0), F.col("total"), F.col("kept")).alias("zero")
    )

    def side(shares: str, zero: Column, other: Column) -> Column:
        """What one group's counts change while the other's stay at zero."""
        change = lambda s: s["n"] * (gap(s["p"], other) - gap(zero, other))
        start = F.lit(0).cast("long")
        return F.coalesce(F.aggregate(shares, start, lambda total, s: total + change(s)), start)

    x = own.alias("x")
    y = broadcast_if_small(own, sizes + 16 * F.coalesce(F.size("shares"), F.lit(0))).alias("y")
    zero_x, zero_y = F.col("x.zero"), F.col("y.zero")
    pairs = x.join(y, (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source"))).select(
        F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"),
        (
            F.col("x.kept") * gap(zero_x, zero_y)
            + side("x.shares", zero_x, zero_y)
            + side("y.shares", zero_y, zero_x)
        ).alias("apart"),
    )
    total = F.col("apart") + F.coalesce("both", F.lit(0).cast("long"))
    pairs = pairs.join(corrections, ["lang", "a", "b"], "left").select("lang", "a", "b", total.alias("value"))
    bare = groups.where("kept = 0").select("lang", "source")
    nothing = (
        bare.alias("x")
        .join(bare.alias("y"), (F.col("x.lang") == F.col("y.lang")) & (F.col("x.source") < F.col("y.source")))
        .select(F.col("x.lang").alias("lang"), F.col("x.source").alias("a"), F.col("y.source").alias("b"),
                F.lit(0).cast("long").alias("value"))
    )
    both_ways = pairs.unionByName(nothing).select(
        "lang", "value",
        F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
                          F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("way"),
    ).select("lang", "way.source", "way.item", "value")
    return _ranked(both_ways, "pair").unionByName(terms)
