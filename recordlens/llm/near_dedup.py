"""Near copies by an LSH forest over MinHash signatures of word shingles.

A document is the set of its distinct five-word shingles. Documents with equal sets are one
node, known by a 128-bit fingerprint. ``TREES`` signature orders sort the nodes; nodes that
share the longest prefix of an order form a region of it and are each other's candidates.
Depth adapts to the region: ``SHALLOW`` values where that leaves at most ``CROWD`` nodes
together, else one value more, down to ``DEEP``. Regions still larger are compared block by
block, every block with every other, so no region is ever in one task and none is cut short.

Candidates whose signatures agree too little are let go (``AGREEING`` of ``VALUES`` is over
four deviations below the threshold); all other pairs that could join two components are
confirmed on the full sets:

1. In the first orders, full sets come to each region's block once and links are confirmed
   there, leaving out pairs that are already connected, so a group of copies costs about as
   many comparisons as it has members.
2. Components of those links are found. Over all orders, members that still have a candidate
   in another component come to their blocks in the same way, and the links confirmed there
   complete the components. Pairs are never rows; members are, once per order.

3. A region that was too large at ``SHALLOW`` values asks more of a pair, so its members go
   through ``MORE_TREES`` further orders and are linked there in the same way.

At a similarity of 0.75 a pair has the first 3, 4, 5 or 6 values of an order in common with
a chance of 42, 32, 24 or 18 %. All ``TREES`` orders at 3 values miss it about twice in
100,000; a pair that needs more somewhere has all ``TREES + MORE_TREES`` orders, which miss
it at most twice in 100,000 at 6 values and less at 4 or 5. The size of a region therefore
does not lower what is found. The further orders use the lowest byte of each value; values
that agree in it by chance only add candidates.

Defined results: words are lower-cased (A-Z); fewer than five words are one shingle; a text
without words has an empty set and no links; rows with a null id can join a component but
do not name it, a component of such rows alone has a null id and all its rows are kept;
rows that repeat an id are nodes by their text, and all rows of a component that have its
smallest id are kept; further columns are ignored by ``near_groups`` and carried by
``drop_near_copies``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlens.llm.components import components
from recordlens.llm.marks import marks, with_mark
from recordlens.llm.memory import slices
from recordlens.llm.store import stored
from recordlens.llm.token_ids import utf8
from recordlens.llm.word_hashes import run_hashes, word_hashes

SHINGLE = 5
PERCENT = 75
TREES = 20
SHALLOW, DEEP = 3, 6
VALUES = 256
#: (1 - 0.75 ** SHALLOW) ** TREES and (1 - 0.75 ** DEEP) ** (TREES + MORE_TREES) are both 2e-5.
MORE_TREES = 36
_ALL_VALUES = DEEP * (TREES + MORE_TREES)
CROWD = 2048
FIRST_TREES = 3
#: 0.75 less 4.5 deviations of the mean of 256 values.
AGREEING = int(VALUES * (PERCENT / 100 - 4.5 * (0.75 * 0.25 / VALUES) ** 0.5))

_RANDOM = np.random.default_rng(20_240_229)
_DRAWN = [_RANDOM.integers(0, 1 << 32, n, np.uint32) for n in (VALUES, VALUES, _ALL_VALUES - VALUES, _ALL_VALUES - VALUES)]
_FACTORS = np.concatenate(_DRAWN[::2]) | np.uint32(1)
_FLIPS = np.concatenate(_DRAWN[1::2])


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(run_hashes(word_hashes(words), min(SHINGLE, len(words))))


def fingerprint(shingles: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(shingles.tobytes())


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The MinHash values of each non-empty set."""
    out = np.empty((len(sets), _ALL_VALUES), np.uint32)
    first = 0
    while first < len(sets):
        last, held = first, 0
        while last < len(sets) and (held == 0 or held + len(sets[last]) <= 1 << 16):
            held += len(sets[last])
            last += 1
        some = sets[first:last]
        hashes = (np.concatenate(some) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0] + [len(s) for s in some[:-1]])
        mixed = np.empty_like(hashes)
        for k in range(_ALL_VALUES):
            np.bitwise_xor(hashes, _FLIPS[k], out=mixed)
            np.multiply(mixed, _FACTORS[k], out=mixed)
            out[first:last, k] = np.minimum.reduceat(mixed, starts)
        first = last
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of distinct hashes are near enough."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) * 100 < PERCENT * len(b):
        return False
    at = np.searchsorted(b, a)
    shared = int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def _signed(docs: DataFrame) -> DataFrame:
    """``id, tie, n, node, forest, sketch, more`` per document: set size, fingerprint,
    signature; ``more`` goes on where ``sketch`` ends."""
    kind = f"id {dict(docs.dtypes)['id']}, tie long, n long, node binary, forest binary, sketch binary, more binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            for first in range(0, batch.num_rows, 256):
                some = batch.slice(first, 256)
                sets = [shingle_set(t) for t in utf8(some.column(2))]
                values = iter(signatures([s for s in sets if len(s)]))
                rows = []
                for s in sets:
                    if len(s):
                        own = next(values)
                        rows.append((len(s), fingerprint(s), own[: TREES * DEEP].astype(">u4").tobytes(), own[:VALUES].astype(np.uint8).tobytes(), own[VALUES:].astype(np.uint8).tobytes()))
                    else:
                        rows.append((0, None, None, None, None))
                n, nodes, forest, sketch, more = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(1), pa.array(n, pa.int64()), *(pa.array(c, pa.binary()) for c in (nodes, forest, sketch, more))],
                    ["id", "tie", "n", "node", "forest", "sketch", "more"],
                )

    return docs.select("id", "tie", "text").mapInArrow(run, kind)


def _prefix(depth: int, width: int, first: int) -> Column:
    """The region of an order at a depth: the order and its first values, of ``width`` bytes."""
    label = F.expr(f"substring(forest, (tree - {first}) * {width * DEEP} + 1, {width * depth})")
    return F.xxhash64("tree", label)


def _regions(nodes: DataFrame, first: int = 0, trees: int = TREES, width: int = 4) -> tuple[DataFrame, DataFrame | None]:
    """``block, tree, part, node``: members of regions of two or more, by blocks; and the
    nodes of regions that were too large at ``SHALLOW`` values, if there are any."""
    rows = nodes.select("node", "forest", F.explode(F.expr(f"sequence({first}, {first + trees - 1})")).alias("tree"))
    level = rows.select("node", "tree", *[_prefix(d, width, first).alias(f"at{d}") for d in range(SHALLOW, DEEP + 1)])
    found = crowded = None
    for depth in range(SHALLOW, DEEP + 1):
        sizes = level.groupBy(F.col(f"at{depth}").alias("region")).agg(F.count("*").alias("size")).where("size > 1")
        members = level.join(sizes, F.col(f"at{depth}") == F.col("region"))
        done = members if depth == DEEP else members.where(F.col("size") <= CROWD)
        done = done.select("node", "tree", "region", "size")
        found = done if found is None else found.unionByName(done)
        if depth < DEEP:
            level = stored(members.where(F.col("size") > CROWD).drop("region", "size"), "crowded")
            if level.isEmpty():
                break
            if depth == SHALLOW:
                crowded = level.select("node").distinct()
    blocks = F.ceil(F.col("size") / F.lit(CROWD // 2)).cast("int")
    own = F.when(F.col("size") <= CROWD, 0).otherwise(F.pmod(F.xxhash64("node"), blocks)).cast("int")
    count = F.when(F.col("size") <= CROWD, 1).otherwise(blocks)
    members = (
        found.withColumns({"part": own, "blocks": count})
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "tree", "part",
                F.xxhash64("region", F.least("part", "other"), F.greatest("part", "other")).alias("block"))
    )
    return members, crowded


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of one block at a time; rows come sorted by block."""
    held: dict[str, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
        block = columns["block"].to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
        for a, b in zip(cuts, cuts[1:]):
            rows = {name: c.slice(a, b - a).to_pylist() for name, c in columns.items()}
            if held and held["block"][0] == rows["block"][0]:
                for name, values in rows.items():
                    held[name] += values
            else:
                if held:
                    yield held
                held = rows
    if held:
        yield held


def _candidates(group: dict[str, list], label: np.ndarray) -> np.ndarray:
    """Pairs of a block with different labels whose signatures agree, most agreeing first.
    Members of one part meet in the block of that part alone."""
    m = len(group["node"])
    sketch = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(m, VALUES)
    size, part = np.array(group["n"]), np.array(group["part"])
    split = len(set(group["part"])) > 1
    found = []
    step = max(1, (1 << 24) // (m * VALUES))
    for first in range(0, m - 1, step):
        rows = np.arange(first, min(first + step, m))
        agree = np.count_nonzero(sketch[rows, None] == sketch[None, first:], axis=2)
        good = agree >= AGREEING
        good &= np.minimum(size[rows, None], size[None, first:]) * 100 >= PERCENT * np.maximum(size[rows, None], size[None, first:])
        good &= np.arange(first, m)[None] > rows[:, None]
        if split:
            good &= part[rows, None] != part[None, first:]
        good &= label[rows, None] != label[None, first:]
        i, j = np.nonzero(good)
        found.append(np.stack([rows[i], j + first, agree[i, j]], 1))
    pairs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    return pairs[np.argsort(-pairs[:, 2], kind="stable"), :2]


def _labels(group: dict[str, list]) -> np.ndarray:
    """The component of each member as a small number."""
    numbers: dict[bytes, int] = {}
    return np.array([numbers.setdefault(x, len(numbers)) for x in group["label"]])


def _suspects(members: DataFrame) -> DataFrame:
    """Members of blocks that have a candidate of another component there."""
    kind = "node binary, n long, sketch binary, tree int, part int, block long, label binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            if len(set(group["label"])) > 1:
                found = np.unique(_candidates(group, _labels(group))).tolist()
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([group[c][k] for k in found], t) for c, t in zip(_SUSPECT, _SUSPECT_TYPES)], _SUSPECT
                    )

    rows = members.select(*_SUSPECT)
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, kind)


_SUSPECT = ["node", "n", "sketch", "tree", "part", "block", "label"]
_SUSPECT_TYPES = [pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_LINK = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _links(suspects: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links of each block between what neither components nor links found there
    before connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            label = _labels(group)
            top = list(range(len(label)))

            def root(k: int) -> int:
                while top[k] != k:
                    top[k] = top[top[k]]
                    k = top[k]
                return k

            full = [np.frombuffer(s, np.uint64) for s in group["shingles"]]
            of = label.tolist()
            a, b = [], []
            for i, j in _candidates(group, label).tolist():
                if root(of[i]) != root(of[j]) and linked(full[i], full[j]):
                    top[root(of[j])] = root(of[i])
                    a.append(group["node"][i])
                    b.append(group["node"][j])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], schema=_LINK)

    rows = suspects.join(sets, "node").select(*_SUSPECT, "shingles")
    return rows.repartition("block").sortWithinPartitions("block").mapInArrow(run, "a binary, b binary")


def _relabelled(suspects: DataFrame, labels: DataFrame) -> DataFrame:
    """Suspects with the components found so far."""
    known = labels.select(F.col("node").alias("k"), F.col("label").alias("now"))
    joined = suspects.join(known, F.col("node") == F.col("k"), "left")
    return joined.withColumn("label", F.coalesce("now", "node")).select(*_SUSPECT)


def _full_sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, shingles`` of the wanted nodes, from the texts of one document of each."""
    first = nodes.join(wanted, "node", "left_semi").select("id")
    rows = with_mark(docs.select("id", "text"), marks(first, F.xxhash64("id")), F.xxhash64("id"), "marked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            sets = [shingle_set(t) for t in utf8(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([fingerprint(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())],
                ["node", "shingles"],
            )

    found = rows.where("marked").select("text").mapInArrow(run, "node binary, shingles binary")
    return stored(found.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "full-sets")


def _as_links(labels: DataFrame) -> DataFrame:
    """Components as links of their nodes to their label."""
    return labels.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))


def _grouped(rows: DataFrame) -> DataFrame:
    """``id, tie, n, component_id`` of the documents ``id, tie, text``."""
    signed = stored(_signed(rows), "signatures")
    nodes = stored(
        signed.where("node IS NOT NULL").groupBy("node")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("forest").alias("forest"), F.first("sketch").alias("sketch"),
             F.first("more").alias("more")),
        "nodes",
    )
    members, crowded = _regions(nodes)
    members = members.join(nodes.select("node", "n", "sketch"), "node")
    suspects = stored(_suspects(members.withColumn("label", F.col("node"))), "suspects")
    sets = _full_sets(rows, nodes, suspects.select("node").distinct())
    first = stored(_links(suspects.where(F.col("tree") < FIRST_TREES), sets), "first-links")
    apart = _suspects(_relabelled(suspects, components(first)))
    links = first.unionByName(_links(apart, sets))
    labels = components(links)
    if crowded is not None:
        # Bytes of the values after those of the first orders.
        rest = F.expr(f"concat(substring(sketch, {DEEP * TREES + 1}, {VALUES - DEEP * TREES}), more)")
        deeper = nodes.join(crowded, "node", "left_semi").select("node", rest.alias("forest"))
        members, _ = _regions(deeper, TREES, MORE_TREES, 1)
        members = members.join(nodes.select("node", "n", "sketch"), "node")
        more = stored(_suspects(_relabelled(members.withColumn("label", F.col("node")), labels)), "more-suspects")
        sets = _full_sets(rows, nodes, more.select("node").distinct())
        labels = components(_as_links(labels).unionByName(_links(more, sets)))

    known = labels.select(F.col("node").alias("k"), "label")
    named = nodes.select("node", "id").join(known, F.col("node") == F.col("k"), "left")
    named = named.select("node", "id", F.coalesce("label", "node").alias("label"))
    names = named.groupBy(F.col("label").alias("of")).agg(F.min("id").alias("component_id"))
    named = named.join(names, F.col("label") == F.col("of")).select(F.col("node").alias("k"), "component_id")
    joined = signed.where("node IS NOT NULL").join(named, F.col("node") == F.col("k"), "left")
    return joined.select("id", "tie", "n", "component_id").unionByName(
        signed.where("node IS NULL").select("id", "tie", "n", F.col("id").alias("component_id"))
    )


def _kept() -> Column:
    return F.col("id").eqNullSafe(F.col("component_id"))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    return _grouped(rows).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", _kept().alias("kept")
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one id of each component, with all their columns.

    Only rows that may be among the dropped ones, by a bit map of fixed size, are shuffled.
    Rows travel as one struct, so that columns of any name come back."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    own, content = F.col(f"_doc.`{id_col}`"), F.col(f"_doc.`{text}`")
    tie = F.xxhash64(content)
    groups = _grouped(whole.select(own.alias("id"), tie.alias("tie"), content.alias("text")))
    dropped = stored(groups.where(~_kept()).select(F.col("id").alias("_gone"), F.col("tie").alias("_as")), "near-copies")
    rows = with_mark(whole, marks(dropped, F.xxhash64("_gone", "_as")), F.xxhash64(own, tie), "_marked")
    maybe = rows.where("_marked").select("_doc")
    stays = maybe.join(dropped, own.eqNullSafe(F.col("_gone")) & tie.eqNullSafe(F.col("_as")), "left_anti")
    return rows.where("NOT _marked").select("_doc").unionByName(stays.select("_doc")).select("_doc.*")
