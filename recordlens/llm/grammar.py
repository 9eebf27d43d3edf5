"""Re-Pair grammars over token ids, and the file that holds one shard of documents.

A shard repeatedly replaces frequent neighbouring pairs by a new symbol, until no pair has
``least`` places or ``max_rules`` are used up. Each round takes all pairs at least an eighth
as frequent as the fullest bucket of pairs, or, if there is none, all with ``least`` places;
overlapping places are settled from left to right. Counts of hash buckets are kept from round
to round and only say which places to look at: the pairs there are counted exactly. Once the
buckets have been looked through for ``least`` places they are no longer needed: a pair that
was there before never gains a place, so only the frequent ones found and the pairs beside
replaced places are counted on.
A pair never starts with the end id or a symbol that ends with it, so every document starts
at a symbol of its own and can be decoded alone from the rules and their expansion lengths.

File, little-endian: 4 bytes ``RPR1``; seven int64 (terminals, rules, symbols, bytes per
symbol, documents, ids, bytes per id of a rule side = 4); rules as uint32 pairs; expansion
lengths uint32; symbols; and per document its key int64, a null flag byte, the number of
its ids int64 and of its symbols int64.
"""

from __future__ import annotations

import itertools

import numpy as np

MAGIC = b"RPR1"
_BUCKET_BITS = 18
_NEVER = 1 << _BUCKET_BITS
_NONE = np.empty((0, 2), np.uint32)


class Shard:
    """A compressed shard: rules, expansion lengths, symbols and the index of documents."""

    def __init__(self, terminals, rules, lengths, symbols, keys, nulls, n_ids, n_symbols):
        self.terminals, self.rules, self.lengths, self.symbols = terminals, rules, lengths, symbols
        self.keys, self.nulls, self.n_ids, self.n_symbols = keys, nulls, n_ids, n_symbols
        self._pool = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules expanded, one after another, and where each starts."""
        if self._pool is None:
            starts = np.concatenate([[0], np.cumsum(self.lengths, dtype=np.int64)])
            pool = np.empty(starts[-1], np.uint32)
            first = starts.tolist()
            for k, (left, right) in enumerate(self.rules.tolist()):
                at = first[k]
                for side in (left, right):
                    if side < self.terminals:
                        pool[at] = side
                        at += 1
                    else:
                        a, b = first[side - self.terminals], first[side - self.terminals + 1]
                        pool[at : at + b - a] = pool[a:b]
                        at += b - a
            self._pool = pool, starts[:-1]
        return self._pool

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids that ``symbols`` stand for."""
        pool, starts = self._expansions()
        # Ids lie behind the expanded rules, each for itself.
        pool = np.concatenate([pool, np.arange(self.terminals, dtype=np.uint32)])
        start = np.concatenate([np.arange(len(pool) - self.terminals, len(pool)), starts])
        sizes = np.concatenate([np.ones(self.terminals, np.int64), self.lengths]).take(symbols)
        ends = np.cumsum(sizes)
        source = np.repeat(start.take(symbols) - ends + sizes, sizes)
        source += np.arange(len(source))
        return pool.take(source)

    def document(self, k: int) -> np.ndarray:
        """The ids of document ``k`` of the shard, without decoding the others."""
        end = int(self.n_symbols[: k + 1].sum())
        return self.expand(self.symbols[end - int(self.n_symbols[k]) : end])

    def documents(self) -> list[np.ndarray]:
        return np.split(self.expand(self.symbols), np.cumsum(self.n_ids)[:-1]) if len(self.keys) else []

    def to_bytes(self) -> bytes:
        width = 2 if self.terminals + len(self.rules) <= 1 << 16 else 4
        head = np.array(
            [self.terminals, len(self.rules), len(self.symbols), width, len(self.keys), self.n_ids.sum(), 4],
            "<i8",
        )
        parts = [
            head, self.rules.astype("<u4"), self.lengths.astype("<u4"), self.symbols.astype(f"<u{width}"),
            self.keys.astype("<i8"), self.nulls.astype("u1"), self.n_ids.astype("<i8"), self.n_symbols.astype("<i8"),
        ]
        return MAGIC + b"".join(p.tobytes() for p in parts)

    @staticmethod
    def from_bytes(data: bytes) -> Shard:
        if data[:4] != MAGIC:
            raise ValueError("not a shard of ids")
        terminals, rules, symbols, width, docs, _, _ = np.frombuffer(data, "<i8", 7, 4).tolist()
        at = 4 + 56

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            found = np.frombuffer(data, kind, count, at)
            at += found.nbytes
            return found

        return Shard(
            terminals, take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules), take(f"<u{width}", symbols),
            take("<i8", docs), take("u1", docs), take("<i8", docs), take("<i8", docs),
        )


def compress(
    keys: list[int | None], documents: list[np.ndarray], end_id: int, terminals: int,
    max_rules: int = 16_000, least: int = 12, rounds: int | None = None,
) -> Shard:
    """One shard from documents that each end with ``end_id``; all ids are below ``terminals``."""
    n_ids = np.array([len(d) for d in documents], np.int64)
    ids = np.concatenate(documents) if documents else np.empty(0, np.uint32)
    # Symbols that end a document: the end id and the rules that end with it.
    closes = np.zeros(terminals + max_rules, bool)
    closes[end_id] = True
    pairs = _Pairs(ids.astype(np.uint32), closes)
    rules: list[np.ndarray] = []
    lengths = np.empty(0, np.uint32)
    for _ in itertools.count() if rounds is None else range(rounds):
        room = max_rules - len(lengths)
        added = pairs.replace(terminals + len(lengths), room, least)
        if not len(added):
            break
        size = np.ones(added.shape, np.uint32)
        nested = added >= terminals
        size[nested] = lengths[added[nested] - terminals]
        rules.append(added)
        lengths = np.concatenate([lengths, size.sum(1, dtype=np.uint32)])
    symbols = pairs.symbols
    table = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    size = np.ones(len(symbols), np.int64)
    size[symbols >= terminals] = lengths[symbols[symbols >= terminals] - terminals]
    doc_ends = np.searchsorted(np.cumsum(size), np.cumsum(n_ids)) + 1
    nulls = np.array([k is None for k in keys], bool)
    return Shard(
        terminals, table, lengths, symbols, np.array([k or 0 for k in keys], np.int64), nulls,
        n_ids, np.diff(doc_ends, prepend=0) if len(keys) else np.empty(0, np.int64),
    )


class _Pairs:
    """A sequence and how often the pairs of each bucket occur in it. The counts are carried
    from round to round: only pairs beside a replaced place leave or enter them."""

    def __init__(self, symbols: np.ndarray, closes: np.ndarray):
        self.symbols, self.closes = symbols, closes
        # The two sides of a pair in one number.
        self.half = 16 if len(closes) <= 1 << 16 else 32
        self.kind = np.uint32 if self.half == 16 else np.uint64
        self.bucket = np.full(len(symbols), _NEVER, np.int64)
        self.bucket[:-1] = self._buckets(symbols[:-1], symbols[1:])
        self.count = np.bincount(self.bucket, minlength=_NEVER + 1)
        self.count[_NEVER] = 0
        # Places of pairs that may have ``least`` places, once buckets were looked through for them.
        self.left: np.ndarray | None = None

    def _buckets(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The buckets of pairs. One that starts with the end of a document is never used."""
        hashed = left * np.uint32(0x9E3779B1)
        hashed += right * np.uint32(0x85EBCA6B)
        hashed >>= np.uint32(32 - _BUCKET_BITS)
        bucket = hashed.astype(np.int64)
        bucket[self.closes.take(left)] = _NEVER
        return bucket

    def _at(self, at: np.ndarray) -> np.ndarray:
        pair = self.symbols.take(at).astype(self.kind)
        pair <<= self.kind(self.half)
        pair |= self.symbols.take(at + 1)
        return pair

    def _put(self, at: np.ndarray, new: np.ndarray, next_symbol: int, pairs: np.ndarray) -> np.ndarray:
        """``new`` in place of the pairs at ``at``, and the rules for them."""
        sides = pairs >> self.kind(self.half), pairs & self.kind((1 << self.half) - 1)
        added = np.stack(sides, 1).astype(np.uint32)
        self.closes[next_symbol : next_symbol + len(added)] = self.closes[added[:, 1]]
        touched = np.zeros(len(self.symbols) + 1, bool)
        for beside in (at, at + 1, at - 1):
            touched[beside] = True  # -1 stands for the place after the last, which is left out
        if self.left is None:
            np.subtract.at(self.count, self.bucket.take(np.flatnonzero(touched[:-1])), 1)
        else:
            same = self.left[~touched[self.left]]
            same -= np.searchsorted(at + 1, same)
        self.symbols[at] = new
        keep = np.ones(len(self.symbols), bool)
        keep[at + 1] = False
        keep = np.flatnonzero(keep)
        self.symbols = self.symbols.take(keep)
        # The last symbol starts no pair.
        changed = np.flatnonzero(touched.take(keep[:-1]))
        if self.left is None:
            self.bucket = self.bucket.take(keep)
            self.bucket[-1] = _NEVER
            self.bucket[changed] = self._buckets(self.symbols.take(changed), self.symbols.take(changed + 1))
            np.add.at(self.count, self.bucket[changed], 1)
            self.count[_NEVER] = 0
        else:
            bucket = self._buckets(self.symbols.take(changed), self.symbols.take(changed + 1))
            changed = changed[bucket != _NEVER]
            self.left = np.sort(np.concatenate([same, changed]))
        return added

    def replace(self, next_symbol: int, room: int, least: int) -> np.ndarray:
        """One round: the pairs replaced, in the order of their symbols."""
        if len(self.symbols) < 2 or room <= 0:
            return _NONE
        if self.left is None:
            due = max(least, int(self.count.max()) // 8)
            if due > least:
                added = self._replace(next_symbol, room, self._places(due), [due], least)
                if len(added):
                    return added
            self.left = self._places(least)
        return self._replace(next_symbol, room, self.left, None, least)

    def _places(self, due: int) -> np.ndarray:
        # A bucket counts at least what its pairs do, so no frequent pair is left out here.
        return np.flatnonzero((self.count >= due).take(self.bucket))

    def _replace(self, next_symbol: int, room: int, at: np.ndarray, dues: list[int] | None, least: int) -> np.ndarray:
        """All pairs that occur as often as is due and keep a third of ``least`` places once overlapping
        ones are settled, else the most frequent of them alone, if it has ``least`` of its own.
        Of ``dues`` the first that has any; without them, an eighth of the most frequent, then ``least``."""
        found, own, count = np.unique(self._at(at), return_inverse=True, return_counts=True)
        if dues is None:
            often = count[own] >= least
            at, own = at[often], own[often]
            self.left = at
            dues = sorted({max(least, int(count.max(initial=0)) // 8), least}, reverse=True)
        for due in dues:
            added = self._replace_due(next_symbol, room, at, own, found, count, due, least)
            if len(added):
                return added
        return _NONE

    def _replace_due(self, next_symbol, room, at, own, found, count, due, least) -> np.ndarray:
        often = count[own] >= due
        at, own = at[often], own[often]
        settled = _every_second(at)
        used = np.bincount(own[settled], minlength=len(found))
        chosen = np.flatnonzero(used >= max(4, least // 3))
        chosen = chosen[np.argsort(-used[chosen], kind="stable")][:room]
        if len(chosen):
            at, own = at[settled], own[settled]
        else:
            # Only a pair of equal symbols overlaps itself.
            alone = {k: int(np.count_nonzero(_every_second(at[own == k]))) for k in np.unique(own).tolist()}
            best = max(alone, key=alone.get, default=None)
            if best is None or alone[best] < least:
                return _NONE
            chosen = np.array([best])
            at = at[own == best]
            at = at[_every_second(at)]
            own = np.full(len(at), best)
        symbol = np.zeros(len(found), np.uint32)
        symbol[chosen] = next_symbol + np.arange(len(chosen), dtype=np.uint32)
        new = symbol[own]
        return self._put(at[new > 0], new[new > 0], next_symbol, found[chosen])


def _every_second(at: np.ndarray) -> np.ndarray:
    """In a run of neighbouring places, every second one."""
    places = np.arange(len(at))
    run_start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, places, 0))
    return ((places - run_start) & 1) == 0
