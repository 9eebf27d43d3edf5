"""Repair of the turn structure of conversations by a Viterbi search with few survivors.

A conversation's rows, in order, are read once by a machine of four states: nothing yet,
after the system row, after a user row, after an assistant row. Each row is kept, given
the other role, or deleted, and empty rows may be inserted; the cheapest edits whose role
initials match ``(s?(ua)+)?`` win, ties by the ASCII order of the edits' initials.

After each row the best way into each state survives. Survivors are leaves of a tree of
back-pointers whose nodes count their children: a node without children is dropped, and
when all survivors share an ancestor the edits up to it are final and leave. For every
two survivors the order of their complete unresolved edits is carried along, so a tie is
decided on all of them, however long, without walking the tree. What is unresolved takes
one small list a row (some 200 bytes) beside the row's key; most conversations resolve
within a few rows, one of user rows only not before its end.

The search sees keys and faults only, one row for each distinct (turn, role, text). Its
edits then meet the texts in one shuffle by conversation, sorted, and are merged as a
stream. A conversation's rows are never held: one of any length, or one that has a third
of all rows, passes a single task in order, as its search and its digest must.

Order: by turn (nulls first), then role, then the SHA-256 of the text. Defined results:
nulls in role and text count as one space; a null conversation id is a conversation;
repeated rows are duplicates after the first; a row without a visible character is blank
even if repeated; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
NONE, DELETE, KEEP, REROLE = range(4)
LETTERS = " DKR"
COST = {KEEP: 0, REROLE: 2, DELETE: 3}
INSERT_COST = 2
OPEN_COST = 1

EMPTY, SYSTEM, USER, ASSISTANT = range(4)
# The state that a row of this initial leads to, and the initial that an edit makes.
KEPT = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
MADE = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}

# Rows and characters a task gathers before it hands them on.
ROWS_HELD = 4096
BYTES_HELD = 4 << 20

# One row for each distinct row of a conversation. ``code``: edit, inserted rows after it,
# inserted rows before the conversation's first.
EDITED = "code short"


def _first_order() -> tuple[tuple[int, ...], tuple[int, ...]]:
    """Survivors before any row: nothing, one inserted row, two inserted rows."""
    return (0, -1, INSERT_COST, 2 * INSERT_COST), tuple(
        {(EMPTY, USER): 2, (EMPTY, ASSISTANT): 2, (USER, ASSISTANT): 2, (USER, EMPTY): -2,
         (ASSISTANT, EMPTY): -2, (ASSISTANT, USER): -2}.get((a, b), 0)
        for a in range(4) for b in range(4)
    )


class Step:
    """What one kind of row does to survivors of given costs and order."""

    __slots__ = ("cost", "costs", "order", "parents", "codes")

    def __init__(self, costs, order, initial: str, fault: int):
        ways: dict[int, tuple] = {}

        def compare(a: tuple, b: tuple) -> int:
            """Order of two ways' edits: -1 or 1; -2 or 2 if one is the beginning of the other."""
            (_, p, op, k), (_, q, other, n) = a, b
            if p != q:
                known = order[4 * p + q]
                if abs(known) < 2:
                    return known
                # The longer one goes on with an insertion where the shorter one has its edit.
                return (-1 if op == DELETE else 1) if known > 0 else (1 if other == DELETE else -1)
            if op != other:
                return -1 if op < other else 1
            return 2 if k < n else -2

        for p in range(4):
            if costs[p] < 0:
                continue
            reached = [(DELETE, p)]
            if fault not in (BLANK, DUPLICATE):
                if (p, initial) in KEPT:
                    reached.append((KEEP, KEPT[p, initial]))
                reached.append((REROLE, MADE[p]))
            for op, state in reached:
                cost = costs[p] + COST[op] + (OPEN_COST if fault == TRUNCATED and op != DELETE else 0)
                for k in range(3):
                    way = (cost + k * INSERT_COST, p, op, k)
                    best = ways.get(state)
                    if best is None or way[0] < best[0] or way[0] == best[0] and compare(way, best) in (-1, 2):
                        ways[state] = way
                    state = MADE[state]
        # Whatever follows a system row, or nothing, can follow an assistant row too, for the price
        # of one deleted system row in the second case. What costs more than that cannot win.
        if ASSISTANT in ways:
            for state, more in ((EMPTY, COST[DELETE]), (SYSTEM, 0)):
                if state in ways and ways[state][0] > ways[ASSISTANT][0] + more:
                    del ways[state]
        least = min(way[0] for way in ways.values())
        self.cost = least
        self.costs = tuple(ways[s][0] - least if s in ways else -1 for s in range(4))
        self.order = tuple(
            compare(ways[a], ways[b]) if a != b and a in ways and b in ways else 0 for a in range(4) for b in range(4)
        )
        self.parents = tuple(ways[s][1] if s in ways else -1 for s in range(4))
        self.codes = tuple(ways[s][2] | ways[s][3] << 2 if s in ways else 0 for s in range(4))


_STEPS: dict[tuple, Step] = {}


def step(costs, order, initial: str, fault: int) -> Step:
    """Remembered: costs of survivors differ by a few units, so few steps are distinct."""
    key = (costs, order, initial, fault)
    found = _STEPS.get(key)
    if found is None:
        found = _STEPS[key] = Step(costs, order, initial, fault)
    return found


class Search:
    """The rows of one conversation in order; ``out`` gets the code of each once it is final."""

    def __init__(self, out: array):
        self.out = out
        self.costs, self.order = _first_order()
        # Layers of the tree: parents and codes of the four states, and how many children each has.
        self.layers: deque = deque([(None, (0, 0, 1, 2), [0, -1, 0, 0])])
        self.first, self.before = True, 0

    def row(self, initial: str, fault: int) -> None:
        done = step(self.costs, self.order, initial if initial in "sua" else "", fault)
        self.costs, self.order = done.costs, done.order
        above = self.layers[-1][2]
        for p in done.parents:
            if p >= 0:
                above[p] += 1
        self.layers.append((done.parents, done.codes, [0 if c >= 0 else -1 for c in done.costs]))
        self._drop()
        while len(self.layers) > 1 and sum(n > 0 for n in self.layers[0][2]) == 1:
            self._emit(next(s for s in range(4) if self.layers[0][2][s] > 0))

    def _drop(self) -> None:
        """Nodes of the last layer but one without children go, and so on upwards."""
        at = len(self.layers) - 2
        while at >= 0:
            parents, _, children = self.layers[at]
            gone = [s for s in range(4) if children[s] == 0]
            if not gone:
                return
            for s in gone:
                children[s] = -1
                if parents is not None and at:
                    self.layers[at - 1][2][parents[s]] -= 1
            at -= 1

    def _emit(self, state: int) -> None:
        _, codes, _ = self.layers.popleft()
        if self.first:
            self.first, self.before = False, codes[state] << 4
        else:
            self.out.append(codes[state] | self.before)
            self.before = 0

    def end(self) -> None:
        """Resolve what is left by the cheapest allowed end."""
        costs, order = self.costs, self.order
        state = EMPTY
        if costs[EMPTY] < 0 or costs[ASSISTANT] >= 0 and (
            costs[ASSISTANT] < costs[EMPTY]
            or costs[ASSISTANT] == costs[EMPTY] and order[4 * ASSISTANT + EMPTY] in (-1, 2)
        ):
            state = ASSISTANT
        states = []
        for parents, _, _ in reversed(self.layers):
            states.append(state)
            state = parents[state] if parents is not None else state
        for state in reversed(states):
            self._emit(state)


def _search(batches):
    """Adds the edit of each row; rows come by conversation and in order."""
    import pyarrow as pa

    waiting: deque = deque()
    out = array("h")
    search, current = None, None

    def ready(all_of_it: bool):
        while waiting and (len(out) >= len(waiting[0]) or all_of_it):
            batch = waiting.popleft()
            n = len(batch)
            code = pa.array(out[:n], pa.int16())
            del out[:n]
            yield pa.RecordBatch.from_arrays([*batch.columns, code], [*batch.schema.names, "code"])

    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        for conv, initial, fault in zip(*(batch.column(k).to_pylist() for k in ("conv", "initial", "fault"))):
            if search is None or conv != current:
                if search is not None:
                    search.end()
                search, current = Search(out), conv
            search.row(initial, fault)
        yield from ready(False)
    if search is not None:
        search.end()
    yield from ready(True)


def find_edits(rows: DataFrame) -> DataFrame:
    """The edit of each distinct row of ``conv, turn, role, text``.

    Columns ``conv, turn, role, sha, copies, initial, fault, code``; ``copies`` equal
    rows are one row here, all but the first of them deleted.
    """
    keyed = rows.select(
        "conv", "turn", "role",
        F.unhex(F.sha2("text", 256)).alias("sha"),
        (~F.col("text").rlike(VISIBLE)).alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("open"),
    )
    distinct = keyed.groupBy("conv", "turn", "role", "sha", "blank", "open").agg(F.count("*").alias("copies"))
    # A turn comes after null, and after all earlier ones.
    seen = distinct.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("sha").alias("s")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))).alias("earliest")
    )
    same = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("sha") == F.col("s"))
    later = ~F.col("turn").eqNullSafe(F.col("earliest.turn"))
    fault = F.when(F.col("blank"), BLANK).when(later, DUPLICATE).when(F.col("open"), TRUNCATED).otherwise(FINE)
    faulty = distinct.join(seen, same).select(
        "conv", "turn", "role", "sha", "copies",
        F.substring("role", 1, 1).alias("initial"), fault.cast("short").alias("fault"),
    )
    ordered = faulty.repartition("conv").sortWithinPartitions("conv", F.asc_nulls_first("turn"), "role", "sha")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(_search, f"{kinds}, {EDITED}")


def _flushed(out: list, schema):
    import pyarrow as pa

    rows = pa.RecordBatch.from_arrays(
        [pa.array([row[k] for row in out], f.type) for k, f in enumerate(schema)], schema=schema
    )
    out.clear()
    return rows


def _merge(batches):
    """Edits and texts of a conversation, in order, to its repaired rows."""
    import pyarrow as pa

    out: list[tuple] = []
    schema, current, pending, held, state = None, (), None, 0, EMPTY

    def insert(n):
        nonlocal state
        for _ in range(n):
            state = MADE[state]
            out.append((conv, None, None, ROLE[state], "", "I", None))

    for batch in batches:
        if schema is None:
            texts = [(n, pa.string()) for n in ("role_before", "role", "text", "edit")]
            own = [("conv", batch.schema.field("conv").type), ("turn", batch.schema.field("turn").type)]
            schema = pa.schema([*own, *texts, ("fault", pa.int16())])
        columns = [batch.column(k) for k in ("conv", "turn", "role", "text", "copies", "fault", "code")]
        for k in range(len(batch)):
            conv, turn, role = (columns[i][k].as_py() for i in (0, 1, 2))
            copies, code = columns[4][k].as_py(), columns[6][k].as_py()
            if role is None:
                # Each conversation begins with a row of its own.
                state = EMPTY
                out.append((conv, None, None, None, None, None, None))
            elif copies is not None:
                pending = (copies, columns[5][k].as_py(), code)
            elif pending is not None:
                # The first text after an edit is the one it belongs to; further ones are copies.
                (copies, fault, code), pending = pending, None
                op = code & 3
                insert(code >> 4)
                made = text = None
                if op != DELETE:
                    text = columns[3][k].as_py()
                    held += len(text)
                    made = role if op == KEEP else ROLE[MADE[state]]
                    state = KEPT[state, role[:1]] if op == KEEP else MADE[state]
                out.append((conv, turn, role, made, text, LETTERS[op], fault))
                for _ in range(copies - 1):
                    out.append((conv, turn, role, None, None, "D", BLANK if fault == BLANK else DUPLICATE))
                    if len(out) >= ROWS_HELD:
                        yield _flushed(out, schema)
                insert(code >> 2 & 3)
            if len(out) >= ROWS_HELD or held > BYTES_HELD:
                yield _flushed(out, schema)
                held = 0
    if out:
        yield _flushed(out, schema)


def _repaired(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """Repaired rows in order, each conversation in one partition and led by a row of nulls."""
    edits = find_edits(rows).select("conv", "turn", "role", "sha", F.lit(None).cast("string").alias("text"),
                                    "copies", "fault", "code")
    nothing = lambda kind: F.lit(None).cast(kind)
    texts = rows.select("conv", "turn", "role", F.unhex(F.sha2("text", 256)).alias("sha"), "text",
                        nothing("long").alias("copies"), nothing("short").alias("fault"), nothing("short").alias("code"))
    leads = everyone.select(
        "conv", *[nothing(f.dataType).alias(f.name) for f in texts.schema if f.name != "conv"]
    ).distinct()
    ordered = (
        texts.unionByName(edits).unionByName(leads)
        .repartition("conv")
        .sortWithinPartitions("conv", F.asc_nulls_first("turn"), F.asc_nulls_first("role"), "sha", F.desc_nulls_last("copies"))
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return ordered.mapInArrow(
        _merge, f"conv {kinds['conv']}, turn {kinds['turn']}, role_before string, role string, text string, edit string, fault short"
    )


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    words = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), words(role).alias("role"), words(text).alias("text")
    )


def repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """One row per edit: ``conv, turn, role_before, role, text, edit, fault``.

    ``edit``: K kept, R another role, D deleted (no role or text after it), I inserted (no
    turn, no role before it). ``fault``: 0 none, 1 blank, 2 duplicate, 3 truncated. Rows of
    a conversation are in one partition and in order; without the deleted ones they are
    the repaired conversation.
    """
    rows = _rows(conversations, conv, turn, role, text)
    return _repaired(rows, rows.select("conv")).where("edit IS NOT NULL").withColumnsRenamed(
        {"conv": conv, "turn": turn, "role": role, "text": text}
    )


def damaged(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """``conv, turn, role, text`` with stated faults. The CRC-32 of ``conv:turn`` modulo 20 says
    which: 0 drops the row, 1 empties its text, 2 takes out the ends of its sentences, 3 repeats
    it, 4 makes it a user's. Nulls count as one space."""
    rows = _rows(conversations, conv, turn, role, text)
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part("conv"), F.lit(":"), part("turn")).cast("binary")) % 20
    rows = rows.withColumn("fate", fate).where("fate <> 0")
    changed = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
    return rows.select(
        "conv", "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        changed.otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


class _Digest:
    def __init__(self):
        self.turns, self.low, self.high = 0, None, None
        self.faults = [0, 0, 0, 0]
        self.illegal, self.cost, self.last = 0, 0, None
        self.audit: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, turn, before, role, text, edit, fault) -> None:
        self.audit.append(edit)
        if edit != "I":
            if turn is not None and turn != self.high:
                self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
            self.faults[fault] += 1
            if self.last is not None and self.last + before[:1] not in ("su", "ua", "au"):
                self.illegal += 1
            self.last = before[:1]
        self.cost += INSERT_COST if edit == "I" else COST[LETTERS.index(edit)]
        if role is not None:
            self.cost += OPEN_COST if fault == TRUNCATED else 0
            self.sha.update((("\n" if self.begun else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            self.begun = True

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        _, blank, duplicate, truncated = self.faults
        return gaps, blank, duplicate, truncated, self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digests(batches):
    import pyarrow as pa

    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    out: list[tuple] = []
    schema, digest, current, held = None, None, None, 0
    for batch in batches:
        if schema is None:
            own = [(n, pa.int64()) for n in names] + [("audit", pa.string()), ("repaired_sha256", pa.string())]
            schema = pa.schema([("conv", batch.schema.field("conv").type), *own])
        columns = [batch.column(k) for k in ("conv", "turn", "role_before", "role", "text", "edit", "fault")]
        for k in range(len(batch)):
            conv, *row = (c[k].as_py() for c in columns)
            if row[4] is not None:
                digest.add(*row)
                continue
            if digest is not None:
                out.append((current, *digest.row()))
                held += len(digest.audit)
            digest, current = _Digest(), conv
            if len(out) >= ROWS_HELD or held > BYTES_HELD:
                yield _flushed(out, schema)
                held = 0
    if digest is not None:
        out.append((current, *digest.row()))
        yield _flushed(out, schema)


def damage_and_repair(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text") -> DataFrame:
    """One row per conversation: its faults after ``damaged``, the edits, and a digest of the repair.

    ``gaps``: turns missing between the first and the last; ``illegal``: neighbours whose
    role initials are not su, ua or au; ``cost`` and ``audit``: of the cheapest edits.
    """
    rows = damaged(conversations, conv, turn, role, text)
    everyone = conversations.select(F.col(conv).alias("conv"))
    kind = rows.schema["conv"].dataType.simpleString()
    return _repaired(rows, everyone).mapInArrow(
        _digests,
        f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
        "audit string, repaired_sha256 string",
    ).withColumnRenamed("conv", conv)
