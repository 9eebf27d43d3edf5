"""Conversation repair against all paths of plain Python, with every awkward row."""

import hashlib
import random
import re
from zlib import crc32

import pytest
from recordlens.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, conv string, fate string, edit string, copies string"
FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fate = crc32(key.encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append(
            "blank" if not visible else "duplicate" if (role, text) in seen
            else "truncated" if visible[-1] not in ".!?" else "fine"
        )
        seen.add((role, text))
    return out


def best(rows, kinds):
    """Cheapest edits, ties by the whole string: every state keeps its cheapest whole strings."""
    layer = {"": (0, "", ())}

    def better(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def insert(layer):
        for _ in range(3):
            for state, (cost, audit, made) in list(layer.items()):
                new = "u" if state in ("", "s", "a") else "a"
                better(layer, new, (cost + 2, audit + "I", (*made, ("user:" if new == "u" else "assistant:"))))

    insert(layer)
    for (_, _, role, text), kind in zip(rows, kinds):
        after = {}
        for state, (cost, audit, made) in layer.items():
            better(after, state, (cost + 3, audit + "D", made))
            if kind in ("blank", "duplicate"):
                continue
            more = kind == "truncated"
            if role[:1] and role[:1] in FOLLOWS[state]:
                better(after, role[:1], (cost + more, audit + "K", (*made, f"{role}:{text}")))
            new = "u" if state in ("", "s", "a") else "a"
            line = f"{'user' if new == 'u' else 'assistant'}:{text}"
            better(after, new, (cost + 2 + more, audit + "R", (*made, line)))
        insert(after)
        layer = after
    return min((layer[s] for s in ("", "a") if s in layer), key=lambda w: w[:2])


def brute(rows):
    out = {}
    whole = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in whole if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        kinds = faults(own)
        cost, audit, made = best(own, kinds)
        turns = [r[1] for r in own if r[1] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(made).encode()).hexdigest(),
        )
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], SCHEMA).repartition(3)


def random_rows(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        kind = r.choice(["mixed", "users", "alternate", "odd"])
        for turn in range(r.randint(0, longest)):
            role = {
                "users": "user", "alternate": "user" if turn % 2 else "assistant",
                "mixed": r.choice(["user", "assistant", "system"]),
                "odd": r.choice(["user", "assistant", "", None, "tool", "User", "uncle"]),
            }[kind]
            at = r.choice([turn, turn, turn, turn + 2, None, 0])
            text = r.choice(["yes.", "no", f"t{turn}!", f"t{turn}", "", None, " \t", "é?", f"long {turn}. \n"])
            rows.append((conv, at, role, text))
    return rows


def collected(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_repair_equals_brute_force(spark, seed):
    rows = random_rows(seed, 120, 14) + [(None, None, None, None), (None, 3, "user", "a."), (None, 3, "user", "a.")]
    got = C.damage_and_repair(frame(spark, rows))
    assert got.count() == len({r[0] for r in rows})
    assert collected(got) == brute(rows)


def test_a_long_hot_conversation_and_repeated_rows(spark):
    rows = [(7, t, "user", f"text {t}.") for t in range(3000)] + [(7, 5, "assistant", "same.")] * 500
    rows += [(8, t, "user" if t % 2 == 0 else "assistant", f"text {t}." + " w" * 20_000 * (t == 4) + ".") for t in range(9)]
    assert collected(C.damage_and_repair(frame(spark, rows))) == brute(rows)


def test_search_alone_on_many_random_rows():
    from array import array

    r = random.Random(5)
    kinds = ["fine", "blank", "duplicate", "truncated"]
    for _ in range(3000):
        n = r.randint(0, 12)
        rows = [(1, t, r.choice(["user", "assistant", "system", "tool", ""]), "x") for t in range(n)]
        marks = [r.choice(kinds) if r.random() < 0.4 else "fine" for _ in rows]
        out = array("h")
        search = C.Search(out)
        for row, mark in zip(rows, marks):
            search.row(row[2][:1], kinds.index(mark))
        search.end()
        audit = ""
        for k, code in enumerate(out):
            audit += "I" * (code >> 4) + C.LETTERS[code & 3] + "I" * (code >> 2 & 3)
        assert audit == best(rows, marks)[1], (rows, marks)


def test_edits_leave_once_survivors_share_an_ancestor():
    from array import array

    out = array("h")
    search = C.Search(out)
    for t in range(10_000):
        search.row("ua"[t % 2], C.FINE)
        assert len(search.layers) < 16
    assert len(out) > 9_990


def test_repair_returns_rows_in_order(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "a."), (2, 0, "tool", "t."),
            (2, 1, "assistant", "b"), (3, 0, " ", " ")]
    got = [tuple(r) for r in C.repair(frame(spark, rows)).coalesce(1).collect()]
    by = {c: [r[1:] for r in got if r[0] == c] for c in (1, 2, 3)}
    assert [r[4] for r in by[1]] == ["K", "I", "K", "D"]
    assert by[1][1] == (None, None, "user", "", "I", None)
    assert by[2] == [(0, "tool", "user", "t.", "R", 0), (1, "assistant", "assistant", "b", "K", 3)]
    assert by[3] == [(0, " ", None, None, "D", 1)]


def test_repair_on_an_empty_table(spark):
    empty = frame(spark, [(1, 1, "user", "a.")]).limit(0)
    assert C.damage_and_repair(empty).count() == 0
    assert C.repair(empty).count() == 0
