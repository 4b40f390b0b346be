"""Conversation repairs against all edit sequences, a plain walk and odd tables."""

import hashlib
import itertools
import random
import re

import pytest

from tallyforge.llm import chat_repair
from tallyforge.llm.chat_repair import FAN, Levels, best_of, block_cells, segments

TURNS = "conv_id long, turn long, role string, text string, kind int, at long"
FORM = re.compile("(s?(ua)+)?$")


def all_edits(symbols, most):
    """(cost, audit) of every sequence of edits with up to `most` insertions in a place that gives a right form."""
    options = []
    for s in symbols:
        keep = [] if s == "d" else [(s.isupper() + 0, "K", s.lower())] + [(2 + s.isupper(), "R", r) for r in "ua"]
        options.append([(3, "D", ""), *keep])
    fills = [(2 * n, "I" * n, "".join(f)) for n in range(most + 1) for f in itertools.product("ua", repeat=n)]
    for chosen in itertools.product(*options):
        for inserts in itertools.product(fills, repeat=len(symbols) + 1):
            parts = [inserts[0], *(x for pair in zip(chosen, inserts[1:]) for x in pair)]
            if FORM.match("".join(p[2] for p in parts)):
                yield sum(p[0] for p in parts), "".join(p[1] for p in parts)


def test_cells_equal_all_edit_sequences():
    for n in range(4):
        for symbols in itertools.product("suaxSd", repeat=n):
            assert best_of(block_cells("".join(symbols))) == min(all_edits(symbols, 2 if n < 3 else 1)), symbols


def walk(symbols):
    """The automaton from left to right, its least (cost, audit) in each state."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}

    def least(states):
        out = {}
        for state, found in states:
            out[state] = min(found, out.get(state, found))
        return out

    def insert(now):
        for _ in range(3):
            now = least([*now.items(), *((q, (c + 2, a + "I")) for s, (c, a) in now.items() for r in "ua" if (q := moves.get((s, r))))])
        return now

    now = insert({"": (0, "")})
    for x in symbols:
        late = x.isupper() + 0
        edits = [("D", 3, None)] + ([] if x == "d" else [("K", late, x.lower()), ("R", 2 + late, "u"), ("R", 2 + late, "a")])
        step = [(s if r is None else moves.get((s, r)), (c + cost, a + e)) for s, (c, a) in now.items() for e, cost, r in edits]
        now = insert(least([p for p in step if p[0] is not None]))
    return min(now[s] for s in ("", "a") if s in now)


@pytest.mark.parametrize("n", [5, FAN, FAN + 1, 63, 64, 65, 130, 700])
def test_long_conversations_equal_a_walk(n):
    rng = random.Random(n)
    for weights in ((1,) * 9, (1, 9, 9, 1, 1, 2, 2, 1, 1)):
        symbols = "".join(rng.choices("suaxSUAXd", weights, k=n))
        assert best_of(block_cells(symbols)) == walk(symbols)
        levels = Levels()
        cuts = [0, *sorted(rng.sample(range(1, n), min(n - 1, 6))), n]
        for a, b in zip(cuts, cuts[1:]):
            levels.add(block_cells(symbols[a:b]))
        cost, audit = best_of(levels.whole())
        assert (cost, audit) == walk(symbols)
        sizes = [b - a for a, b in zip(cuts, cuts[1:])]
        assert "".join(segments(audit, sizes)) == audit and [len(s.replace("I", "")) for s in segments(audit, sizes)] == sizes


def brute(rows):
    """The report of one conversation's (turn, role, text)."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, symbols = set(), [], ""
    for _, role, text in rows:
        last = text.strip(" \t\n\x0b\x0c\r")[-1:]
        kind = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        kinds.append(kind)
        x = role[:1] if role[:1] in ("s", "u", "a") else "x"
        symbols += "d" if kind in ("blank", "duplicate") else x.upper() if kind else x
    cost, audit = walk(symbols)
    at, out, made = 0, [], len(audit.replace("D", "")) % 2
    for e in audit:
        if e != "D":
            expected = "user" if (len(out) - made) % 2 == 0 else "assistant"
            out.append(f"{expected}:" if e == "I" else f"{rows[at][1] if e == 'K' else expected}:{rows[at][2]}")
        at += e != "I"
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed, many=40):
    rng = random.Random(seed)
    rows = [(c, t if rng.random() < 0.95 else None, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None]), rng.choice(["Yes.", "No!", "Why", "", " \n", None, "Long. " * 50, f"Turn {t}.", f"Turn {t}. \t"])) for c in range(many) for t in range(rng.randint(1, 12))]
    rows += [(100, t, "us"[t % 2] and ("user", "assistant")[t % 2], f"Said {t // 3 * 3}.") for t in range(300)] + [(None, 3, "user", "x" * 9000), (None, 3, "user", "x" * 9000), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [1, 3, 64])
def test_repair_equals_brute_force(spark, size):
    rows = conversations(size)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.repair(spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS).repartition(5), size).collect()}
    want = {c: brute([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


def test_repaired_turns_are_those_of_the_digest(spark):
    rows = conversations(9)
    cut = chat_repair.stored(chat_repair.blocks(spark.createDataFrame([(*r, 1, 2) for r in rows], TURNS), 4), "blocks")
    planned = chat_repair.stored(chat_repair.plans(cut), "plans")
    turns, hashes = {}, {r["conv_id"]: r["repaired_sha256"] for r in chat_repair.digests(cut, planned).collect()}
    for r in chat_repair.repaired_turns(cut, planned).orderBy("at", "i").collect():
        turns.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in hashes} == hashes
    assert all(FORM.match("".join(t[0] for t in ts)) for ts in turns.values())


def test_damage_covers_every_conversation(spark):
    rows = [(c, t, ("user", "assistant")[t % 2], f"Say {t}! Now {c}.", 1, 2) for c in range(60) for t in range(1 + c % 3)]
    df = spark.createDataFrame([*rows, (None, None, None, None, 1, 2)], TURNS)
    got = {r["conv_id"]: tuple(r)[1:] for r in chat_repair.damage_and_repair(df).collect()}
    left: dict = {r[0]: [] for r in [*rows, (None,)]}
    import zlib

    for c, t, role, text, *_ in [*rows, (None, None, None, None)]:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = " " if text is None else text
        if kind:
            left[c] += [(t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)] * (2 if kind == 3 else 1)
    assert got == {c: brute(r) for c, r in left.items()}
    assert chat_repair.damage_and_repair(df.limit(0)).count() == 0
