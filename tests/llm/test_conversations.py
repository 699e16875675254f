"""Conversation repair against a search over all edits, and long conversations against short ones."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from quire.llm import conversations as c


def edits(turns):
    """The cheapest (cost, audit, repaired) over every sequence of edits; turns are (role, text, fault)."""
    best = None
    for marks in itertools.product("DKRS", repeat=len(turns)):
        if any(f in (1, 2) and m != "D" for m, (_, _, f) in zip(marks, turns, strict=True)):
            continue
        cost = sum(3 if m == "D" else (f == 3) + (m != "K") * 2 for m, (_, _, f) in zip(marks, turns, strict=True))
        for spots in itertools.product(("", "I", "J", "IJ"), repeat=len(turns) + 1):
            said, audit = [], ""
            for spot, mark, turn in itertools.zip_longest(spots, marks, turns):
                said += [("user" if x == "I" else "assistant", "") for x in spot]
                audit += "I" * len(spot)
                if mark:
                    audit += mark.replace("S", "R")
                    if mark != "D":
                        said.append(({"K": turn[0], "R": "user", "S": "assistant"}[mark], turn[1]))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r[:1] in ("s", "u", "a") else "x" for r, _ in said)):
                key = (cost + 2 * sum(map(len, spots)), audit, said)
                best = min(best or key, key)
    return best


def plain(rows):
    """The contract's result of one conversation's damaged (turn, role, text), in order."""
    flagged, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        flagged.append((role, text, fault))
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(flagged))
    cost, audit, said = edits(flagged)
    return (gaps, *(sum(f == i for _, _, f in flagged) for i in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest())


def damaged(conv_id, rows):
    out = []
    for turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def results(frame):
    return {r.conv_id: (*(r[x] for x in c.COUNTS), r.cost, r.audit, r.repaired_sha256) for r in frame.collect()}


SCHEMA = "conv_id long, turn long, role string, text string, Alive string"


@pytest.fixture(scope="module")
def small():
    rng = random.Random(5)
    roles, texts = ["user", "user", "assistant", "assistant", "system", "tool", "", None, "sly", "User"], ["Yes.", "Yes.", "No", "Why?\n", " \t", "", None, "a:b!"]
    made = {i: [(rng.choice([k, k, k + 1, None]), rng.choice(roles), rng.choice(texts)) for k in range(rng.randrange(1, 5))] for i in range(150)}
    made[None] = [(0, "user", "Hi."), (None, "assistant", "Hello.")]
    return made


def test_repair_equals_a_search_over_all_edits(spark, small):
    # not every conversation fits such a search after its repeats
    wanted = {i: plain(rows) for i, r in small.items() if len(rows := damaged(i, r)) < 5}
    turns = spark.createDataFrame([(i, *r, "x") for i, rows in small.items() for r in rows], SCHEMA)
    got = results(c.describe(turns))
    assert got.keys() == small.keys() and len(wanted) > 120
    assert {i: got[i] for i in wanted} == wanted


@pytest.mark.parametrize("most", [2, 3])
def test_long_conversations_are_repaired_as_short_ones(spark, small, most):
    rng = random.Random(6)
    long = {900: [(k, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"{k}!", "", f"{k}?"])) for k in range(150 * most)], 901: [(None, "user", "Hi.")] * 9}
    dropped = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    long[dropped] = [(1, "user", "Gone.")] * 5
    turns = spark.createDataFrame([(i, *r, "x") for i, rows in (small | long).items() for r in rows], SCHEMA)
    short = results(c.describe(turns))
    assert short[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert results(c.describe(turns.repartition(7), most_turns=most)) == short


def test_large_texts_take_the_long_way(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x" * 5000 + ".", None), (1, 1, "assistant", "y.", None), (2, 0, "user", "z.", None)], SCHEMA)
    assert results(c.describe(turns, most_bytes=1000)) == results(c.describe(turns))


def test_empty_table(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert c.describe(none).count() == 0 and c.repaired_turns(none).count() == 0


def test_repaired_turns_are_rows(spark):
    turns = spark.createDataFrame([(1, 0, "system", "S.", None), (1, 1, "assistant", "a:b.", None), (1, 2, "tool", "t.", None), (1, 3, "user", "", None)], SCHEMA)
    got = [tuple(r)[1:] for r in c.repaired_turns(turns).orderBy("place").collect()]
    _, _, said = edits([("system", "S.", 0), ("assistant", "a:b.", 0), ("tool", "t.", 0), ("user", "", 1)])
    assert got == [(k + 1, *x) for k, x in enumerate(said)]


def test_repaired_turns_of_long_conversations(spark, small):
    turns = spark.createDataFrame([(i, *r, "x") for i, rows in small.items() for r in rows], SCHEMA)
    rows = lambda frame: sorted(((r.conv_id is not None, r.conv_id or 0, r.place, r.role, r.text) for r in frame.collect()))
    assert rows(c.repaired_turns(turns, most_turns=1)) == rows(c.repaired_turns(turns))
