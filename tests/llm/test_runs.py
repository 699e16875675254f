"""Periodic runs against plain comparison at every period, and the edge cases of the operator."""

import hashlib
import random

import numpy as np
import pytest

from quire.llm import runs


def plain(words, least=6, powers=4):
    """Runs by comparing each word with that p further on, for every p."""
    found = {}
    for p in range(1, len(words) // powers + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, powers * p):
                found.setdefault((i, j + p), p)
            i = max(i + 1, j)
    return sorted((start, end - start, p) for (start, end), p in found.items())


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_runs_equal_plain_comparison(letters):
    rng = random.Random(letters)
    for _ in range(300):
        words = [rng.randrange(letters) for _ in range(rng.randrange(60))]
        if len(words) > 8 and rng.random() < 0.7:
            a = rng.randrange(len(words))
            p = 1 + rng.randrange(max(1, (len(words) - a) // 4))
            words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, len(words))), *(rng.randrange(letters) for _ in range(rng.randrange(20)))]
        for least, powers in ((6, 4), (1, 4), (6, 5), (12, 7)):
            assert runs.find_runs(np.array(words, np.int64), least, powers) == plain(words, least, powers)
        kept, found = set(range(len(words))), plain(words)
        for start, length, p in found:
            kept -= set(range(start + p, start + length))
        assert np.flatnonzero(runs.collapsed(len(words), found)).tolist() == sorted(kept)


def test_squares_of_squares_keep_the_smallest_period():
    assert runs.find_runs(np.array([1, 2] * 40)) == [(0, 80, 2)]
    assert runs.find_runs(np.zeros(5000, np.int64)) == [(0, 5000, 1)]


def test_fibonacci_words_hold_no_fourth_power():
    a, b = [0], [0, 1]
    while len(b) < 3000:
        a, b = b, b + a
    assert runs.find_runs(np.array(b)) == []


def test_the_period_must_fit_four_times():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(9, np.int64), powers=3)


def test_general_form_keeps_columns_and_rows(spark):
    docs = spark.createDataFrame(
        [(1, "a b a b a b a b c", "x"), (1, "a b a b a b a b c", "x"), (None, None, None), (2, "", "y"), (3, " \t\n", "z"), (4, "é " * 7, None)], "doc_id long, text string, Runs string"
    )
    got = [r.asDict(recursive=True) for r in runs.periodic_runs(docs).collect()]
    assert sorted(got[0]) == ["Runs", "_runs", "collapsed", "doc_id", "text"]
    by = sorted((r["doc_id"] or 0, r["Runs"], [tuple(x.values()) for x in r["_runs"]], r["collapsed"]) for r in got if r["doc_id"] != 4)
    assert by == [(0, None, [], ""), (1, "x", [(0, 8, 2)], "a b c"), (1, "x", [(0, 8, 2)], "a b c"), (2, "y", [], ""), (3, "z", [], "")]
    assert [r["collapsed"] for r in got if r["doc_id"] == 4] == ["é"]
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def test_digests_of_edge_rows(spark):
    import zlib

    seeded = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    words = [f"w{i}" for i in range(50)]
    docs = spark.createDataFrame([(None, None, "e"), (None, "z " * 8, "e"), (seeded, " ".join(words), "e"), (seeded, "", "e")], "doc_id long, text string, n_runs string")
    got = {(r.doc_id, r.n_runs): r for r in runs.describe(docs).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert (got[None, 0].start, got[None, 0].runs_sha256, got[None, 0].collapsed_sha256) == (None, empty, empty)
    assert got[None, 1].runs_sha256 == hashlib.sha256(b"0,8,1\n").hexdigest() and got[None, 1].exponent_milli == 8000
    assert (seeded, 0) in got
    changed = runs.seeded(words, seeded)
    found = plain(changed)
    top = next(r for r in got.values() if r.doc_id == seeded and r.collapsed_sha256 != empty)
    assert changed != words and top.n_runs == len(found) and (not found or (top.start, top.length, top.period) == found[0])
