"""SimHash components, near-duplicate removal and connected components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import components, neardup, simhash


def plain_fingerprint(text, words=3):
    tokens = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        tokens = tokens.replace(space, " ")
    tokens = [t for t in tokens.split(" ") if t]
    if not tokens:
        return 0
    shingles = [" ".join(tokens[i : i + words]) for i in range(len(tokens) - words + 1)] or [" ".join(tokens)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("text", ["", None, "a", "A b", "The the\tTHE the x", "é É e f g h i", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode(), 3) % 2**64 == plain_fingerprint(text)


def test_golay_code_is_perfect():
    patterns, many = simhash.golay_lists()
    assert sorted(set(many.tolist())) == [1, 6] and (many == 1).sum() == 1 + 23 + 253


def test_linked_fingerprints_share_a_key():
    r, lists = np.random.default_rng(1), simhash.golay_lists()
    for _ in range(400):
        a = r.integers(0, 2**63, 1, dtype=np.uint64)
        b = a.copy()
        for bit in r.choice(64, 2, replace=False):
            b ^= np.uint64(1 << int(bit))
        assert set(simhash.golay_keys(a, lists)[1].tolist()) & set(simhash.golay_keys(b, lists)[1].tolist())


@pytest.mark.parametrize("bucket", [0, 48])
def test_links_against_all_pairs(spark, monkeypatch, bucket):
    """With no bucket small enough, all go through one-bit neighbours."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    r = random.Random(bucket)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = list({c ^ sum(1 << b for b in r.sample(range(64), r.randrange(4))) for c in centres for _ in range(25)})
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    found = simhash.links(spark.createDataFrame(list(zip(signed, range(len(fps)), strict=True)), "fp long, rep long")).collect()
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert roots(len(fps), [(x.a, x.b) for x in found]) == roots(len(fps), pairs)
    if bucket:
        assert {(max(x.a, x.b), min(x.a, x.b)) for x in found} == set(pairs)


def test_components_of_texts(spark):
    texts = ["the cat sat on the mat today", "The CAT sat on\tthe mat today", None, "", "  ", "other words stand here now", "one", "one"]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(5, texts[5], 2), (None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = simhash.simhash_components(docs).collect()
    assert len(got) == 9
    assert all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in got)
    assert {r.doc_id: r.component_id for r in got} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 5, 6: 6, 7: 6}
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_connected_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(300, 360)] + [(400, i) for i in range(401, 450)]
    expected = roots(500, edges)
    got = components.connected_components(spark.createDataFrame([*edges, (None, 1), (3, 3)], "a long, b long"))
    assert {x.node: x.root for x in got.collect()} == {i: expected[i] for e in edges if e[0] != e[1] for i in e}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    tokens = (text or "").lower().split()
    return {tuple(tokens[i : i + 5]) for i in range(max(1, len(tokens) - 4))}


def test_near_copies_go_and_others_stay(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, kinds = [], []
    for _ in range(60):
        base = [word() for _ in range(r.choice((30, 120, 400)))]
        texts.append(" ".join(base))
        kinds.append("own")
        near = list(base)
        near[r.randrange(len(near))] = word() if len(near) > 100 else near[0]
        texts += [" ".join(near + [word()]), " ".join(base).upper(), " ".join(base[: len(base) // 2] + [word() for _ in range(len(base) // 2)])]
        kinds += ["near", "copy", "half"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups = {x.doc_id: x.group_id for x in neardup.near_duplicate_groups(docs).collect()}
    for i, kind in enumerate(kinds):
        first = i - i % 4
        a, b = shingles(texts[first]), shingles(texts[i])
        similarity = len(a & b) / len(a | b)
        if kind == "copy" or kind == "near" and similarity >= 0.85:
            assert groups[i] == first, (kind, similarity)
        if kind == "half":
            assert groups[i] == i
    kept = {x.doc_id for x in neardup.keep_one_of_each(docs).collect()}
    assert kept == {i for i in groups if groups[i] == i}


def test_a_large_group_of_copies(spark):
    text = F.concat(F.lit("these are the same words in each copy but for a number "), F.when(F.col("id") < 500, "").otherwise(F.col("id").cast("string")))
    docs = spark.range(600).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("x").alias("digest"))
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == 1


def test_dedup_edges(spark):
    docs = spark.createDataFrame([(0, None), (1, ""), (2, "a"), (2, "a"), (3, "a"), (None, "a")], "doc_id long, text string")
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in neardup.keep_one_of_each(docs).collect()) == [(False, 0), (False, 2)]
    assert neardup.keep_one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("variants", [4, 120])
def test_star_whose_hub_is_not_the_smallest_id(spark, variants):
    """Variants of 0.81 to 0.83 to one original, and of less than 0.8 to each other, go with it."""
    r = random.Random(variants)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(204)]
    texts = []
    for _ in range(variants):
        own = list(base)
        for at in (5 + r.randrange(45), 60 + r.randrange(40), 110 + r.randrange(40), 160 + r.randrange(30)):
            own[at] = word()
        texts.append(" ".join(own))
    texts.insert(variants * 2 // 3, " ".join(base))
    sets = [shingles(t) for t in texts]
    alike = lambda a, b: len(a & b) / len(a | b) >= 0.8
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if alike(sets[i], sets[j])]
    assert {x for p in pairs for x in p} == set(range(len(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.group_id for x in neardup.near_duplicate_groups(docs).collect()} == dict(enumerate(roots(len(texts), pairs)))


def test_long_texts_at_the_bound(spark):
    """Pairs of over 1024 shingles, just above and just below 0.8, are told apart exactly."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    texts, expected = [], []
    for i in range(24):
        base = [word() for _ in range(3004)]
        near = list(base)
        end = 332 if i % 2 else 335  # of 3000 shingles 332 or 335 differ: 2668 of 3332, or 2665 of 3335
        near[:end] = [word() for _ in range(end)]
        texts += [" ".join(base), " ".join(near)]
        a, b = shingles(texts[-2]), shingles(texts[-1])
        expected += [2 * i, 2 * i if len(a & b) / len(a | b) >= 0.8 else 2 * i + 1]
    assert 0 < sum(i != e for i, e in enumerate(expected)) < 24
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [x.group_id for x in sorted(neardup.near_duplicate_groups(docs).collect())] == expected


def test_repeated_and_missing_ids_lose_no_text(spark):
    rows = [(1, "v", "a"), (2, "v", "b"), (2, "u", "c"), (2, "u", "d"), (None, "v", "e"), (None, "w", "f"), (None, "w", "g"), (3, "U", "h"), (4, None, "i"), (5, " ", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumn("first", F.lit(1))
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((x.doc_id or 0, x.text or "") for x in kept.collect()) == [(0, "w"), (1, "v"), (2, "u"), (4, "")]
    groups = Counter((x.doc_id, x.group_id) for x in neardup.near_duplicate_groups(docs).collect())
    assert groups == Counter({(1, 1): 1, (2, 1): 1, (2, 2): 2, (None, 1): 1, (None, None): 2, (3, 2): 1, (4, 4): 1, (5, 4): 1})


@pytest.mark.parametrize("text", [None, "", " A  b\tC ", "x", "É Z\x1f q", "Ab\x0bcD\n"])
def test_digest_in_spark(spark, text):
    row = spark.createDataFrame([(text,)], "text string").select(neardup.digest_column(F.col("text")).alias("d")).first()
    assert bytes(row.d) == neardup.digest_of((text or "").encode().lower().split())


def test_members_of_large_key_groups_meet_by_their_rarest_shingles(spark, monkeypatch):
    """Texts that share a long passage and also have near copies, in groups too large for all pairs."""
    monkeypatch.setattr(neardup, "LARGE", 3)
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage, texts = [word() for _ in range(120)], []
    for _ in range(70):
        own = [word() for _ in range(r.randrange(30, 90))]
        for _ in range(r.randrange(1, 4)):
            near = own + passage
            for _ in range(r.randrange(0, 4)):
                near[r.randrange(len(near))] = word()
            texts.append(" ".join(near))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met = []
    rarest = neardup._rarest
    monkeypatch.setattr(neardup, "_rarest", lambda *a: met.append(1) or rarest(*a))
    assert {x.doc_id: x.group_id for x in neardup.near_duplicate_groups(docs).collect()} == dict(enumerate(roots(len(texts), pairs)))
    assert met


def test_common_hashes(monkeypatch):
    monkeypatch.setattr(neardup, "COUNTED", 9)
    r = np.random.default_rng(2)
    sets = [np.unique(r.integers(0, 30, n)).astype("<u4") for n in (5, 0, 12, 20, 1, 8, 0, 16)]
    outer, other = sets[:3], sets[2:]
    for pick in (outer, outer[::-1]):
        rows = np.concatenate([counts for _, counts in neardup._common(pick, other)])
        assert rows.tolist() == [[len(np.intersect1d(a, b)) for a in pick] for b in other]


@pytest.mark.parametrize(("words", "swaps"), [(110, 9), (2200, 130)])
def test_a_large_group_of_texts_around_the_bound(spark, monkeypatch, words, swaps):
    """Members of one group between 0.5 and 0.95 to each other, in several blocks and parts; those of long texts are in doubt."""
    monkeypatch.setattr(neardup, "BLOCK", 7)
    monkeypatch.setattr(neardup, "PART", 11)
    r = random.Random(14)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, texts = [word() for _ in range(words)], []
    for _ in range(90):
        own = list(base)
        for _ in range(r.randrange(0, swaps)):
            own[r.randrange(words)] = word()
        texts.append(" ".join(own))
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(90) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    expected = roots(90, pairs)
    assert 5 < len(set(expected)) < 70
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {x.doc_id: x.group_id for x in neardup.near_duplicate_groups(docs).collect()} == dict(enumerate(expected))


def test_merged_components(spark):
    r = random.Random(9)
    first, more = ([(r.randrange(200), r.randrange(200)) for _ in range(60)] for _ in range(2))
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    got = components.merge(components.connected_components(pairs(first)), pairs(more))
    expected = roots(200, first + more)
    assert {x.node: x.root for x in got.collect()} == {i: expected[i] for e in first + more if e[0] != e[1] for i in e} | {i: expected[i] for e in more for i in e}


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(components, "HUBS", 6)
    monkeypatch.setattr(components, "SPREAD", 10)
    r = random.Random(3)
    edges = [(0, i) for i in range(1, 90)] + [(200, i) for i in range(80, 150)] + [(r.randrange(300, 360), r.randrange(300, 360)) for _ in range(30)]
    expected = roots(360, edges)
    assert {x.node: x.root for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()} == {i: expected[i] for e in edges if e[0] != e[1] for i in e}
