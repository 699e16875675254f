"""SimHash near-duplicates, found by Golay-code fuzzy hashing of fingerprint segments.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded to the 23 bits
of the perfect binary Golay code. The list of codewords within four bits of a segment (one of
them, or six) has a member in common for any two segments that differ in at most one bit: the
codeword nearest to one is within four bits of the other. Of two or fewer differing bits, at
least one segment has none while the next (in cyclic order) has at most one, so fingerprints
that link always share a key (segment number, exact segment, codeword index of the next).
Members of a shared key are verified bit by bit.

A key shared by more than BUCKET fingerprints is not paired up. Its members go through all
their one-bit neighbours instead: fingerprints within two bits of each other meet at one of
these, and any that meet there are within two bits, so every link is kept at 65 rows a
fingerprint and no group is larger than 65.
"""

from __future__ import annotations

import itertools

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components
from quire.llm.shared import cut, discard, map_batches, scratch_path, written

SEED = 42
#: Largest key group whose members are compared one by one.
BUCKET = 48
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def fingerprint(text: bytes | None, words: int) -> int:
    """Majority vote of each bit over the XXH64 of all word shingles; 0 without words."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    shingles = zip(*(tokens[i:] for i in range(words)), strict=False) if len(tokens) >= words else iter([tokens])
    total, votes = 0, np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    while chunk := [digest(join(s), SEED) for s in itertools.islice(shingles, 65536)]:
        bits = np.unpackbits(np.array(chunk, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        total += len(chunk)
    return int(np.packbits(votes * 2 > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long). Null and empty texts have fingerprint 0; rows with a null id are left out."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null")

    def rows(columns: list[list]) -> list[list]:
        return [columns[0], [fingerprint(t, words) for t in columns[1]]]

    return map_batches(source, rows, "doc_id long, fp long", binary=("text",))


def _syndrome(v: np.ndarray) -> np.ndarray:
    """Remainder by the generator polynomial."""
    v = v.copy()
    for bit in range(22, 10, -1):
        v ^= np.where(v >> bit & 1, GENERATOR << (bit - 11), 0)
    return v


def golay_lists() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome, the error patterns of weight four or less and how many there are (one or six)."""
    patterns, many = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(23), weight)], np.int64)
        for s, e in zip(_syndrome(errors).tolist(), errors.tolist(), strict=True):
            patterns[s, many[s]] = e
            many[s] += 1
    return patterns, many


def golay_keys(fps: np.ndarray, lists: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Indices into fps and the keys of each fingerprint."""
    patterns, many = lists
    fps = fps.astype(np.uint64)
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    at, keys = [], []
    for i in range(3):
        exact, fuzzy = parts[i], parts[(i + 1) % 3]
        s = _syndrome(fuzzy)
        for k in range(6):
            own = np.flatnonzero(many[s] > k)
            index = (fuzzy[own] ^ patterns[s[own], k]) >> 11
            at.append(own)
            keys.append(i << 40 | exact[own] << 12 | index)
    return np.concatenate(at), np.concatenate(keys)


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(fp, rep) of distinct fingerprints to (a, b): reps of fingerprints within max_bits of each other.

    All links of small key groups are listed; of large ones, enough to keep their components.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("segments are cut for at most two differing bits")
    lists = golay_lists()

    def rows(columns: list[list]) -> list[list]:
        fp, rep = (np.array(c, np.int64) for c in columns)
        at, keys = golay_keys(fp, lists)
        return [keys, fp[at], rep[at]]

    path = scratch_path(prints.sparkSession, "golay")
    keyed = written(map_batches(prints.select("fp", "rep"), rows, "key long, fp long, rep long"), "golay", path)
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(keyed.join(sizes, "key"))
    discard(prints.sparkSession, path)
    near = F.expr(f"filter(g, y -> y.fp > x.fp and bit_count(y.fp ^ x.fp) <= {max_bits})")
    paired = (
        shared.filter(F.col("size") <= BUCKET)
        .groupBy("key")
        .agg(F.collect_list(F.struct("fp", "rep")).alias("g"))
        .select("g", F.explode("g").alias("x"))
        .select("x", F.explode(near).alias("y"))
        .select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    )
    crowd = shared.filter(F.col("size") > BUCKET).select("fp", "rep").distinct()
    flips = "array(fp)" if max_bits < 1 else "concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))"
    if max_bits == 1:
        # fingerprints one bit apart: one is a flip of the other, of which the lower is kept
        meet = crowd.select("rep", F.explode(F.expr("transform(sequence(0, 63), i -> struct(fp & ~shiftleft(1L, i) as at, i as bit))")).alias("k")).select("rep", "k.at", "k.bit")
        by = ["at", "bit"]
    else:
        meet = crowd.select("rep", F.explode(F.expr(flips)).alias("at"))
        by = ["at"]
    first = meet.groupBy(*by).agg(F.min("rep").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    starred = meet.join(first, by).filter("rep != first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
    return paired.unionByName(starred).distinct()


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per input row with an id.

    component_id is the smallest doc_id reachable over links, the row's own included. Equal
    fingerprints are merged before any key is made, so copies cost one row. Null, empty and
    blank texts share fingerprint zero and link like any other; a repeated doc_id gives a row
    each time; very long texts are hashed whole, 65536 shingles at once; an empty table gives an
    empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, words, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(links(distinct, max_bits))
    group = distinct.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(group, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
