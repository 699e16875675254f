"""Near-duplicate removal: SimHash fuzzy keys, widened to a stated similarity of word shingles.

``simhash.py`` finds fingerprints within two bits. Texts whose sets of five-word shingles have a
Jaccard similarity of 0.8 differ in nine of 64 bits in the middle and in more than fourteen at
times, which no set of Golay keys reaches without pairing a fixed share of all documents. The
removal here therefore keys each distinct text by its Golay keys and also by bands of its least
shingle hashes, and verifies every candidate pair by Jaccard similarity over the 1024 least
shingle hashes of either text. Where a text has more, that is an estimate with a standard error of
0.0125 at 0.8, and pairs within five of these of the bound are settled over all shingle hashes of
the two texts.

Each member of a key's group is first held against the group's two centres (the smallest node, and
the smallest under a hash that depends on the key), then against the member with the most links so
far. Members that are still in different components are then held against each other block by block,
and one link is kept of each two components. Those of very large groups are keyed anew first, by their rarest
shingles: two sets of similarity 0.8 can't do without a common one among the fifth of each that is
rarest, so no pair is lost, and texts that share only a common passage don't meet.

The unit is a distinct text, whatever ids its rows have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.components import connected_components, merge
from quire.llm.shared import cut, discard, map_batches, release, scratch_path, unused, written
from quire.llm.simhash import SEED, golay_keys, golay_lists

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS, LEAST = 16, 4, 1024
#: Five standard errors of a truncated sketch: estimates as near to the bound are settled exactly.
DOUBT = 0.0625
#: Members of a key group beyond which they are keyed anew; of a block, and of a part that it is held against.
LARGE, BLOCK, PART = 4096, 512, 2048
#: Common hashes that are counted at once.
COUNTED = 1 << 19
LINK = "a long, b long, size_a long, size_b long, doubt boolean"
#: Digests that a task remembers, so that the copies it meets are keyed once.
SEEN = 200_000
SIGNED = "doc_id long, digest binary, sketch binary, size long, keys array<long>"


def digest_of(tokens: list[bytes]) -> bytes:
    return hashlib.md5(b" ".join(tokens), usedforsecurity=False).digest()


def digest_column(text: Column) -> Column:
    """What digest_of gives for the words of a text, in Spark."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.unhex(F.md5(F.trim(F.regexp_replace(lowered, r"[\x20\x09-\x0D]+", " ")).cast("binary")))


def shingle_hashes(tokens: list[bytes], words: int) -> np.ndarray:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(tokens) < words:
        return np.array([digest(join(tokens), SEED)] if tokens else [], np.uint64)
    return np.fromiter((digest(join(s), SEED) for s in zip(*(tokens[i:] for i in range(words)), strict=False)), np.uint64)


def signature(tokens: list[bytes], words: int, lists) -> tuple[bytes, int, list[int]]:
    """Sketch, number of distinct shingles, and keys of a text."""
    h = shingle_hashes(tokens, words)
    if not len(h):
        return b"", 0, []
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = h[at : at + 65536]
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    fp = np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")
    golay = (golay_keys(fp.view(np.int64), lists)[1] | 1 << 50).tolist()
    u = np.unique(h)
    sketch = np.unique((u * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype("<u4")[:LEAST]
    # bands: least hash in each of 64 bins; an empty bin takes the next one's
    shift = np.uint64(58)
    own = (u >> shift).astype(np.int64)
    lead = np.flatnonzero(np.diff(own, prepend=-1))
    take = np.searchsorted(own[lead], np.arange(BANDS * ROWS)) % len(lead)
    least = u[lead[take]].reshape(BANDS, ROWS)
    bands = [xxhash.xxh64_intdigest(row.tobytes(), i) for i, row in enumerate(least)]
    return sketch.tobytes(), len(u), golay + [b - (1 << 64) if b >> 63 else b for b in bands]


def similar(a: bytes, b: bytes) -> float:
    """Jaccard similarity of two sketches: of the least hashes of their union, the share in both."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    every = np.concatenate([x, y])
    every.sort(kind="stable")
    twice = every[1:][every[1:] == every[:-1]]
    union = len(every) - len(twice)
    if union > LEAST and max(len(x), len(y)) == LEAST:
        edge = np.unique(every)[LEAST - 1]
        return float((twice <= edge).sum()) / LEAST
    return len(twice) / union if union else 1.0


def _signed(docs: DataFrame, words: int, path: str) -> DataFrame:
    """A row for each row of docs; the sketch and the keys of a text come once in a task, and are null beside its other copies."""
    lists, seen = golay_lists(), set()

    def rows(columns: list[list]) -> list[list]:
        out: list[list] = [[], [], [], []]
        for text in columns[1]:
            tokens = (text or b"").lower().split()
            digest = digest_of(tokens)
            if digest in seen:
                own = (None, None, None)
            else:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(digest)
                own = signature(tokens, words, lists)
            for column, value in zip(out, (digest, *own), strict=True):
                column.append(value)
        return [columns[0], *out]

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(map_batches(source, rows, SIGNED, binary=("text",)), "signatures", path)


def _slices(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, slice, hashes): all distinct shingle hashes of the wanted (digest, node, first), cut by their first bits."""

    def rows(columns: list[list]) -> list[list]:
        out: list[list] = [[], []]
        for text in columns[0]:
            tokens = (text or b"").lower().split()
            u = np.unique(shingle_hashes(tokens, words))
            cuts = np.searchsorted(u >> np.uint64(59), np.arange(33))
            out[0].append(digest_of(tokens))
            out[1].append([u[i:j].astype("<u8").tobytes() for i, j in zip(cuts, cuts[1:], strict=False)])
        return out

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = source.join(wanted.select(F.col("first").alias("doc_id")), "doc_id", "left_semi").unionByName(source.filter("doc_id is null")).select("text")
    hashed = map_batches(texts, rows, "digest binary, parts array<binary>", binary=("text",)).join(wanted.select("digest", "node"), "digest")
    return hashed.select("node", F.posexplode("parts").alias("slice", "hashes")).filter("length(hashes) > 0").dropDuplicates(["node", "slice"])


def _exactly(pairs: DataFrame, slices: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b, size_a, size_b) that are similar by all their shingle hashes."""
    sided = pairs.select("a", "b").join(slices.toDF("a", "slice", "ha"), "a").join(slices.toDF("b", "slice", "hb"), ["b", "slice"]).select("a", "b", "ha", "hb")

    def both(columns: list[list]) -> list[list]:
        n = [len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)) for x, y in zip(*columns[2:], strict=True)]
        return [*columns[:2], n]

    shared = map_batches(sided, both, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    return pairs.join(shared, ["a", "b"]).filter(F.col("n") >= F.lit(similarity) * (F.col("size_a") + F.col("size_b") - F.col("n")) - 1e-6).select("a", "b")


def _judge(sa: bytes, sb: bytes, na: int, nb: int, similarity: float) -> tuple[bool, bool]:
    """Whether two texts are similar by their sketches, and whether that is in doubt."""
    found = similar(sa, sb)
    return found >= similarity, max(na, nb) > LEAST and abs(found - similarity) <= DOUBT


def _linked(pairs: DataFrame, sketches: DataFrame, similarity: float, settle) -> DataFrame:
    """Those of the pairs (a, b) whose texts are similar."""
    known = ("node", "sketch", "size")
    sided = pairs.join(sketches.select(*known).toDF("a", "sa", "na"), "a").join(sketches.select(*known).toDF("b", "sb", "nb"), "b").select("a", "b", "na", "nb", "sa", "sb")

    def verify(columns: list[list]) -> list[list]:
        kept = []
        for a, b, na, nb, sa, sb in zip(*columns, strict=True):
            alike, doubt = _judge(sa, sb, na, nb, similarity)
            if doubt or alike:
                kept.append((a, b, na, nb, doubt))
        return [list(c) for c in zip(*kept, strict=True)] if kept else [[] for _ in range(5)]

    return settle(map_batches(sided, verify, LINK))


def _common(outer: list[np.ndarray], other: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many hashes each sketch of other shares with each of outer: rows of counts from a place on."""
    values = np.concatenate(outer)
    owners = np.repeat(np.arange(len(outer)), list(map(len, outer)))
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    at = 0
    while at < len(other):
        to, size, spans = at, 0, []
        while to < len(other) and (size < COUNTED or to == at):
            low, high = np.searchsorted(values, other[to], "left"), np.searchsorted(values, other[to], "right")
            spans.append((low, high - low))
            size += int((high - low).sum())
            to += 1
        low, many = (np.concatenate(x) for x in zip(*spans, strict=True))
        rows = np.repeat(np.arange(to - at), list(map(len, other[at:to])))
        place = np.repeat(low - np.cumsum(many) + many, many) + np.arange(size)
        yield at, np.bincount(np.repeat(rows, many) * len(outer) + owners[place], minlength=(to - at) * len(outer)).reshape(to - at, len(outer))
        at = to


def _block_links(apart: DataFrame, sketches: DataFrame, similarity: float, settle) -> DataFrame:
    """Links between members of a group that are of different components: one of each two components in a block.

    Those outside the group's main component are dealt into blocks, which all members meet in parts, so
    a large group is spread over many tasks and none holds more than a block and a part.
    """
    blocks, parts = F.ceil((F.col("n") - F.col("most")) / BLOCK).cast("long"), F.ceil(F.col("n") / PART).cast("long")
    dealt = lambda many, salt: F.pmod(F.xxhash64("node", F.lit(salt)), many)
    each = lambda many: F.explode(F.sequence(F.lit(0).cast("long"), many - 1))
    held = apart.join(sketches.select("node", "sketch"), "node")
    columns = ("node", "size", "comp", "sketch")
    outer = held.filter("comp != main").select("key", dealt(blocks, "block").alias("block"), each(parts).alias("part"), *columns)
    every = held.select("key", each(blocks).alias("block"), dealt(parts, "part").alias("part"), *columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: dict[tuple[int, int], tuple] = {}
        unsure = []
        x, y = ([t.column(c).to_pylist() for c in columns] for t in (left, right))
        if x[0] and y[0]:
            sizes, comps = np.array(x[1]), np.array(x[2])
            outer, other = ([np.frombuffer(b, "<u4") for b in t[3]] for t in (x, y))
            lengths = np.array(list(map(len, outer)))
            for at, counts in _common(outer, other):
                for j, row in enumerate(counts, at):
                    n = len(other[j])
                    whole = (sizes <= LEAST) & (y[1][j] <= LEAST)
                    near = np.where(whole, row / (lengths + n - row) >= similarity, row >= (similarity - 2 * DOUBT) * np.minimum(lengths, n))
                    for i in np.flatnonzero(near & (comps != y[2][j])).tolist():
                        two = (min(x[2][i], y[2][j]), max(x[2][i], y[2][j]))
                        if two in found:
                            continue
                        link = (x[0][i], y[0][j], x[1][i], y[1][j])
                        if whole[i]:
                            found[two] = (*link, False)
                            continue
                        alike, doubt = _judge(x[3][i], y[3][j], x[1][i], y[1][j], similarity)
                        if doubt:
                            unsure.append((two, (*link, True)))
                        elif alike:
                            found[two] = (*link, False)
        rows = [*found.values(), *(link for two, link in unsure if two not in found)]
        kinds = [pa.int64()] * 4 + [pa.bool_()]
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["a", "b", "size_a", "size_b", "doubt"])

    outer = outer.toDF("own_key", "own_block", "own_part", *columns)
    met = outer.groupBy("own_key", "own_block", "own_part").cogroup(every.groupBy("key", "block", "part")).applyInArrow(meet, LINK)
    return settle(met)


def _ordered(met: DataFrame, similarity: float) -> DataFrame:
    """(node, size, c, c_size) to distinct (a, b), without those whose sizes alone rule them out."""
    fits = F.least("size", "c_size") >= F.greatest("size", "c_size") * F.lit(similarity - 1e-9)
    return met.filter((F.col("node") != F.col("c")) & fits).select(F.least("node", "c").alias("a"), F.greatest("node", "c").alias("b")).distinct()


def _apart(crowd: DataFrame, components: DataFrame) -> DataFrame:
    """Members, with their component so far, of the key groups that hold more than one component."""
    placed = crowd.join(components, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("comp"))
    counts = placed.groupBy("key", "comp").agg(F.count("*").alias("n"))
    split = counts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most")).filter("n > most")
    return cut(placed.join(cut(split), "key"))  # written first, so that a large group's rows can be split up


def _hub_pairs(apart: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Each member with the member of its group that has the most links so far, if that is of another component."""
    degrees = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    hubs = apart.join(degrees, "node").groupBy("key").agg(F.max_by(F.struct("node", "size", "comp"), F.struct("degree", "node")).alias("hub"))
    met = apart.join(cut(hubs), "key").filter("comp != hub.comp")
    return _ordered(met.select("node", "size", F.col("hub.node").alias("c"), F.col("hub.size").alias("c_size")), similarity)


def _rarest(members: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """(key, node, size): members (node, size) keyed by those of their shingles that are rarest among them.

    Of two sets whose similarity is s, each shares at least the share s of its own members with the
    other. So in any common order their first parts, one longer than what may differ, meet; of truncated
    sketches the part is longer by what the estimate may err.
    """

    def rows(columns: list[list]) -> list[list]:
        return [*columns[:2], [np.frombuffer(x, "<u4").tolist() for x in columns[2]]]

    held = members.select("node", "size").distinct().join(sketches.select("node", "sketch"), "node")
    each = map_batches(held.select("node", "size", "sketch"), rows, "node long, size long, hashes array<long>").select("node", "size", F.explode("hashes").alias("key"))
    counts = each.groupBy("key").agg(F.count("*").alias("n"))
    ordered = each.join(counts, "key").groupBy("node", "size").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("own"))  # at most LEAST of them
    share = F.when(F.col("size") <= int(similarity * LEAST), F.lit(similarity)).otherwise(F.lit(similarity - DOUBT))
    many = F.size("own")
    first = F.slice("own", F.lit(1), (many - F.ceil(share * many - 1e-9) + 1).cast("int"))
    return ordered.select("node", "size", F.explode(first).alias("k")).select("k.key", "node", "size")


def _components(docs: DataFrame, signed: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, root) of the texts that have a near duplicate."""
    keyed = texts.select("node", "size", F.explode(F.array_distinct("keys")).alias("key"))
    one = lambda by: F.min_by(F.struct("node", "size"), by)
    centres = keyed.groupBy("key").agg(one(F.col("node")).alias("c1"), one(F.xxhash64("node", "key")).alias("c2"), F.count("*").alias("many")).filter("many > 1")
    shared = cut(keyed.join(cut(centres), "key"))  # centres are written first, so that a large group's rows can be split up
    met = shared.select("node", "size", F.explode(F.array("c1", "c2")).alias("c")).select("node", "size", F.col("c.node").alias("c"), F.col("c.size").alias("c_size"))
    pairs = cut(_ordered(met, similarity))
    ends = texts.select("digest", "node", "size", "first").join(shared.select("node").distinct(), "node", "left_semi")
    sketches = cut(signed.filter("sketch is not null").select("digest", "sketch").join(ends, "digest").dropDuplicates(["node"]))
    del keyed, centres, met, ends
    release(docs.sparkSession)

    def settled(judged: DataFrame) -> DataFrame:
        """(a, b) of links, those in doubt settled over all hashes of the two texts."""
        judged = cut(judged)
        sure, doubtful = judged.filter("not doubt").select("a", "b"), judged.filter("doubt").drop("doubt").distinct()
        if doubtful.isEmpty():
            return sure
        long = doubtful.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        slices = cut(_slices(docs, sketches.select("digest", "node", "first").join(long, "node", "left_semi"), words))
        return cut(sure.unionByName(_exactly(doubtful, slices, similarity)))

    links = _linked(pairs, sketches, similarity, settled)
    components = cut(connected_components(links))
    # up to three members, the centres meet all others; larger groups go on until all components have met
    apart = _apart(shared.filter("many > 3").select("key", "node", "size"), components)
    if apart.isEmpty():
        return components
    components = merge(components, _linked(_hub_pairs(apart, links, similarity), sketches, similarity, settled))
    apart = _apart(apart.select("key", "node", "size"), components)
    if apart.isEmpty():
        return components
    components = merge(components, _block_links(apart.filter(F.col("n") <= LARGE), sketches, similarity, settled))
    large = apart.filter(F.col("n") > LARGE)
    if large.isEmpty():
        return components
    return merge(components, _block_links(_apart(_rarest(large, sketches, similarity), components), sketches, similarity, settled))


def _grouped(docs: DataFrame, words: int, similarity: float, path: str) -> tuple[DataFrame, DataFrame]:
    """signed rows, and (digest, root, first) of each distinct text, first being its smallest doc_id."""
    signed = _signed(docs, words, path)
    gathered = signed.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), F.first("keys", ignorenulls=True).alias("keys"))
    texts = cut(gathered.withColumn("node", F.monotonically_increasing_id()))
    del gathered
    release(docs.sparkSession)
    components = _components(docs, signed, texts, words, similarity)
    placed = texts.select("digest", "first", "node").join(components, "node", "left")
    return signed, cut(placed.select("digest", F.coalesce("root", "node").alias("root"), "first"))


def near_duplicate_groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, group_id) for every row: group_id is the smallest doc_id of the row's near duplicates.

    Texts with the same words (A-Z lower-cased, white space aside) are one; blank and null texts
    are all the same. Rows are grouped by their texts alone, so one id may be in several groups. A
    null id has its text's group and is no group's smallest unless there is no other, which gives a null
    group_id. Other columns don't matter and an empty table gives an empty result.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    try:
        signed, texts = _grouped(docs, words, similarity, path)
        ids = texts.groupBy("root").agg(F.min("first").alias("group_id"))
        return cut(signed.select("doc_id", "digest").join(texts.join(ids, "root").select("digest", "group_id"), "digest").select("doc_id", "group_id"))
    finally:
        discard(spark, path)


def keep_one_of_each(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id.

    Of several rows with that id and text any one stays, and a row without an id only where its group
    has no other. An id that stands on several texts is judged by each of them. Columns pass
    through whatever their names; very long texts are compared whole.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "signatures")
    try:
        signed, texts = _grouped(docs, words, similarity, path)
        keepers = texts.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "digest")).alias("k")).select("k.digest", "k.first")
        flagged = signed.select("doc_id", "digest").join(keepers, "digest", "left").select("doc_id", F.coalesce(F.col("first") == F.col("doc_id"), F.lit(False)).alias("kept"))
        ids = cut(flagged.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("not kept or n > 1 or doc_id is null"))
    finally:
        discard(spark, path)
    clean = docs.filter("doc_id is not null").join(ids.filter("doc_id is not null").select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    tangled = ids.filter("doc_id is null or (n > 1 and kept)")
    if tangled.isEmpty():
        return clean
    # rows without an id, and those that share one: told apart by their texts
    digest, first = unused(docs.columns, "digest"), unused(docs.columns, "first")
    rows = docs.filter("doc_id is null").unionByName(docs.join(tangled.select("doc_id"), "doc_id", "left_semi").select(docs.columns)).withColumn(digest, digest_column(F.col("text")))
    mine = rows.join(keepers.select(F.col("digest").alias(digest), F.col("first").alias(first)), digest).filter(F.col(first).eqNullSafe(F.col("doc_id").cast("long")))
    return clean.unionByName(mine.dropDuplicates([digest]).select(docs.columns))
