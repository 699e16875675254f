"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Texts are lower-cased word sequences, whose windows of any length have a Karp-Rabin hash that rolls
from one to the next. The hashes of windows of MIN_MATCH words of a block of benchmark items are
joined with those of each document, in a pass over the documents. Where seeds meet, the document and
the item are tiled: windows of a search length that is halved down to MIN_MATCH are matched by their
rolled hashes, matches are extended, and the longest between unmarked words are marked, again and
again. The share of an item's words that tiles cover does not depend on their order, so a
passage whose sentences were rearranged is still found.

Benchmark items are read in blocks of a bounded number of bytes. One block is sent to the executors
at a time: if there is more than one, what a pass finds is written before the next begins.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard, map_batches, scratch_path, written

MIN_MATCH = 5
THRESHOLD = 0.5
#: Bytes of benchmark text that are broadcast at once.
BLOCK_BYTES = 16 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
PUNCTUATION = ".,;:!?\"'()[]{}«»“”‘’…|*_~<>/\\-—–#%&$"
SCHEMA = "doc_id long, item_id long, covered_words long, item_words long, coverage double, n_tiles long, longest_tile long"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(PUNCTUATION) for x in (text or "").lower().split()) if w]


class Numbers(dict):
    """Raw words to numbers: those of the vocabulary, -1 for others, -2 for bare punctuation."""

    LIMIT = 400_000

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        word = raw.strip(PUNCTUATION)
        number = self[raw] = self.vocabulary.get(word, -1) if word else -2
        return number

    def __reduce__(self):
        return Numbers, (self.vocabulary,)

    def of(self, text: str | None) -> np.ndarray:
        ids = np.array(list(map(self.__getitem__, (text or "").lower().split())), np.int64)
        return ids[ids > -2]


class Rolling:
    """Karp-Rabin hashes, modulo 2^64, of all windows of a sequence of word numbers."""

    _powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def __init__(self, ids: np.ndarray):
        power, self.back = self.powers(len(ids) + 1)
        self.sums = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[: len(ids)], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int) -> list[np.ndarray]:
        """The base's powers and those of its inverse, at least n of each."""
        if len(cls._powers[0]) < n:
            inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
            cls._powers = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, x, np.uint64)])) for x in (BASE, inverse)]
        return cls._powers

    def windows(self, starts: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the windows of k words at the given places."""
        return (self.sums[starts + k] - self.sums[starts]) * self.back[starts]


def _free_windows(blocked: np.ndarray, k: int) -> np.ndarray:
    """Starts of windows of k places none of which is blocked."""
    counts = np.concatenate([[0], np.cumsum(blocked)])
    return np.flatnonzero(counts[k:] == counts[:-k]) if len(blocked) >= k else np.zeros(0, np.int64)


def _runs(doc: np.ndarray, item: np.ndarray, used_doc: np.ndarray, used_item: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Lengths of the matches between unmarked words from places p in doc and q in item."""
    length, alive = np.zeros(len(p), np.int64), np.arange(len(p))
    while len(alive):
        i, j = p[alive] + length[alive], q[alive] + length[alive]
        inside = (i < len(doc)) & (j < len(item))
        alive, i, j = alive[inside], i[inside], j[inside]
        alive = alive[(doc[i] == item[j]) & ~used_doc[i] & ~used_item[j]]
        length[alive] += 1
    return length


#: Pairs of windows that are looked at together.
PAIRS = 1 << 20


def tile(doc: np.ndarray, item: np.ndarray, seeds: np.ndarray, least: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """Greedy string tiles (start in doc, start in item, length); seeds are the starts of all windows
    of doc of the least length that item has as well.

    Among longest matches the one that starts first in the item, then in the document, is marked.
    """
    first = int(seeds.min())
    doc = doc[first : int(seeds.max()) + least]
    n, m = len(doc), len(item)
    seeded = np.zeros(n - least + 1, bool)
    seeded[seeds - first] = True
    used_doc, used_item = np.zeros(n, bool), np.zeros(m, bool)
    hashes, item_hashes = Rolling(doc), Rolling(item)
    tiles: list[tuple[int, int, int]] = []
    size = least << max(0, (min(n, m) // least).bit_length() - 1)
    while size >= least:
        q = _free_windows(used_item, size)
        p = _free_windows(used_doc, size)
        p = p[np.isin(p, _free_windows(~seeded, size - least + 1), assume_unique=True)]
        found: list[tuple[int, int, int]] = []
        if len(p) and len(q):
            own = item_hashes.windows(q, size)
            order = np.argsort(own, kind="stable")
            own, q = own[order], q[order]
            h = hashes.windows(p, size)
            low, many = np.searchsorted(own, h, "left"), np.searchsorted(own, h, "right")
            many -= low
            ends = np.cumsum(many)
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
                count = many[at:to]
                a = np.repeat(p[at:to], count)
                b = q[np.repeat(low[at:to], count) + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)]
                before_a, before_b = np.maximum(a - 1, 0), np.maximum(b - 1, 0)
                start = (a == 0) | (b == 0) | (doc[before_a] != item[before_b]) | used_doc[before_a] | used_item[before_b]
                a, b = a[start], b[start]
                lengths = _runs(doc, item, used_doc, used_item, a, b)
                found += [(-k, y, x) for k, y, x in zip(lengths.tolist(), b.tolist(), a.tolist(), strict=True) if k >= size]
                at = to
        heapify(found)
        while found:
            k, y, x = heappop(found)
            free = ~(used_doc[x : x - k] | used_item[y : y - k])
            if free.all():
                used_doc[x : x - k] = used_item[y : y - k] = True
                tiles.append((first + x, y, -k))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]]))).reshape(-1, 2)
            for a, b in edges[edges[:, 1] - edges[:, 0] >= size].tolist():
                heappush(found, (a - b, y + a, x + a))
        size //= 2
    return tiles


class ItemIndex:
    """Seeds of one block of items; picklable."""

    def __init__(self, items: list[tuple[int, str | None]], least: int):
        self.least = least
        vocabulary: dict[str, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owners = [], []
        for item_id, text in items:
            words = words_of(text)
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int64)
            if not words:
                continue
            if len(ids) < least:
                continue
            h = Rolling(ids).windows(np.arange(len(ids) - least + 1), least)
            owners += [(len(self.items), q) for q in range(len(h))]
            hashes.append(h)
            self.items.append((item_id, ids))
        self.numbers = Numbers(vocabulary)
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, self.owners = every[order], [owners[i] for i in order]

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item_id, covered words, words, tiles) of each item that shares a seed with a text."""
        ids = self.numbers.of(text)
        k = self.least
        if len(ids) < k or not len(self.hashes):
            return
        known = np.concatenate([[0], np.cumsum(ids >= 0)])
        at = np.flatnonzero(known[k:] - known[:-k] == k)
        if not len(at):
            return
        h = Rolling(ids).windows(at, k)
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        seeds: dict[int, list[int]] = defaultdict(list)
        for j in np.flatnonzero(high > low):
            p, last = int(at[j]), -1
            for item, q in self.owners[low[j] : high[j]]:  # by item, then by place in it
                if item != last and (ids[p : p + k] == self.items[item][1][q : q + k]).all():
                    seeds[item].append(p)
                    last = item
        for item in sorted(seeds):
            item_id, words = self.items[item]
            tiles = tile(ids, words, np.array(seeds[item]), k)
            yield item_id, sum(t[2] for t in tiles), len(words), tiles


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """Items one block after another, without holding more than one on the driver; none is empty."""
    block, held = [], 0
    for r in items.toLocalIterator():
        block.append((r.item_id, r.text))
        held += len((r.text or "").encode())
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def _passes(items: DataFrame, block_bytes: int) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """Each block, and whether it is the last."""
    ahead = None
    for block in _blocks(items, block_bytes):
        if ahead is not None:
            yield ahead, False
        ahead = block
    yield ahead or [], True


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, least: int = MIN_MATCH, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A row for each document row and item of whose words tiles cover the threshold's share or more.

    Items of fewer than ``least`` words can't be told from chance and never match; null and empty
    texts match nothing, very long ones are tiled whole. Rows with a null doc_id are left out, repeated rows
    and items give a row each. Other columns are ignored, and an empty table on either side gives an
    empty result.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null and text is not null")

    def passed(index) -> DataFrame:
        def rows(columns: list[list]) -> list[list]:
            out = []
            for doc_id, text in zip(*columns, strict=True):
                for item_id, covered, words, tiles in index.value.matches(text):
                    if covered >= threshold * words:
                        out.append((doc_id, item_id, covered, words, covered / words, len(tiles), max(t[2] for t in tiles)))
            return [list(c) for c in zip(*out, strict=True)] if out else [[] for _ in range(7)]

        return map_batches(source, rows, SCHEMA)

    parts = []
    for block, last in _passes(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id is not null"), block_bytes):
        index = spark.sparkContext.broadcast(ItemIndex(block, least))
        parts.append(passed(index) if last else cut(passed(index)))
        if not last:
            index.destroy()
    return reduce(DataFrame.unionByName, parts)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose text covers no item, all columns kept.

    With several blocks of items, what a pass keeps is written, and deleted after the next.
    """
    spark = docs.sparkSession
    least, threshold = options.get("least", MIN_MATCH), options.get("threshold", THRESHOLD)
    at, schema = docs.columns.index("text"), docs.schema
    held = None
    for block, last in _passes(benchmark.select("item_id", "text"), options.get("block_bytes", BLOCK_BYTES)):
        index = spark.sparkContext.broadcast(ItemIndex(block, least))

        def clean(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not any(c >= threshold * n for _, c, n, _ in index.value.matches(t.as_py())) for t in batch.column(at)], pa.bool_()))

        kept = docs.mapInArrow(clean, schema)
        if last:
            return kept
        path = scratch_path(spark, "decontaminated")
        docs = written(kept, "decontaminated", path)
        index.destroy()
        if held:
            discard(spark, held)
        held = path
    raise AssertionError("there is always a last block")
