"""Exact top-k inner products: candidates by descending length, SVD-rotated partial sums.

Vectors become integers, floor(256 x), and are written once, dealt out by falling length. The
longest of them, a bounded number, give each query a first k-th best score, below which nothing is
ever sent on. An orthogonal rotation, fitted by SVD on those longest (any rotation gives exact
results; this one only makes partial sums telling), turns vectors so that the first coordinates
carry most of the product. A candidate block, sorted by length, is given up for a query when the
product of lengths is below the query's k-th best score so far; otherwise partial sums plus the
Cauchy-Schwarz bound of the residuals prune single candidates, and what remains is scored
exactly in integers. Queries go in blocks of bounded bytes, one block after another, each against
all rows; a task keeps its k best of each query from its first row to its last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard, map_batches, scratch_path, written

#: Queries of a block and their bytes, at most; queries that are searched for at once; longest vectors that start the search.
QUERY_BLOCK, QUERY_BYTES, AT_ONCE, SEEDS = 65536, 64 << 20, 2048, 4096
#: Candidates of a block, and leading coordinates.
CANDIDATES, LEAD = 2048, 16
SCHEMA = "rid long, query_id long, vec_id long, score long"
#: Below any score, and safe to negate.
NONE = -(2**63 - 1)
#: Scores beyond a long count as the last that fit; components beyond LARGEST as that.
MOST, LARGEST = 2**63 - 1, 1e140


def usable(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) with floor(256 x) as whole doubles; rows with a null id or vector, or a component that is null or not finite, go."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    scaled = lambda x: F.greatest(F.least(x.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST)) * 256
    # from 2^53 on doubles are whole, and a long may not hold them
    whole_part = lambda x: F.when(F.abs(scaled(x)) < 2.0**53, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    whole = embeddings.filter(F.col(id_col).isNotNull() & v.isNotNull()).filter(~bad)
    return whole.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, whole_part).alias("v"))


def rotation(vectors: np.ndarray) -> np.ndarray:
    """Right singular vectors of a sample, the most telling first."""
    return np.linalg.svd(vectors, full_matrices=True)[2].T


@dataclass
class Block:
    """Queries of one dimension: row numbers, ids, vectors, and the least score that counts for each."""

    rids: np.ndarray
    ids: np.ndarray
    q: np.ndarray
    floor: np.ndarray
    turn: np.ndarray
    k: int

    def __post_init__(self) -> None:
        r = self.q @ self.turn
        self.lead, self.rest = r[:, :LEAD], np.linalg.norm(r[:, LEAD:], axis=1)
        self.norm = np.linalg.norm(self.q, axis=1)


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products of whole doubles; beyond a long, the last that fits.

    Sums below 2^53 are exact in floating point. Sums of longs are exact, however far they go
    astray between, if the last fits a long; where that or a component is in doubt, Python's integers tell.
    """
    size = np.abs(q).sum(1).max(initial=0) * np.abs(x).max(initial=0)
    if size < 2**53:
        return (q @ x.T).astype(np.int64)
    near = q @ x.T
    doubt = np.abs(near) + 1e-12 * (np.abs(q) @ np.abs(x).T) >= 2.0**62
    short_q, short_x = ((np.abs(a) < 2.0**62).all(1) for a in (q, x))
    doubt |= ~short_q[:, None] | ~short_x[None]
    out = np.where(short_q[:, None], q, 0).astype(np.int64) @ np.where(short_x[:, None], x, 0).astype(np.int64).T
    whole_q, whole_x = ({i: [int(v) for v in a[i].tolist()] for i in np.unique(at).tolist()} for a, at in zip((q, x), np.nonzero(doubt), strict=True))
    for i, j in np.argwhere(doubt).tolist():
        out[i, j] = max(NONE + 1, min(MOST, sum(a * b for a, b in zip(whole_q[i], whole_x[j], strict=True))))
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by falling score, ties by id."""
    if scores.shape[1] > 4 * k:  # keep all that tie with the k-th best, for the tie rule
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        width = max(k, int((scores >= edge[:, None]).sum(1).max()))
        keep = np.argpartition(-scores, width - 1, axis=1)[:, :width]
        scores, ids = np.take_along_axis(scores, keep, 1), np.take_along_axis(ids, keep, 1)
    best = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, best, 1), np.take_along_axis(ids, best, 1)


class Search:
    """The k best candidates of each query of a block, over all that were seen so far."""

    def __init__(self, block: Block):
        self.block = block
        self.ids, self.scores = np.full((len(block.ids), block.k), -1, np.int64), np.full((len(block.ids), block.k), NONE, np.int64)

    def see(self, rids: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        norms = np.linalg.norm(vectors, axis=1)
        order = np.argsort(-norms, kind="stable")
        for at in range(0, len(order), CANDIDATES):
            part = order[at : at + CANDIDATES]
            x = vectors[part]
            turned = x @ self.block.turn
            lead, rest = turned[:, :LEAD].T.copy(), np.linalg.norm(turned[:, LEAD:], axis=1)
            met = [self._meet(slice(q, q + AT_ONCE), rids[part], ids[part], x, norms[part], lead, rest) for q in range(0, len(self.ids), AT_ONCE)]
            if not any(met):
                break  # every later candidate is shorter

    def _meet(self, at: slice, rids: np.ndarray, ids: np.ndarray, x: np.ndarray, norms: np.ndarray, lead: np.ndarray, rest: np.ndarray) -> bool:
        """Hold candidates, sorted by length, against some of the queries; False if all are too short for each."""
        b = self.block
        worst = np.maximum(self.scores[at, -1], b.floor[at]).astype(float)
        worst[worst <= float(NONE + 1)] = -np.inf  # a score below any long ties with all such
        slack = 1e-9 * b.norm[at] * norms[0] + 1e-6
        alive = np.flatnonzero(b.norm[at] * norms[0] + slack >= worst)
        if not len(alive):
            return False
        own = alive + at.start
        bound = b.lead[own] @ lead
        bound += np.outer(b.rest[own], rest)
        open_ = bound + slack[alive, None] >= worst[alive, None]
        columns, rows = np.flatnonzero(open_.any(0)), np.flatnonzero(open_.any(1))
        x, rids, ids = x[columns], rids[columns], ids[columns]
        for first in range(0, len(rows), 512):
            r = own[rows[first : first + 512]]
            got = np.where(b.rids[r][:, None] == rids[None], NONE, _products(b.q[r], x))
            every = np.concatenate([self.scores[r], got], axis=1)
            names = np.concatenate([self.ids[r], np.broadcast_to(ids, got.shape)], axis=1)
            self.scores[r], self.ids[r] = _best(every, names, b.k)
        return True

    def found(self) -> pa.RecordBatch:
        """What is not below its query's floor."""
        b, keep = self.block, (self.scores > NONE) & (self.scores >= self.block.floor[:, None])
        spread = lambda x: np.broadcast_to(x[:, None], keep.shape)[keep]
        return pa.RecordBatch.from_arrays([pa.array(spread(b.rids)), pa.array(spread(b.ids)), pa.array(self.ids[keep]), pa.array(self.scores[keep])], ["rid", "query_id", "vec_id", "score"])


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, ids and vectors of a batch, one group for each dimension."""
    rids, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    lists = batch.column(2)
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(int) if len(sizes) else np.zeros(0, int)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rids[rows], ids[rows], flat[starts[rows][:, None] + np.arange(d)]


def _seeds(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors of the longest, by dimension."""
    by: dict[int, list] = {}
    for r in vectors.orderBy(F.desc("length"), "rid").select("rid", "v").limit(SEEDS).collect():
        by.setdefault(len(r.v), []).append((r.rid, r.v))
    return {d: (np.array([i for i, _ in x]), np.array([v for _, v in x], float).reshape(len(x), d)) for d, x in by.items()}


def _with_floors(queries: DataFrame, seeds: dict, k: int) -> DataFrame:
    """queries (rid, vec_id, v) with floor, the k-th best score among the seeds; NONE if they are fewer."""
    shared = queries.sparkSession.sparkContext.broadcast(seeds)

    def rows(columns: list[list]) -> list[list]:
        floors = []
        for rid, v in zip(columns[0], columns[2], strict=True):
            names, x = shared.value.get(len(v), (np.zeros(0, np.int64), np.zeros((0, len(v)))))
            got = _products(np.array([v], float), x)[0][names != rid]
            floors.append(int(np.partition(got, len(got) - k)[len(got) - k]) if len(got) >= k else NONE)
        return [*columns, floors]

    return map_batches(queries, rows, "rid long, vec_id long, v array<double>, floor long")


def top_k(embeddings: DataFrame, query_divisor: int = 50, k: int = 5, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by query_divisor.

    Equal scores go to the smaller id. Rows are told apart by where they stand: each of several
    rows with one id asks, and is a candidate of the others. Vectors of different dimensions have no
    product and don't meet. A score beyond a long is the last that fits, which then ties. Rows that take no part are those of usable(). Fewer candidates give fewer rows,
    none an empty result.
    """
    spark = embeddings.sparkSession
    paths = [scratch_path(spark, name) for name in ("vectors", "queries", "found")]
    try:
        length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
        numbered = usable(embeddings).select(F.monotonically_increasing_id().alias("rid"), "vec_id", "v", length.alias("length"))
        vectors = written(numbered.repartitionByRange(F.desc("length"), F.xxhash64("rid")).sortWithinPartitions(F.desc("length")), "vectors", paths[0])
        seeds = _seeds(vectors)
        turns = {d: rotation(x) for d, (_, x) in seeds.items() if d}
        queries = written(_with_floors(vectors.filter(F.col("vec_id") % query_divisor == 0).select("rid", "vec_id", "v"), seeds, k), "queries", paths[1])
        size = queries.agg(F.count("*").alias("n"), F.sum(F.size("v") * 24.0 + 64).alias("bytes")).first()
        blocks = max(1, -(-size.n // query_block), int((size.bytes or 0) // QUERY_BYTES) + 1)
        found = spark.createDataFrame([], SCHEMA)
        for b in range(blocks):
            by: dict[int, list] = {}
            for r in queries.filter(F.pmod(F.xxhash64("rid"), F.lit(blocks)) == b).collect():  # about a block's bytes
                by.setdefault(len(r.v), []).append(r)
            ready = {d: Block(np.array([r.rid for r in x]), np.array([r.vec_id for r in x]), np.array([r.v for r in x], float).reshape(len(x), d), np.array([r.floor for r in x]), turns.get(d, np.eye(d)), k) for d, x in by.items()}
            shared = spark.sparkContext.broadcast(ready)

            def run(batches, shared=shared):
                searches = {d: Search(block) for d, block in shared.value.items()}
                for batch in batches:
                    for rids, ids, v in _by_dimension(batch):
                        if v.shape[1] in searches:
                            searches[v.shape[1]].see(rids, ids, v)
                yield from (s.found() for s in searches.values())

            vectors.select("rid", "vec_id", "v").mapInArrow(run, SCHEMA).write.mode("append").parquet(paths[2])
            found = spark.read.schema(SCHEMA).parquet(paths[2])
            shared.destroy()
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id")))
        return cut(ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
    finally:
        for path in paths:
            discard(spark, path)


TOPK_SQL = """
with v as (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and vec_id is not null),
s as (select q.rid, q.vec_id as query_id, c.vec_id, list_sum(list_transform(range(1, len(c.v) + 1), lambda i: q.v[i] * c.v[i]))::bigint as score
      from v q join v c on q.vec_id % 50 = 0 and c.rid <> q.rid),
r as (select *, row_number() over (partition by rid order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
