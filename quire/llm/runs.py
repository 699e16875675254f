"""Periodic runs of words: Main-Lorentz divide and conquer on interned word ids.

A run is a stretch of words with smallest period q, of max(least, powers * q) words or more, that no
neighbouring word extends. A text's words become ids and are halved again and again. A run belongs to
the topmost segment whose midpoint it crosses: there it lies whole, and one of the halves holds at least
powers/2 periods of it. So the Z-function of that half, from the midpoint outwards, gives its period;
values of the Z-function are 0 except where the midpoint's word recurs, so only those places are
computed. The other half's part comes from the common extension across the midpoint. What a word
outside the segment would extend is left to the segment above that holds it whole; intervals found
under several periods keep the smallest.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quire.llm.baselines import CRC32
from quire.llm.shared import map_batches, unused

#: A run's least words, and how often its period fits at least.
LEAST, POWERS = 6, 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def intern(words: list, table: dict) -> np.ndarray:
    """Ids of words; equal words share one. New words are added to the table."""
    return np.fromiter((table.setdefault(w, len(table)) for w in words), np.int64, len(words))


def neighbours(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Next and previous place of each place's word; beyond the ends where there is none."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    same = ids[order[1:]] == ids[order[:-1]]
    after, before = np.full(n, n + 1, np.int64), np.full(n, -1, np.int64)
    after[order[:-1][same]], before[order[1:][same]] = order[1:][same], order[:-1][same]
    return after, before


def extension(a: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words from i and j on, forwards (step 1) or backwards (-1), are equal, at most ``most``."""
    done, width = 0, 16
    while done < most:
        w = min(width, most - done)
        x, y = (a[k + done : k + done + w] if step > 0 else a[k - done - w + 1 : k - done + 1][::-1] for k in (i, j))
        differ = np.flatnonzero(x != y)
        if len(differ):
            return done + int(differ[0])
        done, width = done + w, width * 2
    return done


def _z(a: list, start: int, end: int, places: list[int], step: int) -> dict[int, int]:
    """Z-function of the half that goes from start to before end in direction step, at the given distances (where its first word recurs)."""
    size, z, left, right = abs(end - start), {}, 0, 0
    for p in places:
        k = min(right - p, z.get(p - left, 0)) if p < right else 0
        if p + k >= right or p >= right:
            while p + k < size and a[start + step * k] == a[start + step * (p + k)]:
                k += 1
        z[p] = k
        if p + k > right:
            left, right = p, p + k
    return z


def _roots(z: dict[int, int], powers: int) -> list[int]:
    """Periods p of powers/2 * p words or more, without multiples of one that covers the same words.

    Those left are roots of squares that start at one place, of which there are no more than the logarithm of their length.
    """
    roots: list[int] = []
    for p, k in z.items():
        if 2 * (p + k) >= powers * p and not any(p % q == 0 and z[q] + q >= p + k for q in roots):
            roots.append(p)
    return roots


def _places(first: int, chain: np.ndarray, limit: int, step: int) -> list[int]:
    out, at = [], int(chain[first])
    while (d := step * (at - first)) <= limit and 0 <= at < len(chain):
        out.append(d)
        at = int(chain[at])
    return out


def find_runs(ids: np.ndarray, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period. powers is 4 or more, so that a half holds a square."""
    if powers < 4:
        raise ValueError("powers must be 4 or more")
    n, words = len(ids), None
    least = max(least, powers)
    if n < least:
        return []
    after, before = neighbours(ids)
    found: dict[tuple[int, int], int] = {}
    lefts, rights = np.array([0]), np.array([n])
    while len(lefts):
        mids = (lefts + rights) // 2
        # a run of powers * p words in a segment of s words has p <= s / powers
        limits = (rights - lefts) // powers
        near = (after[mids] - mids <= limits) | ((before[mids - 1] >= lefts) & (mids - 1 - before[mids - 1] <= limits))
        for left, mid, right in zip(lefts[near].tolist(), mids[near].tolist(), rights[near].tolist(), strict=True):
            words = ids.tolist() if words is None else words
            limit = (right - left) // powers
            for step, first, end, chain in ((1, mid, right, after), (-1, mid - 1, left - 1, before)):
                places = [p for p in _places(first, chain, limit, step) if p < abs(end - first)]
                if not places:
                    continue
                z = _z(words, first, end, places, step)
                for p in _roots(z, powers):
                    # across the midpoint: the words before first against those a period further on
                    other, room = first - step, (first - left if step > 0 else right - 1 - first)
                    across = extension(ids, other, other + step * p, room, -step)
                    start, stop = (mid - across, mid + p + z[p]) if step > 0 else (mid - p - z[p], mid + across)
                    whole = (start > left or left == 0 or words[start - 1] != words[start - 1 + p]) and (stop < right or right == n or words[stop] != words[stop - p])
                    if whole and stop - start >= max(least, powers * p):
                        found[start, stop] = min(p, found.get((start, stop), p))
        lefts, rights = np.concatenate([lefts, mids]), np.concatenate([mids, rights])
        keep = rights - lefts >= least
        lefts, rights = lefts[keep], rights[keep]
    return sorted((start, stop - start, p) for (start, stop), p in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: those that no run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, p in runs:
        change[start + p] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def seeded(words: list, doc_id: int | None) -> list:
    """Words of which every tenth document repeats a stretch to its end, as its id's crc32 says; a null id has none."""
    n = len(words)
    if doc_id is None or not n:
        return words
    g, last = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if last:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + list(itertools.islice(itertools.cycle(words[a : a + p]), n - a))


def _digest(runs: list[tuple[int, int, int]]) -> str:
    return hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest length/period; ties to the smallest start, then period. runs are sorted."""
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """docs with runs: array of (start, length, period) by word number, and collapsed: the text without the repeated words.

    Words are what ASCII white space parts. A null text has no words, no runs and an empty collapsed
    text. Each row is told apart by itself, so repeated rows, null ids and ties give a result each; all other
    columns pass through, those named runs or collapsed under a name with underscores before. A text
    is held whole by its task, with some 40 bytes a word.
    """
    names = [unused(docs.columns, n) for n in ("runs", "collapsed")]
    text, ident = unused(docs.columns, "quire_text"), unused(docs.columns, "quire_row")

    def rows(columns: list[list]) -> list[list]:
        found, left = [], []
        for content in columns[1]:
            words = (content or b"").split()
            runs = find_runs(intern(words, {}), least, powers)
            found.append([{"start": s, "length": n, "period": p} for s, n, p in runs])
            left.append(b" ".join(itertools.compress(words, collapsed(len(words), runs).tolist())).decode("utf-8", "replace"))
        return [columns[0], found, left]

    packed = docs.select(F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in docs.columns)).alias(ident), F.col(text_col).cast("binary").alias(text))
    schema = StructType([packed.schema[ident], *StructType.fromDDL(f"{names[0]} array<struct<start:long,length:long,period:long>>, {names[1]} string")])
    out = map_batches(packed, rows, schema, most=256)
    return out.select(f"{ident}.*", *names)


def describe(docs: DataFrame) -> DataFrame:
    """Digest of the runs of each document, some of which are seeded with repetitions by their ids; see periodic_runs.

    A row for each row of docs(doc_id, text): null and empty texts have no runs, null ids are not seeded,
    repeated rows repeat, other columns are ignored, and an empty table gives an empty result.
    """

    def rows(columns: list[list]) -> list[list]:
        out: list[list] = [[] for _ in range(8)]
        for doc_id, content in zip(*columns, strict=True):
            words = seeded((content or b"").split(), doc_id)
            runs = find_runs(intern(words, {}))
            best = strongest(runs)
            top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
            left = b" ".join(itertools.compress(words, collapsed(len(words), runs).tolist())) if runs else b" ".join(words)
            for column, value in zip(out, (doc_id, len(runs), *top, _digest(runs), hashlib.sha256(left).hexdigest()), strict=True):
                column.append(value)
        return out

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), rows, SCHEMA, most=256)


def _levels(n: int) -> str:
    """Ranks of the stretches of 1, 2, 4, ... words from each place, and the places whose stretch stands next p words further on."""
    out = ["g0 as materialized (select rid, i, dense_rank() over (order by word) as r from t)"]
    for j in range(n):
        step = f"(select rid, i, r, lead(r, {1 << j}) over (partition by rid order by i) as s from g{j})"
        out.append(f"g{j + 1} as materialized (select rid, i, dense_rank() over (order by r, s) as r from {step} where s is not null)")
    return ",\n".join(out)


def runs_sql(levels: int = 15) -> str:
    """The digests of describe(), for texts of up to 4 << levels words, by another way.

    The stretch of k words at a place of a run, k being a power of two from the period on, next stands
    one period further on, as the rotations of a word that is no power differ. So a run is an
    unbroken row of places whose stretch stands next p words further on.
    """
    near = " union all ".join(
        f"select rid, i, p, {1 << j} as k from (select rid, i, lead(i) over (partition by rid, r order by i) - i as p from g{j}) where p > {(1 << j) >> 1} and p <= {1 << j}" for j in range(levels + 1)
    )
    return f"""
with d as (select row_number() over () as rid, doc_id, {CRC32} as h, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
e as (select rid, doc_id, w, len(w) as n, h % 10 = 0 and len(w) > 0 as seeded, (h // 10) % greatest(len(w), 1) as a, 1 + (len(w) - (h // 10) % greatest(len(w), 1)) // (3 + (h // 10) % 8) as p from d),
t as materialized (select rid, i, case when seeded and i >= a then w[1 + a + (i - a) % p] else w[1 + i] end as word from (select *, unnest(range(n)) as i from e)),
{_levels(levels)},
near as ({near}),
r as materialized (select rid, min(i) as s, max(i) + p + any_value(k) as e, p from (select *, i - row_number() over (partition by rid, p order by i) as island from near) group by rid, p, island having max(i) + p + any_value(k) - min(i) >= greatest(6, 4 * p)),
b as (select *, row_number() over (partition by rid order by (e - s) / p::double desc, s, p) as place from r),
n as (select rid, count(*) as n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' order by s, p) as lines from r group by rid),
gone as (select distinct rid, unnest(range(s + p, e)) as i from r),
c as (select rid, string_agg(word, ' ' order by i) as words from t anti join gone using (rid, i) group by rid)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, b.s::bigint as start, (b.e - b.s)::bigint as length, b.p::bigint as period, (1000 * (b.e - b.s) // b.p)::bigint as exponent_milli,
       sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(words, '')) as collapsed_sha256
from e left join n using (rid) left join b on b.rid = e.rid and b.place = 1 left join c on c.rid = e.rid
"""


RUNS_SQL = runs_sql()
