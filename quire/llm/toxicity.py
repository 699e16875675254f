"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models, toxic and ordinary, are counted from labelled texts. What absolute discounting takes
from the n-grams of a class goes to a Kneser-Ney model of both classes' pooled counts, which
they share as their backoff: an expression that is rare in a class, such as an unseen inflection
of a slur, is judged by its beginning and its pieces, and one that neither has seen by nothing. A document's
features are its log-likelihood ratio divided by its number of words, of all and of its telling
ones; a logistic curve, fitted on labelled texts that were kept out of the counts, turns them into
a score from 0 to 1.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from quire.llm.shared import crc_mod, map_batches

#: Longest n-gram, and the shortest that is counted by class.
ORDER, LOWEST = 6, 2
#: Discounts of counts of one, two, and more.
DISCOUNTS = (0.9, 1.2, 1.4)
#: Bound of the labelled texts of each class, the parameter max_per_class.
PER_CLASS = 2500
#: Words whose ratios a worker keeps, and characters of text whose new words are looked up together.
CACHE, AT_ONCE = 400_000, 1 << 16
START, END = "\x02", "\x03"
PUNCTUATION = ".,;:!?\"'()[]{}«»“”‘’…|*_~<>/\\-—–#%&$"


def words_of(text: str | None) -> list[str]:
    """Lower-cased words; bare() takes the punctuation off them."""
    return (text or "").lower().split()


def bare(word: str) -> str:
    return word.strip(PUNCTUATION)


def _discount(count: int) -> float:
    """Absolute discounts that grow with the count, as in modified Kneser-Ney smoothing."""
    return DISCOUNTS[min(count, len(DISCOUNTS)) - 1]


@dataclass
class KneserNeyPair:
    """ratios: toxic against ordinary log probability of seen n-grams; backoffs: that of any other
    character after a seen context, where the pooled model cancels out."""

    ratios: dict[str, float]
    backoffs: dict[str, float]

    def word(self, word: str) -> float:
        """Log-likelihood ratio of a whole word."""
        s, total = START + bare(word) + END, 0.0
        if len(s) == 2:
            return 0.0
        ratios, backoffs = self.ratios, self.backoffs
        for i in range(LOWEST - 1, len(s)):
            for at in range(max(0, i - ORDER + 1), i - LOWEST + 2):
                if (r := ratios.get(s[at : i + 1])) is not None or (r := backoffs.get(s[at:i])) is not None:
                    total += r
                    break
        return total


def fit_pair(toxic: dict[str, int], ordinary: dict[str, int]) -> KneserNeyPair:
    """Models from the number of documents of either class that hold each word."""
    pooled: Counter = Counter(ordinary)
    pooled.update(toxic)
    own = [[Counter() for _ in range(ORDER + 1)] for _ in range(2)]
    single: set[str] = set()
    for word in pooled:
        s = START + word + END
        c = (toxic.get(word, 0), ordinary.get(word, 0))
        single.update(s[1:])
        for order in range(LOWEST, ORDER + 1):
            for i in range(order, len(s) + 1):
                gram = s[i - order : i]
                own[0][order][gram] += c[0]
                own[1][order][gram] += c[1]
    # of each n-gram, its distinct left neighbours are the longer ones that end with it
    left = {order: Counter(g[1:] for g in own[0][order + 1]) for order in range(1, ORDER)}
    # the pooled model: full counts of the longest n-grams and of those at a word's start, numbers
    # of distinct left neighbours otherwise
    shared: dict[str, float] = {"": 1.0}
    kinds = len(single) + 1
    for order in range(1, ORDER + 1):
        counts = {g: own[0][order][g] + own[1][order][g] for g in own[0][order] if order == ORDER or g[0] == START} if order >= LOWEST else {}
        if order < ORDER:
            for g, v in left.pop(order).items():
                counts.setdefault(g, v)
        sums, held = Counter(), Counter()
        for g, c in counts.items():
            sums[g[:-1]] += c
            held[g[:-1]] += min(c, _discount(c))
        for g, c in counts.items():
            ctx = g[:-1]
            lower = shared.get(g[1:], 1 / kinds) if order > 1 else 1 / kinds
            shared[g] = (max(0.0, c - _discount(c)) + held[ctx] * lower) / sums[ctx]
    ratios: dict[str, float] = {}
    backoffs: dict[str, float] = {}
    for order in range(LOWEST, ORDER + 1):
        sums, held = [Counter(), Counter()], [Counter(), Counter()]
        for k in (0, 1):
            for g, c in own[k][order].items():
                if c:
                    sums[k][g[:-1]] += c
                    held[k][g[:-1]] += min(c, _discount(c))

        def weight(k: int, ctx: str) -> float:
            return held[k][ctx] / sums[k][ctx] if sums[k][ctx] else 1.0

        for g in own[0][order]:
            ctx, p = g[:-1], []
            for k in (0, 1):
                c = own[k][order][g]
                p.append((max(0.0, c - _discount(c)) / sums[k][ctx] if c else 0.0) + weight(k, ctx) * shared[g])
            ratios[g] = math.log(p[0] / p[1])
            if ctx not in backoffs:
                backoffs[ctx] = math.log(weight(0, ctx) / weight(1, ctx))
        own[0][order], own[1][order] = Counter(), Counter()  # done with
    return KneserNeyPair(ratios, backoffs)


#: Multiplier of the hash of an n-gram: any odd number whose bits are mixed.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hashes(codes: np.ndarray, order: int) -> np.ndarray:
    """Hash of the n-gram of so many characters that ends at each place, by its code points; the first places have none."""
    out = np.zeros(len(codes), np.uint64)
    for back in range(min(order, len(codes))):
        out[order - 1 :] += codes[order - 1 - back : len(codes) - back]
        out[order - 1 :] *= MULTIPLIER
    return out


def _codes(text: str) -> np.ndarray:
    """Code points, from one on."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)


def _table(values: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 64-bit hashes of n-grams, and their values."""
    keys, own = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for order in sorted(set(map(len, values))):
        grams = [g for g in values if len(g) == order]
        keys.append(_hashes(_codes("".join(grams)), order)[order - 1 :: order])
        own.append(np.array([values[g] for g in grams]))
    keys, own = np.concatenate(keys), np.concatenate(own)
    rank = np.argsort(keys)
    return keys[rank], own[rank]


def _look_up(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the hashes a table has, and their values."""
    keys, values = table
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return keys[at] == wanted, values[at]


class PackedPair:
    """A KneserNeyPair as arrays, an eighth of its dictionaries' memory, which give the same ratios to many words at once."""

    def __init__(self, pair: KneserNeyPair):
        self.ratios, self.backoffs = _table(pair.ratios), _table(pair.backoffs)

    def words(self, words: list[str]) -> list[float]:
        """Log-likelihood ratio of each whole word."""
        marked = [f"{START}{b}{END}" if (b := bare(w)) else "" for w in words]
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        codes = _codes("".join(marked))
        owner = np.repeat(np.arange(len(marked)), sizes)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        hashes = {order: _hashes(codes, order) for order in range(LOWEST - 1, ORDER + 1)}
        total, left = np.zeros(len(codes)), np.flatnonzero(place >= LOWEST - 1)
        for order in range(ORDER, LOWEST - 1, -1):
            long = place[left] >= order - 1
            own, rest = left[long], left[~long]
            for table, wanted, before in ((self.ratios, hashes[order], 0), (self.backoffs, hashes[order - 1], 1)):
                found, values = _look_up(table, wanted[own - before])
                total[own[found]] = values[found]
                own = own[~found]
            left = np.concatenate([rest, own])
        return np.bincount(owner, total, len(marked)).tolist()


#: Ratios from which a word counts as telling, and what is added before the logarithm.
TELLING = ((1.5, 0.02), (2.5, 0.01), (3.5, 0.01), (6.0, 0.01))


def features(ratios: list[float]) -> tuple[float, ...]:
    """Of a document: its log-likelihood ratio a word, on a log scale that of its telling words
    alone, and the logarithm of its length, by which the others are more or less certain."""
    n = len(ratios) or 1
    return (sum(ratios) / n, *(math.log(sum(r for r in ratios if r > least) / n + floor) for least, floor in TELLING), math.log(n))


def fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 100, ridge: float = 0.3) -> np.ndarray:
    """Logistic regression by damped Newton steps on standardised features; the first weight is the intercept.

    A step is halved until the penalised likelihood rises, so classes that can be told apart by a
    line, as those of few texts can, leave the weights finite. A class weighs as the square root of its number, so
    that the rarer one isn't given up for the other, and few of the other are for it.
    """
    weight = np.sqrt(0.5 * len(y) / np.maximum(1, np.where(y > 0, (y > 0).sum(), (y <= 0).sum())))
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum() + 0.5 * (penalty * w * w).sum())

    w = np.zeros(a.shape[1])
    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-9), a.T @ (weight * (y - p)) - penalty * w)
        rate = 1.0
        while (then := loss(w + rate * step)) > now and rate > 1e-6:
            rate /= 2
        if now - then < 1e-9:
            break
        w, now = w + rate * step, then
    raw = w[1:] / scale
    return np.concatenate([[w[0] - raw @ mean], raw])


@dataclass
class ToxicityModel:
    """packed is a pickled PackedPair, which only those that score with it unpack."""

    packed: bytes
    curve: list[float]

    @property
    def pair(self) -> PackedPair:
        if "_pair" not in self.__dict__:
            self._pair = pickle.loads(self.packed)
        return self._pair

    def __getstate__(self) -> dict:
        return {"packed": self.packed, "curve": self.curve}

    def ratios(self, texts: Iterable[str | None], cache: dict[str, float]) -> Iterator[list[float]]:
        """Ratios of the words of each text; the new words of about AT_ONCE characters are looked up together."""
        seen = 0

        def lot(text: str | None) -> int:
            nonlocal seen
            seen += len(text or "")
            return seen // AT_ONCE

        for _, some in itertools.groupby(texts, key=lot):
            split = [words_of(t) for t in some]
            if len(cache) >= CACHE:
                cache.clear()
            unseen = list(set().union(*split).difference(cache))
            cache.update(zip(unseen, self.pair.words(unseen), strict=True))
            for words in split:
                yield list(map(cache.__getitem__, words))

    def scores(self, texts: Iterable[str | None], cache: dict[str, float]) -> list[float]:
        out = []
        for ratios in self.ratios(texts, cache):
            z = self.curve[0] + sum(a * b for a, b in zip(self.curve[1:], features(ratios), strict=True))
            out.append(1 / (1 + math.exp(-max(-700.0, min(700.0, z)))))
        return out


def _chosen(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(text, toxic, kept) of the labelled documents that train: kept ones fit the curve."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(crc_mod("doc_id", 3) != 1).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = [r for label in (0, 1) for r in known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "toxic").collect()]
    spark, schema = docs.sparkSession, "doc_id long, toxic int"
    ids = spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], schema)
    counted = docs.select("doc_id").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").count()
    single = spark.createDataFrame([(r.doc_id, r.toxic) for r in counted.filter("count = 1").collect()], schema)  # no more than were chosen
    kept = (F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(3)) == 0).alias("kept")
    return docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(single), "doc_id").select("text", "toxic", kept)


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = PER_CLASS) -> ToxicityModel:
    """From labelled documents whose crc32 modulo 3 isn't 1.

    At most max_per_class ids of each class are chosen, by their hash, before any text is read, so
    the texts are found by a broadcast of that many ids. Two thirds of them (by another hash) are
    counted and the rest fit the curve; texts and counts stay on the executors, and the driver gets
    the models and a few features of each. An id that stands on several rows isn't taken. A document with labels that differ counts as toxic; ids
    without a document or a text count for nothing. Where a class has no text, every score is that
    of an even curve at its prior.
    """
    chosen = _chosen(docs, labels, max_per_class)

    def words(columns: list[list]) -> list[list]:
        found: Counter = Counter()
        for text, toxic in zip(*columns, strict=True):
            found.update((toxic, b) for b in set(map(bare, words_of(text))) if b)
        return [[t for t, _ in found], [w for _, w in found], list(found.values())]

    found = map_batches(chosen.filter("not kept").select("text", "toxic"), words, "toxic int, word string, n long").groupBy("toxic", "word").agg(F.sum("n").alias("n"))

    def build(batches):
        counts: list[dict[str, int]] = [{}, {}]
        for batch in batches:
            for toxic, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts[toxic][word] = n
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(PackedPair(fit_pair(counts[1], counts[0])))], pa.binary())], ["pair"])

    # the words of a bounded sample, counted in one task and not in the driver's memory
    built = found.coalesce(1).mapInArrow(build, "pair binary").first()
    model = ToxicityModel(bytes(built.pair) if built else pickle.dumps(PackedPair(fit_pair({}, {}))), [])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def described(columns: list[list]) -> list[list]:
        return [[list(features(ratios)) for ratios in shared.value.ratios(columns[0], {})], columns[1]]

    rows = map_batches(chosen.filter("kept").select("text", "toxic"), described, "x array<double>, toxic int", most=64).collect()
    rows.sort(key=lambda r: (r.toxic, r.x))
    y = [r.toxic for r in rows]
    if len(set(y)) < 2:
        prior = (sum(y) + 0.5) / (len(y) + 1)
        return ToxicityModel(model.packed, [math.log(prior / (1 - prior)), float(0 < sum(y) < len(y)), *[0.0] * (len(TELLING) + 1)])
    return ToxicityModel(model.packed, fit_curve(np.array([r.x for r in rows]), np.array(y)).tolist())


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of docs that score below the threshold, all columns kept, whatever their names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by max_per_class texts
    at = docs.columns.index("text")
    cache: dict[str, float] = {}

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([s < threshold for s in shared.value.scores((t.as_py() for t in batch.column(at)), cache)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity_scores(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """(doc_id, score, predicted) of every row of docs.

    Every whole text is scored, however long. Null, empty and blank texts have the features of no
    words and so the curve's score at those; repeated rows give a row each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select("doc_id", "text")
    target = StructType([source.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    cache: dict[str, float] = {}

    def run(batches):
        for batch in batches:
            scores = shared.value.scores((t.as_py() for t in batch.column(1)), cache)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return source.mapInArrow(run, target)


def score_documents(docs: DataFrame, labels: DataFrame, max_per_class: int = PER_CLASS, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs.

    A null doc_id is in no label and isn't held out; other nulls, empty and very long texts, repeated
    rows and empty tables are as in toxicity_scores, and other columns are ignored.
    """
    model = train(docs, labels, max_per_class)
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    return toxicity_scores(docs, model, threshold).select("doc_id", held_out.alias("held_out"), "score", "predicted")
