"""Language-model scores of whole documents: a GRU over frequent words, corpus counts for the rest.

All documents outside the held-out fold are counted. The most frequent words are the output
words of a class-factored GRU; every other word belongs to one of a few open classes (by its
last letters), whose probability the GRU gives, times the word's add-one share of the class in
the corpus counts. The network starts from the counts as its biases and from a sample fitted on the
driver; then each partition trains a copy over all of its training documents, and the copies are
averaged by their words, in rounds that each take another share of the documents. A second, larger table of
frequent words is sent along to keep common words out of the join that looks counts up: a word
outside it has at most 1/HEAD of all tokens, so no key of that join is hot.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import gru
from quire.llm.shared import crc_mod, cut, discard, map_batches, scratch_path, written

#: Output words and those of a class; open classes; hidden units.
OUTPUT, MEMBERS, OPEN, HIDDEN = 4096, 64, 32, 32
#: Words whose counts are broadcast, and documents that the network is started on (both are bounds).
HEAD, SAMPLE = 65536, 1000
#: Rounds of training over all documents, words that a copy learns from at once, and its rate.
ROUNDS, CHUNK, RATE = 2, 400_000, 0.002
#: Documents that are scored side by side: the more, the less the longest ones cost.
SIDE_BY_SIDE = 8192
#: The end token: no word holds white space.
END = b"\n"
ROW = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_counts double, partial double, words array<binary>, times array<long>, ids binary"
SCORE = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, head_counts double, partial double"
#: White space of words, by byte.
WHITE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def all_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts without the end tokens: how many each text has, and of each word its place among the distinct ones, which come last."""
    data = np.frombuffer(b"\n".join([b"", *(t or b"" for t in texts), b""]).lower(), np.uint8)
    inside = ~WHITE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[inside])])
    found = words.dictionary_encode()
    bounds = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
    return np.diff(np.searchsorted(starts, bounds)), found.indices.to_numpy(), found.dictionary


def open_class(word: bytes) -> int:
    return xxhash.xxh32_intdigest(word[-3:]) % OPEN


def count_words(docs: DataFrame) -> DataFrame:
    """(word, c) over all documents of docs; each batch is counted before anything is shuffled."""

    def rows(columns: list[list]) -> list[list]:
        sizes, at, words = all_words(columns[0])
        return [pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())]), np.append(np.bincount(at, minlength=len(words)), len(sizes))]

    return map_batches(docs.select("text"), rows, "word binary, n long", binary=("text",)).groupBy("word").agg(F.sum("n").alias("c"))


class Codes(dict):
    """Words to codes: their rank among the head's words, or head size plus open class."""

    LIMIT = 150_000

    def __init__(self, head: list[bytes]):
        super().__init__(zip(head, range(len(head)), strict=True))
        self.head, self.size = head, len(head)

    def __missing__(self, word: bytes) -> int:
        code = self.size + open_class(word)
        if len(self) < self.size + self.LIMIT:
            self[word] = code
        return code

    def __reduce__(self):
        return Codes, (self.head,)


@dataclass
class LanguageModel:
    codes: Codes
    log_counts: np.ndarray
    known: np.ndarray
    numbers: np.ndarray
    open_log: np.ndarray
    net: gru.Gru

    @property
    def kind(self) -> type:
        """Type of a word's number in encoded texts."""
        return np.uint16 if self.net.start < 1 << 16 else np.uint32

    def rows(self, texts: list[bytes | None]) -> tuple[list, ...]:
        """Of each text: tokens, known head tokens, sum of log10(c + 1) over head tokens, the part of
        the score that isn't the network's, the words outside the head with how often they occur, and
        the network's numbers of all tokens."""
        sizes, at, words = all_words(texts)
        words = pa.concat_arrays([words, pa.array([END], pa.large_binary())])
        names = words.to_numpy(zero_copy_only=False).tolist()
        codes = np.fromiter(map(self.codes.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(codes < 0)
        codes[new] = self.codes.size + np.fromiter((open_class(names[i]) for i in new.tolist()), np.int64, len(new))
        at, owner = np.insert(at, np.cumsum(sizes), len(words) - 1), np.repeat(np.arange(len(texts)), sizes + 1)
        ids, inside = self.numbers[codes], codes < self.codes.size
        codes = np.where(inside, codes, 0)
        log_counts = np.where(inside, self.log_counts[codes], 0.0)
        # open-class words: the share's numerator is c + 1, its denominator the class's
        is_open = ids >= self.net.words
        shares = np.where(is_open, log_counts - self.open_log[np.maximum(ids - self.net.words, 0)], 0.0)
        summed = lambda values: np.bincount(owner, values[at], len(texts))
        own = np.flatnonzero(~inside[at])
        rare, times = np.unique(owner[own] * len(words) + at[own], return_counts=True)
        offsets = pa.array(np.searchsorted(rare, np.arange(len(texts) + 1) * len(words)), pa.int32())
        numbers = ids[at].astype(self.kind)
        ends = np.concatenate([[0], np.cumsum(sizes + 1)]) * numbers.itemsize
        encoded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(numbers)])
        return (
            sizes + 1, summed(inside & (self.known[codes])).astype(np.int64), summed(log_counts), summed(shares),
            pa.ListArray.from_arrays(offsets, words.take(pa.array(rare % len(words))).cast(pa.binary())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())), encoded.cast(pa.binary()),
        )


def encoded(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """ROW of every row (rid, doc_id, held_out, text) of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(columns: list[list]) -> list:
        return [*columns[:3], *shared.value.rows(columns[3])]

    return map_batches(docs.select("rid", "doc_id", "held_out", "text"), rows, ROW, binary=("text",))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """At most so many (word, c), the most frequent first, without a sort of all words.

    Words are counted by classes of c, an eighth of a power of two wide, and only those of the
    highest classes that together fit are read. A word left out has hardly more than its share,
    one in ``most`` of all tokens.
    """
    grade = F.floor(8 * F.log2(F.col("c").cast("double")))
    left, lowest = most, None
    for r in sorted(counts.groupBy(grade.alias("grade")).agg(F.count("*").alias("n")).collect(), key=lambda r: -r.grade):
        if r.n > left:
            break
        left, lowest = left - r.n, r.grade
    if lowest is None:
        return []
    return sorted(((bytes(r.word), r.c) for r in counts.filter(grade >= lowest).collect()), key=lambda x: (-x[1], x[0]))


def sample_ids(training: DataFrame, most: int) -> list[bytes]:
    """Encoded texts of at most so many training documents: ids first, by hash, then their texts."""
    ids = training.select("doc_id").orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most).distinct()
    chosen = training.sparkSession.createDataFrame(ids.collect(), "doc_id long")
    rows = training.join(F.broadcast(chosen), "doc_id").select("doc_id", "ids").collect()
    return [bytes(r.ids) for r in sorted(rows, key=lambda r: (r.doc_id, r.ids))][:most]


def start_biases(net: gru.Gru, c: np.ndarray, open_sums: np.ndarray) -> None:
    """Class and word biases from the counts of all training documents."""
    own = np.log(c[: net.words] + 1.0)
    at = np.arange(net.words)
    net.weights["word_bias"][at // net.members, at % net.members] = own
    totals = np.log(np.concatenate([np.bincount(at // net.members, c[: net.words], net.classes)[: net.classes], open_sums]) + 1)
    net.weights["class_bias"][:] = totals - totals.max()


def train_on_all(net: gru.Gru, training: DataFrame, codes: Codes, numbers: np.ndarray, rounds: int = ROUNDS) -> int:
    """Train copies of the network over every training document (doc_id, text), by partition, and average them. Returns the words read."""
    none = np.zeros(len(codes.head)), np.zeros(len(codes.head), bool)
    return _train(net, encoded(_unheld(training), LanguageModel(codes, none[0], none[1], numbers, np.zeros(OPEN), net)), rounds)


def _unheld(training: DataFrame) -> DataFrame:
    return training.select(F.lit(0).cast("long").alias("rid"), "doc_id", F.lit(False).alias("held_out"), "text")


def _train(net: gru.Gru, training: DataFrame, rounds: int = ROUNDS) -> int:
    """train_on_all of encoded documents."""
    names, read = list(net.weights), 0
    kind = np.uint16 if net.start < 1 << 16 else np.uint32
    for r in range(rounds):
        shared = training.sparkSession.sparkContext.broadcast(net)

        def learn(batches, shared=shared):
            start = shared.value
            own = start.copy()
            trainer = gru.Trainer(own)
            held, size, total = [], 0, 0
            for batch in batches:
                for text in batch.column(0):
                    held.append(np.frombuffer(text.as_buffer(), kind).astype(np.int32))
                    size += len(held[-1])
                    if size >= CHUNK:
                        trainer.learn(held, rate=RATE)
                        held, size, total = [], 0, total + size
            if held:
                trainer.learn(held, rate=RATE)
                total += size
            if total:
                values = np.concatenate([(own.weights[k] - start.weights[k]).ravel() for k in names]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([total], pa.int64()), pa.array([values.tobytes()], pa.binary())], ["n", "change"])

        def add(x, y):
            return y if x is None else x if y is None else (x[0] + y[0], x[1] + y[1])

        share = training.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == r).select("ids")
        changes = share.mapInArrow(learn, "n long, change binary").rdd.map(lambda x: (x.n, np.frombuffer(bytes(x.change), "<f4").astype(np.float64) * x.n))
        found = changes.treeAggregate(None, add, add, depth=3)
        if found:
            at = 0
            for k in names:
                w = net.weights[k]
                w += (found[1][at : at + w.size] / found[0]).reshape(w.shape).astype(np.float32)
                at += w.size
            read += found[0]
        shared.unpersist()
    return read


def fit(training: DataFrame, counts: DataFrame, sample: int = SAMPLE, **options) -> LanguageModel:
    """The model from counts of all training documents (doc_id, text), a start on a sample of them, and training on all."""
    model = counted(counts, **options)
    _fit(model, encoded(_unheld(training), model), sample)
    return model


def _fit(model: LanguageModel, training: DataFrame, sample: int) -> None:
    """Start the network on a sample of encoded documents, then train it on all."""
    gru.train(model.net, [np.frombuffer(x, model.kind).astype(np.int32) for x in sample_ids(training, sample)])
    _train(model.net, training)


def counted(counts: DataFrame, output: int = OUTPUT, members: int = MEMBERS, hidden: int = HIDDEN, head: int = HEAD) -> LanguageModel:
    """The model from counts of all training documents, its network not trained."""
    top = most_frequent(counts, head)
    words, c = [w for w, _ in top], np.array([n for _, n in top], np.int64)
    if END not in words:  # as rare as can be, but it must have a number
        words, c = [*words[: head - 1], END], np.append(c[: head - 1], 0)
    net = gru.Gru.fresh(min(output, len(words)), members, OPEN, hidden)
    last = words.index(END)
    if last >= net.words:
        words[last], words[net.words - 1] = words[net.words - 1], words[last]
        c[[last, net.words - 1]] = c[[net.words - 1, last]]
    numbers = np.array([i if i < net.words else net.words + open_class(w) for i, w in enumerate(words)] + [net.words + i for i in range(OPEN)], np.int32)
    # totals of the open classes: those of all counts, less the output words'
    def classed(columns: list[list]) -> list[list]:
        n, kinds = np.zeros(OPEN, np.int64), np.zeros(OPEN, np.int64)
        for w, own in zip(*columns, strict=True):
            n[open_class(w)] += own
            kinds[open_class(w)] += 1
        return [list(range(OPEN)), n.tolist(), kinds.tolist()]

    sums = np.zeros(OPEN)
    for r in map_batches(counts.select("word", "c"), classed, "k int, n long, kinds long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect():
        sums[r.k] = r.n + r.kinds
    for w, own in zip(words[: net.words], c[: net.words].tolist(), strict=True):
        sums[open_class(w)] -= own + (own > 0)
    codes = Codes(words)
    model = LanguageModel(codes, np.log10(c + 1.0), c > 0, numbers, np.log10(sums + 1), net)
    start_biases(net, c, np.maximum(sums, 0))
    return model


def scored(coded: DataFrame, net: gru.Gru) -> DataFrame:
    """SCORE of every encoded document: the network's part is added to partial. So many documents as
    SIDE_BY_SIDE are scored together, whatever the batches they come in."""
    shared = coded.sparkSession.sparkContext.broadcast(net)
    kind = np.uint16 if net.start < 1 << 16 else np.uint32
    names = [x.split()[0] for x in SCORE.split(", ")]

    def score(batches):
        held, size = [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, SIDE_BY_SIDE // 4):
                held.append(batch.slice(a, SIDE_BY_SIDE // 4))
                size += held[-1].num_rows
                if size > SIDE_BY_SIDE * 3 // 4:
                    yield together(held)
                    held, size = [], 0
        if size:
            yield together(held)

    def together(held):
        table = pa.Table.from_batches(held)
        scores = shared.value.score([np.frombuffer(x.as_buffer(), kind).astype(np.int32) for part in held for x in part.column("ids")]) / math.log(10)
        columns = [scores + table[n].to_numpy() if n == "partial" else table[n].combine_chunks() for n in names]
        return pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in columns], names)

    return coded.select(*names, "ids").mapInArrow(score, SCORE)


def score_documents(docs: DataFrame, modulus: int = 7, held: int = 2, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    A null or empty text is its end token alone; a null doc_id hashes to no fold and counts as
    held out; repeated rows are counted and scored each; very long texts are scored whole, their state
    carried along; other columns are ignored. Without any training document every count is 0.
    """
    fold = F.coalesce(crc_mod("doc_id", modulus) == held, F.lit(True)).alias("held_out")
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", fold)
    training = source.filter(~F.col("held_out"))
    spark = docs.sparkSession
    paths = [scratch_path(spark, name) for name in ("counts", "scores")]
    try:
        return cut(_scored(source, training, paths, options))
    finally:
        for path in paths:
            discard(spark, path)


def _scored(source: DataFrame, training: DataFrame, paths: list[str], options: dict) -> DataFrame:
    counts = written(count_words(training), "counts", paths[0])
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    sample = options.pop("sample", SAMPLE)
    model = counted(counts, **options)
    numbered = source.withColumn("rid", F.monotonically_increasing_id())
    coded = written(encoded(numbered, model), "scores", paths[1])  # written, so that rid stays, and texts are encoded once
    _fit(model, coded.filter(~F.col("held_out")), sample)
    rare = coded.select("rid", F.explode(F.arrays_zip("words", "times")).alias("w")).select("rid", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    looked = rare.join(counts, "word").groupBy("rid").agg(F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("rare_counts"), F.sum("times").alias("rare_known"))
    floor = math.log10(totals.n + totals.v + 1)
    rare_counts = F.coalesce("rare_counts", F.lit(0.0))
    return scored(coded, model.net).join(looked, "rid", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(int(totals.n)).cast("long").alias("train_tokens"),
        (F.col("head_counts") + rare_counts - F.col("n_tokens") * F.lit(floor)).alias("base_score"),
        (F.col("partial") + rare_counts).alias("score"),
    )
