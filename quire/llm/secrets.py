"""Secret scans in DataFrame functions only: strict patterns, and character Markov models.

Offsets come without a UDF: splitting a text by a pattern gives what lies between its matches,
so the lengths of pieces and matches add up to code-point positions. Two first-order Markov
models over the characters of keys are trained from labelled samples, one of random strings and
one of ordinary identifiers; a run of key characters that no strict span touches is reported when
its log-likelihood ratio per character is high enough and it mixes kinds of characters. On 10,000 documents without
random strings that last condition keeps 35 invented words of small letters out; random strings of
letters of one case, or of digits alone, are missed for it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Runs are maximal, so a bound on their length gives the matches that pass, and no others.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1
#: Nats a character from which a run counts as random.
THRESHOLD = 0.35
#: Words that make up the identifiers of the labelled sample, fixed values.
PARTS = "get set is has max min count index value name list item user file path data time date node tree page text line word key map table column row query plan scan join sort group window batch task stage job cluster host port server client request response header body status error result total first last next prev start end size length width height left right top bottom parent child root leaf source target input output".split()
#: Matches that are folded in one go.
GROUP = 256
SPAN = "array<struct<start:int,rank:int,end:int>>"
RUNS = "array<struct<start:int,rank:int,end:int,run:string>>"


def mixed(run: Column) -> Column:
    """Whether a run mixes letters with digits, or goes from small to large letters three times.

    Long words of one case, invented ones above all, are as unlikely an identifier as they are a random
    string, and the likelihoods can't tell them apart.
    """
    return (run.rlike("[0-9]") & run.rlike("[A-Za-z]")) | run.rlike("(?:[a-z][^a-z]*?[A-Z].*?){3}")


def labelled_samples(spark: SparkSession, n: int = 3000) -> DataFrame:
    """(text, random): n random strings of four alphabets and n identifiers of four styles."""
    row = spark.range(n).withColumn("digest", F.sha2(F.concat(F.lit("sample:"), F.col("id").cast("string")), 512))
    base64 = F.base64(F.unhex("digest"))
    length = (F.col("id") % 24 + 16).cast("int")
    strings = row.select(
        F.when(F.col("id") % 4 == 0, F.substring("digest", 1, 40)).when(F.col("id") % 4 == 1, F.upper(F.regexp_replace(base64, "[+/=]", ""))).otherwise(F.translate(base64, "+/", "-_")).substr(F.lit(1), length).alias("text"),
        F.lit(True).alias("random"),
    )
    words = F.array(*map(F.lit, PARTS))
    pick = lambda i: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(len(PARTS))) + 1).cast("int"))
    three = [pick(i) for i in range(3)]
    number = F.pmod(F.xxhash64("id", F.lit("n")), F.lit(2030)).cast("string")
    names = row.select(
        F.when(F.col("id") % 4 == 0, F.concat_ws("_", *three, number))
        .when(F.col("id") % 4 == 1, F.concat(three[0], *map(F.initcap, three[1:]), number))
        .when(F.col("id") % 4 == 2, F.concat_ws("/", *three, F.concat(pick(3), number)))
        .otherwise(F.upper(F.concat_ws("-", *three, number)))
        .alias("text"),
        F.lit(False).alias("random"),
    )
    return strings.unionByName(names)


def _index(text: Column, at: Column) -> Column:
    """Place of a character in the alphabet from 1; 0 for others and for the place before the first."""
    return F.when(at < 1, F.lit(0)).otherwise(F.instr(F.lit(ALPHABET), F.substring(text, at, F.lit(1))))


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, add-one smoothed; SIDE * SIDE numbers."""
    pairs = samples.select("random", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at")).select("random", (_index(F.col("text"), F.col("at") - 1) * SIDE + _index(F.col("text"), F.col("at"))).alias("pair"))
    counted = {(r.random, r.pair): r.n for r in pairs.groupBy("random", "pair").agg(F.count("*").alias("n")).collect()}  # at most 2 * SIDE * SIDE rows
    ratios = []
    for a in range(SIDE):
        totals = [sum(counted.get((own, a * SIDE + b), 0) for b in range(SIDE)) for own in (True, False)]
        for b in range(SIDE):
            p, q = ((counted.get((own, a * SIDE + b), 0) + 1) / (t + SIDE) for own, t in zip((True, False), totals, strict=True))
            ratios.append(math.log(p / q))
    return ratios


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _spans(text: Column, pattern: str, rank: int, group: int = 0, least: int = 0, runs: bool = False) -> Column:
    """Spans of all matches whose group has at least so many characters, in order; with what they match, if runs are asked for.

    Matches are folded GROUP at a time to places within their group, and groups to their places, so that
    no list grows by one at a time over all matches.
    """
    pieces, matches, own = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0), F.regexp_extract_all(text, F.lit(pattern), group)
    none = F.array().cast(RUNS if runs else SPAN)

    def spans(x: Column) -> Column:
        zipped = F.arrays_zip(F.slice(x["pieces"], 1, F.size(x["matches"])).alias("piece"), x["matches"].alias("match"), x["own"].alias("own"))
        count = F.ceil(F.size(x["matches"]) / GROUP).cast("int")
        return _let(zipped, lambda z: F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda k: placed(F.slice(z, k * GROUP + 1, F.lit(GROUP)))))

    def placed(matches: Column) -> Column:
        """(at, spans) of a group: the length of all of it, and its spans from its beginning."""

        def step(acc: Column, x: Column) -> Column:
            begin = acc["at"] + F.length(x["piece"])
            end = begin + F.length(x["match"])
            span = [begin.cast("int").alias("start"), F.lit(rank).alias("rank"), end.cast("int").alias("end")]
            span = F.struct(*span, x["match"].alias("run")) if runs else F.struct(*span)
            return F.struct(end.cast("int").alias("at"), F.when(F.length(x["own"]) >= least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

        return F.aggregate(matches, F.struct(F.lit(0).alias("at"), none.alias("spans")), step)

    def moved(groups: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all"))
        starts = F.aggregate(groups, begin, lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all")), lambda acc: acc["all"])

        def shifted(g: Column, at: Column) -> Column:
            fields = lambda s: [(s["start"] + at).alias("start"), s["rank"].alias("rank"), (s["end"] + at).alias("end"), *([s["run"].alias("run")] if runs else [])]
            return F.transform(g["spans"], lambda s: F.struct(*fields(s)))

        return F.flatten(F.zip_with(groups, starts, shifted))

    return _let(_let(F.struct(pieces.alias("pieces"), matches.alias("matches"), own.alias("own")), spans), moved)


def _meets(spans: Column, s: Column) -> Column:
    """Whether a span meets one of a kind's, which are apart from each other and in order: the last that starts before its end tells, and halving finds it."""
    halved = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def step(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        before = spans[F.least(middle, F.size(spans) - 1)]["start"] < s["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))
    # as many start before the end as the last one's number
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(_let(F.aggregate(steps, halved, step, lambda acc: acc["low"]), lambda n: (n > 0) & (F.get(spans, n - 1)["end"] > s["start"])))


def _ratio(run: Column, table: Column) -> Column:
    """Log-likelihood ratio of a run: one fold over its characters, each beside the place of the one before."""
    start = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))

    def step(acc: Column, c: Column) -> Column:
        at = F.instr(F.lit(ALPHABET), c)
        return F.struct(at.alias("last"), (acc["total"] + F.element_at(table, acc["last"] * SIDE + at + 1)).alias("total"))

    return F.aggregate(F.split(run, ""), start, step, lambda acc: acc["total"])


def _joined(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, ratios: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every document.

    A null text counts as empty, and a text is read whole: work grows with its length and its number of
    matches. Spans of different strict kinds may overlap; a Markov span
    overlaps none. A repeated row gives a row each time; other columns are ignored; an empty
    table gives an empty result.
    """
    ratios = ratios or train(labelled_samples(docs.sparkSession))
    text, none = F.col("text"), F.array().cast(SPAN)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        "text",
        F.when(text.rlike(ASSIGN), _spans(text, ASSIGN, 0, 2, 6)).otherwise(none).alias("assign"),
        F.when(text.rlike(ACCESS), _spans(text, ACCESS, 1)).otherwise(none).alias("access"),
        F.when(text.rlike(HEX), _spans(text, HEX, 2)).otherwise(none).alias("hex"),
        F.when(text.rlike(CANDIDATE), _spans(text, CANDIDATE, 3, runs=True)).otherwise(F.array().cast(RUNS)).alias("runs"),
    )
    based = found.withColumn("base", F.concat("assign", "access", "hex"))
    table = F.array(*map(F.lit, ratios))

    def random(s: Column) -> Column:
        apart = ~(_meets(F.col("assign"), s) | _meets(F.col("access"), s) | _meets(F.col("hex"), s))
        return mixed(s["run"]) & (_ratio(s["run"], table) / (s["end"] - s["start"]) >= threshold) & apart

    def bare(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))

    spans = based.withColumn("all", F.concat("base", F.when(F.size("runs") > 0, F.transform(F.filter("runs", random), bare)).otherwise(none)))
    return spans.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.col("all")).alias("spans"),
    )
