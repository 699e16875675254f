"""Text metrics of the evaluation: edit similarity, soft entity F1, circle-mark F1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import text as T


def similarity(distance: Column, longest: Column, when_empty: float) -> Column:
    return F.when(longest == 0, F.lit(when_empty)).otherwise(1 - distance / longest)


def edit_texts(gt: Column | str, pred: Column | str) -> tuple[Column, Column]:
    """Both sides as they are compared in the first two phases."""
    return T.one_line(T.strip_markup(gt)), T.one_line(T.strip_markup(pred))


def ned(gt: Column | str, pred: Column | str) -> Column:
    """Normalized edit similarity of the first two phases, 0 if both sides are empty. Wildcards
    in gt aren't honoured here; ``with_ned`` does that."""
    g, p = edit_texts(gt, pred)
    return similarity(F.levenshtein(g, p), F.greatest(F.length(g), F.length(p)), 0.0)


#: Bits of a word of the distance table's column, so that sums of two words fit a long.
WORD = 60
FULL = (1 << WORD) - 1


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _shifted(bits: Column | int, by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(bits).cast("long"), by.cast("int"))


def _index(entries: Column) -> Column:
    """map from key to the numbers beside it, in order, of array<struct(key, at)>, by one sort."""

    def grouped(x: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(x) - 1), lambda k: (k == 0) | (x[k]["key"] != F.get(x, k - 1)["key"]))
        lists = lambda s: F.transform(s, lambda k, t: F.transform(F.slice(x, k + 1, F.coalesce(F.get(s, t + 1), F.size(x)) - k), lambda e: e["at"]))
        return _let(starts, lambda s: F.map_from_arrays(F.transform(s, lambda k: x[k]["key"]), lists(s)))

    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<array<int>>"))
    return _let(F.array_sort(entries), lambda x: F.when(F.size(x) == 0, none).otherwise(grouped(x)))


def _places(index: Column, words: Column, c: Column) -> Column:
    """Bit words of the places of a character, and of the wildcards."""
    own = lambda key: F.coalesce(F.try_element_at(index, key), F.array().cast("array<int>"))
    bits = lambda found, k: F.aggregate(found, F.lit(0).cast("long"), lambda a, at: F.when(F.floor(at / WORD) == k, a.bitwiseOR(_shifted(1, F.pmod(at, F.lit(WORD))))).otherwise(a))
    return _let(F.concat(own(c), F.when(c == "#", F.array().cast("array<int>")).otherwise(own(F.lit("#")))), lambda found: F.transform(words, lambda k: bits(found, k)))


def wildcard_distance(gt: Column, pred: Column) -> Column:
    """Edit distance in which # in gt stands for any one character.

    A column of the distance table is held as bits, which tell where it rises and falls downwards, in words of WORD
    rows. A character of pred moves all words on, each handing to the next whether its last row rose or fell.
    """
    zero = F.lit(0).cast("long")

    def moved(acc: Column, word: Column, equal: Column, top: Column) -> Column:
        """A word (rises, falls) after the change that comes from above."""
        rises, falls = word["rises"], word["falls"]
        up, down = (F.when(acc["change"] == sign, F.lit(1).cast("long")).otherwise(zero) for sign in (1, -1))

        def crossed(same: Column) -> Column:
            return _let(same.bitwiseAND(rises) + rises, lambda total: _let(total.bitwiseXOR(rises).bitwiseOR(same), level))

        def level(ways: Column) -> Column:
            right = falls.bitwiseOR(F.bitwise_not(ways.bitwiseOR(rises)).bitwiseAND(FULL))
            return _let(F.struct(right.alias("right"), rises.bitwiseAND(ways).alias("left")), lower)

        def lower(x: Column) -> Column:
            change = F.call_function("getbit", x["right"], top) - F.call_function("getbit", x["left"], top)
            right, left = _shifted(x["right"], F.lit(1)).bitwiseOR(up).bitwiseAND(FULL), _shifted(x["left"], F.lit(1)).bitwiseOR(down).bitwiseAND(FULL)
            still = equal.bitwiseOR(falls)
            after = _let(right, lambda r: F.struct(left.bitwiseOR(F.bitwise_not(still.bitwiseOR(r)).bitwiseAND(FULL)).alias("rises"), r.bitwiseAND(still).alias("falls")))
            return F.struct(change.cast("int").alias("change"), F.concat(acc["words"], F.array(after)).alias("words"))

        return _let(equal.bitwiseOR(down), crossed)

    def distance(x: Column) -> Column:
        fresh = F.transform(x["tops"], lambda t: F.struct(F.lit(FULL).alias("rises"), zero.alias("falls")))

        def step(acc: Column, c: Column) -> Column:
            start = F.struct(F.lit(1).alias("change"), F.slice(acc["words"], 1, 0).alias("words"))
            swept = lambda equal: F.aggregate(x["words"], start, lambda a, k: moved(a, acc["words"][k], equal[k], x["tops"][k]))
            return _let(_let(F.element_at(x["places"], c), swept), lambda m: F.struct((acc["distance"] + m["change"]).alias("distance"), m["words"].alias("words")))

        return F.aggregate(x["p"], F.struct(F.size(x["g"]).alias("distance"), fresh.alias("words")), step, lambda acc: acc["distance"])

    def tabled(x: Column) -> Column:
        last = F.size(x["g"]) - 1
        words = F.sequence(F.lit(0), F.floor(last / WORD).cast("int"))
        tops = F.transform(words, lambda k: F.least(last - k * WORD, F.lit(WORD - 1)).cast("int"))
        index = _index(F.transform(x["g"], lambda c, i: F.struct(c.alias("key"), i.alias("at"))))
        kinds = F.array_distinct(x["p"])
        places = lambda found: F.map_from_arrays(kinds, F.transform(kinds, lambda c: _places(found, words, c)))
        return F.struct(x["g"].alias("g"), x["p"].alias("p"), words.alias("words"), tops.alias("tops"), _let(index, places).alias("places"))

    texts = F.struct(T.chars(gt).alias("g"), T.chars(pred).alias("p"))
    return F.when(F.length(gt) == 0, F.length(pred)).when(F.length(pred) == 0, F.length(gt)).otherwise(_let(texts, lambda x: _let(tabled(x), distance)))


def with_ned(df: DataFrame, gt: str, pred: str, out: str = "ned") -> DataFrame:
    """df with edit distance, longest length and similarity; wildcards in gt are honoured."""
    g, p = edit_texts(gt, pred)
    sided = df.withColumn("_g", g).withColumn("_p", p)
    distance = F.when(F.col("_g").contains("#"), wildcard_distance(F.col("_g"), F.col("_p"))).otherwise(F.levenshtein("_g", "_p"))
    both = sided.withColumn("edit_distance", distance).withColumn("longest", F.greatest(F.length("_g"), F.length("_p")))
    return both.withColumn(out, similarity(F.col("edit_distance"), F.col("longest"), 0.0)).drop("_g", "_p")


def main_text_ned(gt: Column | str, pred: Column | str) -> Column:
    """Similarity of the Han main text, 1 if both sides are empty."""
    return _sides(T.main_text(gt), T.main_text(pred), lambda g, p: similarity(F.levenshtein(g, p), F.greatest(F.length(g), F.length(p)), 1.0))


def f1(hits: Column, n_gt: Column, n_pred: Column) -> Column:
    """F1 from summed hits: 1 if both sides are empty, 0 if one is."""
    def body(x: Column) -> Column:
        n_gt, n_pred, hits = x["n_gt"], x["n_pred"], x["hits"]
        p, r = hits / n_pred, hits / n_gt
        return F.when((n_gt == 0) & (n_pred == 0), 1.0).when((n_gt == 0) | (n_pred == 0) | (hits <= 0), 0.0).otherwise(2 * p * r / (p + r))

    # a branch would work out its own hits each time that it names them
    return _let(F.struct(hits.alias("hits"), n_gt.alias("n_gt"), n_pred.alias("n_pred")), body)


def _sides(gt: Column, pred: Column, body) -> Column:
    """body of two values that are computed once."""
    return _let(F.struct(gt.alias("g"), pred.alias("p")), lambda x: body(x["g"], x["p"]))


def set_f1(gt: Column, pred: Column) -> Column:
    return _sides(gt, pred, lambda g, p: f1(F.size(F.array_intersect(g, p)), F.size(g), F.size(p)))


def entity_score(gt: Column, pred: Column, threshold: float = 0.5) -> Column:
    """F1 of the character sets of two entities, 0 below the threshold."""
    score = set_f1(F.array_distinct(T.chars(gt)), F.array_distinct(T.chars(pred)))
    return F.when((F.length(gt) == 0) & (F.length(pred) == 0), 1.0).when(score >= threshold, score).otherwise(0.0)


def _signed(entities: Column) -> Column:
    """Entities as (at, set, n, bits): their distinct characters, how many, and a bit for each of 64 kinds of them."""

    def one(e: Column, at: Column) -> Column:
        return _let(F.array_distinct(T.chars(e)), lambda x: F.struct(at.alias("at"), x.alias("set"), F.size(x).alias("n"), bits(x).alias("bits")))

    bits = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(_shifted(1, F.pmod(F.hash(c), F.lit(64)))))
    return F.transform(entities, one)


def _may_match(a: Column, b: Column, threshold: float) -> Column:
    """Whether two entities can reach the threshold: a kind that only one of them has stands for a character that they don't share."""
    shared = F.least(a["n"] - F.bit_count(a["bits"].bitwiseAND(F.bitwise_not(b["bits"]))), b["n"] - F.bit_count(b["bits"].bitwiseAND(F.bitwise_not(a["bits"]))))
    return ((a["n"] == 0) & (b["n"] == 0)) | ((shared > 0) & (2 * shared >= F.lit(threshold - 1e-9) * (a["n"] + b["n"])))


def best_matches(gt: Column, pred: Column, threshold: float = 0.5) -> Column:
    """Greedy one-to-one matches array<struct(i, j, score)>: best score first, ties by (i, j).

    Only pairs are made that share one of the rarer characters, by an index from characters to entities, and whose
    kinds of characters let them reach the threshold. Taken entities are bits of words.
    """

    def scored(g: Column, p: Column) -> Column:
        score = F.when((g["n"] == 0) & (p["n"] == 0), 1.0).otherwise(set_f1(g["set"], p["set"]))
        return F.struct((-F.when(score >= threshold, score).otherwise(0.0)).alias("less"), g["at"].alias("i"), p["at"].alias("j"))

    keys = lambda e: F.when(e["n"] == 0, F.array(F.lit(""))).otherwise(e["set"])

    def pairs(sides: Column) -> Column:
        g, p = sides["g"], sides["p"]
        entries = F.flatten(F.transform(p, lambda e: F.transform(keys(e), lambda c: F.struct(c.alias("key"), e["at"].alias("at")))))
        own = lambda index, c: F.coalesce(F.try_element_at(index, c), F.array().cast("array<int>"))

        def met(index: Column, e: Column) -> Column:
            # so many characters, the rarest, that any entity that can match shares one of them
            least = F.ceil(F.lit(threshold / (2 - threshold) - 1e-9) * e["n"])
            rare = F.slice(F.array_sort(F.transform(keys(e), lambda c: F.struct(F.size(own(index, c)).alias("found"), c.alias("key")))), 1, F.greatest(F.lit(1), e["n"] - least + 1).cast("int"))
            near = F.transform(F.array_distinct(F.flatten(F.transform(rare, lambda c: own(index, c["key"])))), lambda at: p[at])
            return F.transform(F.filter(near, lambda x: _may_match(e, x, threshold)), lambda x: scored(e, x))

        return _let(_index(entries), lambda index: F.flatten(F.transform(g, lambda e: met(index, e))))

    ordered = F.array_sort(F.filter(_let(F.struct(_signed(gt).alias("g"), _signed(pred).alias("p")), pairs), lambda s: s["less"] < 0))
    free = lambda side: F.array_repeat(F.lit(0).cast("long"), (F.size(side) / 64).cast("int") + 1)
    start = F.struct(free(gt).alias("i"), free(pred).alias("j"), F.array().cast("array<struct<i:int,j:int,score:double>>").alias("matches"))
    word = lambda n: F.floor(n / 64).cast("int")
    taken = lambda bits, n: F.call_function("getbit", bits[word(n)], F.pmod(n, F.lit(64))) == 1
    take = lambda bits, n: F.transform(bits, lambda w, k: F.when(k == word(n), w.bitwiseOR(_shifted(1, F.pmod(n, F.lit(64))))).otherwise(w))

    def step(acc: Column, s: Column) -> Column:
        match = F.struct(s["i"].alias("i"), s["j"].alias("j"), (-s["less"]).alias("score"))
        more = F.struct(take(acc["i"], s["i"]).alias("i"), take(acc["j"], s["j"]).alias("j"), F.concat(acc["matches"], F.array(match)).alias("matches"))
        return F.when(taken(acc["i"], s["i"]) | taken(acc["j"], s["j"]), acc).otherwise(more)

    return F.aggregate(ordered, start, step, lambda acc: acc["matches"])


def soft_f1(gt: Column, pred: Column, threshold: float = 0.5) -> Column:
    """Soft F1 of two lists of entities."""
    total = lambda g, p: F.aggregate(best_matches(g, p, threshold), F.lit(0.0), lambda a, m: a + m["score"])
    return _sides(gt, pred, lambda g, p: f1(total(g, p), F.size(g), F.size(p)))


def ner_f1(gt: Column | str, pred: Column | str, threshold: float = 0.5) -> Column:
    return soft_f1(T.entities(gt), T.entities(pred), threshold)


def circle_strict(gt: Column, pred: Column) -> Column:
    """F1 of two lists of (ch, mark) as multisets."""

    def both(g: Column, p: Column) -> Column:
        return F.aggregate(F.array_distinct(g), F.lit(0), lambda a, x: a + F.least(F.size(F.filter(g, lambda y: y == x)), F.size(F.filter(p, lambda y: y == x))))

    return _sides(gt, pred, lambda g, p: f1(both(g, p), F.size(g), F.size(p)))


def circle_lenient(gt: Column, pred: Column) -> Column:
    """F1 of the sets of circled characters."""
    return set_f1(T.circled_characters(gt), T.circled_characters(pred))
