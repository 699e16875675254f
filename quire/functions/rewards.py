"""Quality scores of generated text: brackets, repetition, length, and their combination.

Weights and limits are arguments; the defaults are the published ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import text as T


def model_reward(completion: Column | str, probabilities: Column, high: float = 0.95) -> Column:
    """From an external classifier's error probability of each character: 0.2 for fewer than five
    Han characters, 0 without probabilities, else one minus penalties, 0.05 at least."""
    n = F.size(probabilities)
    rate = F.size(F.filter(probabilities, lambda p: p >= high)) / n
    mean = F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p) / n
    return (
        F.when(F.length(T.han_of_completion(completion)) < 5, 0.2)
        .when(probabilities.isNull() | (n == 0), 0.0)
        .otherwise(F.greatest(F.lit(0.05), 1 - 4.0 * rate - 1.5 * mean))
    )


def format_reward(completion: Column | str) -> Column:
    """1 if 【】 and <> are balanced, openers cut off at the very end aside; else 0.

    With the openers at the end taken off, the symbols must cancel out: a stack holds what is
    open, and a wrong closer spoils it for good.
    """
    symbols = F.regexp_replace(F.regexp_replace(T.without_prompt(completion), "[^【】<>]", ""), "[【<]+$", "")

    def step(stack: Column, s: Column) -> Column:
        top = F.substring(stack, F.length(stack), F.lit(1))
        closes = ((s == "】") & (top == "【")) | ((s == ">") & (top == "<"))
        return F.when(stack == "!", stack).when(F.lit("【<").contains(s), F.concat(stack, s)).when(closes, stack.substr(F.lit(1), F.length(stack) - 1)).otherwise("!")

    return F.when(F.aggregate(T.chars(symbols), F.lit(""), step) == "", 1.0).otherwise(0.0)


def lines_of(completion: Column | str) -> Column:
    """Stripped lines that aren't blank; literal \\n and \\f break lines too."""
    broken = F.replace(F.replace(T.strip_space(completion), F.lit("\\n"), F.lit("\n")), F.lit("\\f"), F.lit("\n"))
    return F.filter(F.transform(F.split(broken, "\n"), T.strip_space), lambda line: line != "")


def longest_line_run(lines: Column) -> Column:
    """Length of the longest run of equal lines."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when(acc["last"] == line, acc["run"] + 1).otherwise(1)
        return F.struct(line.alias("last"), run.cast("int").alias("run"), F.greatest(acc["best"], run).cast("int").alias("best"))

    return F.aggregate(lines, start, step, lambda acc: acc["best"])


def most_frequent_line(lines: Column) -> Column:
    """How often the most frequent line occurs: the longest run after sorting."""
    return longest_line_run(F.sort_array(lines))


#: Characters whose runs count as punctuation flooding, fixed values.
FLOOD = "○●□■△▲◎〇。、，；：！？…—～"


#: Severity of each kind.
SEVERITY = {"tag": 0.60, "char": 0.25, "flood": 0.20, "phrase": 0.60, "line_run": 0.80, "line_share": 0.80}


def _let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _kinds(text: Column, lines: Column) -> dict[str, Column]:
    """Each kind of degenerate repetition, of a stripped text and its lines."""
    bare = F.translate(text, "【】<>", "")
    n, most = F.size(lines), most_frequent_line(lines)
    return {
        "tag": text.rlike(r"(【[^】]{1,8}】|<[^>]{1,8}>)(?:\1){2,}"),
        "char": text.rlike(r"(?d)(.)\1{4,}"),
        "flood": text.rlike(f"[{FLOOD}]{{5,}}"),
        "phrase": bare.rlike(r"(?U)([^\s【】<>]{2,12})(?:\1){3,}"),
        "line_run": longest_line_run(lines) >= 3,
        "line_share": (n >= 6) & _let(most, lambda m: (m >= 5) & (m / n >= 0.35)),
    }


def repetition_parts(completion: Column | str) -> dict[str, Column]:
    """Each kind of degenerate repetition as a boolean, for those who want some of them."""
    return _kinds(T.strip_space(completion), lines_of(completion))


def repetitions(completion: Column | str) -> Column:
    """struct of each kind of degenerate repetition and severity, their summed one, 1 at most: text and lines are read once."""
    text = F.col(completion) if isinstance(completion, str) else completion

    def found(x: Column) -> Column:
        return F.struct(*(kind.alias(name) for name, kind in _kinds(x["text"], x["lines"]).items()))

    def weighed(kinds: Column) -> Column:
        total = F.lit(0.0)
        for name, weight in SEVERITY.items():
            total = total + F.when(kinds[name], weight).otherwise(0.0)
        return F.struct(*(kinds[name].alias(name) for name in SEVERITY), F.least(total, F.lit(1.0)).alias("severity"))

    read = _let(text, lambda t: _let(T.strip_space(t), lambda s: F.struct(s.alias("text"), lines_of(s).alias("lines"))))
    return _let(_let(read, found), weighed)


def repetition(completion: Column | str) -> Column:
    """Summed severity, 1 at most."""
    return repetitions(completion)["severity"]


def length_gate(han: Column, least: int = 60) -> Column:
    """Factor from the number of Han characters: 0.2 below five, then linear up to 1 at ``least``."""
    return F.when(han < 5, 0.2).when(han < least, 0.2 + 0.8 * (han - 5) / max(1, least - 5)).otherwise(1.0)


def combined_reward(model: Column, form: Column, repeated: Column, gate: Column, model_weight: float = 0.7, format_weight: float = 0.3, repetition_weight: float = 0.35) -> Column:
    """Weighted sum times the length factor, from 0 to 1; repetition also discounts the model's part."""
    effective = model * (1 - 0.3 * repeated)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (model_weight * effective + format_weight * form - repetition_weight * repeated) * gate))
