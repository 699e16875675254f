"""Evaluation: predictions against ground truth, metrics by phase, summary, ranking and pivot.

Means come from exact sums, so they don't depend on the order of tasks; nothing is rounded before
``report``.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T
from quire.session import spread

#: Phases, and the columns of the final one.
FIRST, THIRD = ("一期", "二期"), "三期"
PERIODS = ("一期", "二期", "三期-严格", "三期-宽松")


def last_of_each(gt: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last in an explicit order."""
    kept = [c for c in gt.columns if c != key]
    return gt.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_row")).select(key, "_row.*")


def ground_truth(gt: DataFrame, order: str | None = None) -> DataFrame:
    """(index, answer, from) with one row for each index, null answers as empty ones."""
    one = last_of_each(gt, "index", order) if order else gt.dropDuplicates(["index"])
    return one.filter("index is not null").select(F.col("index").cast("long").alias("index"), F.coalesce("answer", F.lit("")).alias("answer"), "from")


def succeeded(ok: Column | str = "ok", finish: Column | str = "finish_reason") -> Column:
    ok, finish = (F.col(c) if isinstance(c, str) else c for c in (ok, finish))
    return F.coalesce(ok, F.lit(False)) | F.coalesce(finish == "stop", F.lit(False))


def joined(predictions: DataFrame, gt: DataFrame) -> DataFrame:
    """Predictions with a phase and a known sequence number, beside their answer.

    Spark broadcasts the truth, a benchmark of a few hundred pages, if its bytes are few enough. Predictions are dealt out first, for
    scoring takes long for their bytes.
    """
    known = spread(predictions).withColumn("period", T.detect_period("image")).withColumn("seq", T.extract_sequence("image")).filter("period is not null and seq is not null")
    right = gt.select(F.col("index").alias("seq"), F.col("answer"))
    return known.join(right, "seq").withColumn("pred", F.coalesce("ocr", F.lit(""))).withColumn("success", succeeded())


#: Bits of a part of a value, and how many parts hold it below its whole number.
PART, PARTS = 32, 3


def exact_sum(c: Column | str) -> Column:
    """Sum of doubles, rounded once from the exact sum, whatever the order of rows and tasks; null without values.

    A value is cut into whole numbers of PART bits, which are summed as such. That holds all of a value of up to 2^30 whose last
    bit isn't below 2^-96, as no ratio of counts below 2^43 has; finer bits are left out. The sum may come to 2^30.
    """
    value = F.col(c) if isinstance(c, str) else c
    total = None
    for k in range(PARTS + 1):
        # a double's part above a bit, and what is left below it, are exact
        above = value if k == 0 else (value * 2.0 ** (PART * k)) % F.lit(2.0**PART)
        part = F.sum(F.when(above < 0, F.ceil(above)).otherwise(F.floor(above)).cast("long")).cast("decimal(38,0)")
        total = part if total is None else (total * F.lit(2**PART).cast("decimal(11,0)")).cast("decimal(38,0)") + part
        total = total.cast("decimal(38,0)")
    return total.cast("double") / F.lit(2.0 ** (PART * PARTS))


def mean(c: Column | str) -> Column:
    """Mean over rows that have the value: their exact sum, rounded, by their number."""
    return exact_sum(c) / F.count(c)


def _with_first(samples: DataFrame) -> DataFrame:
    """samples with NED and NER_F1 of successes of the first two phases, null elsewhere."""
    counts = F.col("success") & F.col("period").isin(*FIRST)
    # others are compared as empty texts, which costs nothing, and no scan of their own
    shown = samples.withColumns({f"_{c}": F.when(counts, F.col(c)) for c in ("answer", "pred")})
    scored = M.with_ned(shown, "_answer", "_pred", "NED").withColumn("NER_F1", F.when(counts, M.ner_f1("_answer", "_pred")))
    return scored.withColumn("NED", F.when(counts, F.col("NED"))).drop("_answer", "_pred", "edit_distance", "longest")


def _with_third(samples: DataFrame, ned: str = "NED") -> DataFrame:
    """samples with the five metrics of successes of the third phase, null elsewhere."""
    counts = F.col("success") & (F.col("period") == THIRD)
    pairs = samples.withColumns({"_g": F.when(counts, T.circle_pairs("answer")), "_p": F.when(counts, T.circle_pairs("pred"))})
    metrics = {
        ned: M.main_text_ned("answer", "pred"),
        "圈点严格": M.circle_strict(F.col("_g"), F.col("_p")),
        "圈点宽松": M.circle_lenient(F.col("_g"), F.col("_p")),
        "眉批NER": M.soft_f1(T.top_comments("answer"), T.top_comments("pred"), 0.3),
        "夹注NER": M.soft_f1(T.inline_notes("answer"), T.inline_notes("pred"), 0.5),
    }
    return pairs.withColumns({k: F.when(counts, v) for k, v in metrics.items()}).drop("_g", "_p")


def first_phases(samples: DataFrame) -> DataFrame:
    """Samples of the first two phases with NED and NER_F1; failed ones have neither."""
    return _with_first(samples.filter(F.col("period").isin(*FIRST)))


def third_phase(samples: DataFrame) -> DataFrame:
    """Samples of the third phase with their five metrics; failed ones have none."""
    return _with_third(samples.filter(F.col("period") == THIRD))


def _counts() -> list[Column]:
    return [F.count_if("success").alias("成功"), F.count_if(~F.col("success")).alias("失败")]


def summarize_first(scored: DataFrame) -> DataFrame:
    """Means and score of each model and phase that has a success."""
    means = scored.groupBy("model", "period").agg(*_counts(), mean("NED").alias("NED"), mean("NER_F1").alias("NER_F1")).filter("`成功` > 0")
    return means.withColumn("分数", (0.8 * F.col("NED") + 0.2 * F.col("NER_F1")) * 100).withColumnsRenamed({"model": "模型", "period": "期别"})


def summarize_third(scored: DataFrame) -> DataFrame:
    """Two rows for each model: with strict and with lenient circle scores."""
    names = ("NED", "圈点严格", "圈点宽松", "眉批NER", "夹注NER")
    means = scored.groupBy("model").agg(*_counts(), *(mean(n).alias(n) for n in names)).filter("`成功` > 0")

    def row(kind: str) -> Column:
        score = (0.5 * F.col("NED") + 0.3 * F.col(f"圈点{kind}") + 0.1 * F.col("眉批NER") + 0.1 * F.col("夹注NER")) * 100
        return F.struct(F.lit(f"{THIRD}-{kind}").alias("期别"), F.col(f"圈点{kind}").alias("圈点"), score.alias("分数"))

    both = means.withColumn("_row", F.explode(F.array(row("严格"), row("宽松"))))
    return both.select(F.col("model").alias("模型"), "_row.期别", "成功", "失败", "NED", "_row.圈点", "眉批NER", "夹注NER", "_row.分数")


def summary(samples: DataFrame) -> DataFrame:
    """Sparse summary over all phases: columns that a phase lacks are null. Samples are read and scored once."""
    names = ("NER_F1", "圈点严格", "圈点宽松", "眉批NER", "夹注NER")
    scored = _with_third(_with_first(samples), "_third").withColumn("NED", F.coalesce("NED", "_third"))
    means = scored.groupBy("model", "period").agg(*_counts(), *(mean(n).alias(n) for n in ("NED", *names))).filter("`成功` > 0")

    def row(period: Column, score: Column, circles: Column) -> Column:
        return F.struct(period.alias("期别"), (score * 100).alias("分数"), circles.alias("圈点"))

    first = row(F.col("period"), 0.8 * F.col("NED") + 0.2 * F.col("NER_F1"), F.lit(None).cast("double"))
    third = [row(F.lit(f"{THIRD}-{k}"), 0.5 * F.col("NED") + 0.3 * F.col(f"圈点{k}") + 0.1 * F.col("眉批NER") + 0.1 * F.col("夹注NER"), F.col(f"圈点{k}")) for k in ("严格", "宽松")]
    rows = F.explode(F.when(F.col("period") == THIRD, F.array(*third)).otherwise(F.array(first)))
    return means.withColumn("_row", rows).select(F.col("model").alias("模型"), "_row.期别", "成功", "失败", "NED", "NER_F1", "_row.分数", "_row.圈点", "眉批NER", "夹注NER")


def union_sparse(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def ranked(summaries: DataFrame) -> DataFrame:
    """Rank from 1 in each phase by falling score; ties by model."""
    return summaries.withColumn("名次", F.row_number().over(Window.partitionBy("期别").orderBy(F.desc("分数"), "模型")))


def kind_of(model: Column | str = "模型") -> Column:
    return F.when((F.col(model) if isinstance(model, str) else model).startswith("realphoto_"), "实拍").otherwise("原始")


def score_pivot(summaries: DataFrame) -> DataFrame:
    """Scores by model and phase with two decimals, -- where there is none, in two sections."""
    wide = summaries.groupBy(kind_of().alias("类别"), "模型").pivot("期别", list(PERIODS)).agg(F.first("分数"))
    return wide.select("类别", "模型", *(F.when(F.col(f"`{p}`").isNull(), "--").otherwise(F.format_string("%.2f", F.round(F.col(f"`{p}`"), 2))).alias(p) for p in PERIODS))


def report(summaries: DataFrame) -> DataFrame:
    """Rounded for output: means to four places, scores to two."""
    return summaries.select(*(F.round(c, 2).alias(c) if c == "分数" else F.round(c, 4).alias(c) if t == "double" else F.col(c) for c, t in summaries.dtypes))


def unknown_models(models: list[str], catalog: DataFrame) -> list[str]:
    """Those of the names asked for that the catalog (model, ..) doesn't have."""
    known = {r.model for r in catalog.filter(F.col("model").isin(models)).select("model").distinct().collect()}  # no more than were asked for
    return [m for m in models if m not in known]


def select_models(predictions: DataFrame, models: list[str] | None = None, skip_realphoto: bool = False, catalog: DataFrame | None = None) -> DataFrame:
    """Only the models asked for. Unknown names match nothing; given a catalog, they are warned of."""
    if models is not None and catalog is not None:
        for name in unknown_models(models, catalog):
            warnings.warn(f"unknown model {name!r} is skipped", stacklevel=2)
    out = predictions.filter(F.col("model").isin(models)) if models is not None else predictions
    return out.filter(~F.col("model").startswith("realphoto_")) if skip_realphoto else out


def speed(tokens: Column | str, seconds: Column | str) -> Column:
    """Tokens a second, null where no time has passed."""
    t, s = (F.col(c) if isinstance(c, str) else c for c in (tokens, seconds))
    return F.when(s > 0, t / s)
