"""Text, metric and reward functions against hand-computed values and plain restatements."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import rewards as R
from quire.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'array<string>' if isinstance(v, list) else 'double'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def many(spark, function, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


def test_strip_markup(spark):
    texts = ["<footnote>甲</footnote>【乙】＜丙＞<丁戊>己●。，a.b-c_〇", None, ""]
    assert many(spark, T.strip_markup, texts) == ["甲乙丙己ab-c_〇", "", ""]


def test_entities_in_tag_order(spark):
    assert many(spark, T.entities, ["【一】<head>二\n三</head><footnote>四</footnote>", None]) == [["四", "二\n三", "一"], []]


def test_comments_and_notes(spark):
    assert many(spark, T.top_comments, ["＜甲＞乙<丙>"]) == [["甲", "丙"]]
    assert many(spark, T.inline_notes, ["甲【乙】【】"]) == [["乙", ""]]


def test_han_ranges(spark):
    assert many(spark, T.strip_to_han, ["a一𠀀㐀〇é。", None]) == ["一𠀀㐀", ""]


@pytest.mark.parametrize(
    ("text", "pairs"),
    [
        ("甲○●◎", [("甲", "。"), ("甲", "●")]),
        ("●甲】\n。乙、甲〇甲。", [("甲", "。"), ("乙", "、"), ("甲", "。")]),
        ("abc", []),
        ("𠀀△", [("𠀀", "△")]),
    ],
)
def test_circle_pairs(spark, text, pairs):
    assert [tuple(p) for p in many(spark, T.circle_pairs, [text])[0]] == pairs


def test_ned(spark):
    rows = spark.createDataFrame([(0, "甲乙丙", "甲丁丙"), (1, "", ""), (2, None, "甲"), (3, "甲#丙", "甲丁丙"), (4, "#", "。")], "i int, g string, p string")
    got = {r.i: r.ned for r in M.with_ned(rows, "g", "p").collect()}
    # the function's # is itself no punctuation, while the full stop is stripped
    assert got == {0: pytest.approx(2 / 3), 1: 0.0, 2: 0.0, 3: 1.0, 4: 0.0}


def plain_wildcard(g, p):
    row = list(range(len(p) + 1))
    for i, a in enumerate(g, 1):
        last, row = row, [i]
        for j, b in enumerate(p, 1):
            row.append(last[j - 1] if a in (b, "#") else 1 + min(last[j], row[j - 1], last[j - 1]))
    return row[-1]


def test_wildcard_distance_against_table(spark):
    r = random.Random(5)
    text = lambda letters, most: "".join(r.choice(letters) for _ in range(r.randrange(most)))
    cases = [(text("ab#c", 9), text("abcd", 9)) for _ in range(300)] + [(text("甲乙#丙𠀀", 200), text("甲乙丙𠀀", 200)) for _ in range(40)]
    cases += [("a" * n + "#" * k, "b" * n) for n in (59, 60, 61, 120, 121) for k in (0, 1, 60)]
    rows = spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(cases)], "i int, g string, p string")
    got = {x.i: x.d for x in rows.select("i", M.wildcard_distance(F.col("g"), F.col("p")).alias("d")).collect()}
    assert got == {i: plain_wildcard(g, p) for i, (g, p) in enumerate(cases)}


def test_distances_need_no_python(spark):
    plan = M.with_ned(spark.createDataFrame([("a#", "b")], "g string, p string"), "g", "p")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and plan.count("Scan ") == 1


def test_main_text_ned_of_nothing_is_one(spark):
    assert one(spark, M.main_text_ned("g", "p"), g="<甲>", p="【乙】") == 1.0


def plain_soft_f1(gs, ps, threshold):
    def score(a, b):
        a, b = set(a), set(b)
        if not a and not b:
            return 1.0
        hits = len(a & b)
        if not hits:
            return 0.0
        f = 2 * (hits / len(b)) * (hits / len(a)) / (hits / len(b) + hits / len(a))
        return f if f >= threshold else 0.0

    if not gs and not ps:
        return 1.0
    if not gs or not ps:
        return 0.0
    pool = sorted(((-score(g, p), i, j) for i, g in enumerate(gs) for j, p in enumerate(ps) if score(g, p) > 0))
    used_i, used_j, total = set(), set(), 0.0
    for s, i, j in pool:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            total -= s
    p, r = total / len(ps), total / len(gs)
    return 2 * p * r / (p + r) if p + r else 0.0


def test_soft_f1_against_plain(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("甲乙丙丁戊") for _ in range(r.randrange(5)))
    cases = [(i, [word() for _ in range(r.randrange(5))], [word() for _ in range(r.randrange(5))]) for i in range(60)]
    rows = spark.createDataFrame(cases, "i int, g array<string>, p array<string>")
    got = {x.i: x.f for x in rows.select("i", M.soft_f1(F.col("g"), F.col("p"), 0.3).alias("f")).collect()}
    for i, g, p in cases:
        assert got[i] == pytest.approx(plain_soft_f1(g, p, 0.3)), (g, p)


def test_soft_f1_of_many_entities(spark):
    r = random.Random(9)
    word = lambda: "".join(chr(r.randrange(0x4E00, 0x4E00 + 3000)) for _ in range(r.randrange(1, 9)))
    gs = [word() for _ in range(2000)]
    ps = [g if r.random() < 0.3 else g[:-1] + word()[:1] if r.random() < 0.6 else word() for g in gs]
    r.shuffle(ps)
    rows = spark.createDataFrame([(gs, ps)], "g array<string>, p array<string>")
    began = time.perf_counter()
    got = rows.select(M.soft_f1(F.col("g"), F.col("p"), 0.5).alias("f")).first().f
    assert time.perf_counter() - began < 30
    assert got == pytest.approx(plain_soft_f1(gs, ps, 0.5))


def test_matches_are_one_to_one(spark):
    rows = spark.createDataFrame([(["甲乙", "甲"], ["甲", "甲乙", "甲"])], "g array<string>, p array<string>")
    matches = rows.select(M.best_matches(F.col("g"), F.col("p")).alias("m")).first().m
    assert [(m.i, m.j) for m in matches] == [(0, 1), (1, 0)]


def test_circle_f1(spark):
    pair = lambda c: T.circle_pairs(c)
    assert one(spark, M.circle_strict(pair("g"), pair("p")), g="甲。乙。", p="甲●乙。") == 0.5
    assert one(spark, M.circle_lenient(pair("g"), pair("p")), g="甲。乙。", p="甲●乙。") == 1.0
    assert one(spark, M.circle_strict(pair("g"), pair("p")), g="甲", p="乙") == 1.0
    assert one(spark, M.circle_strict(pair("g"), pair("p")), g="甲。", p="乙") == 0.0


@pytest.mark.parametrize(("text", "reward"), [("甲", 1), ("【a】<b>", 1), ("【a<b", 1), ("【a<b>", 0), ("【a<b】>", 0), ("】", 0), ("OCR: 【", 1), (None, 1), ("【】<【", 1)])
def test_format_reward(spark, text, reward):
    assert many(spark, R.format_reward, [text]) == [float(reward)]


@pytest.mark.parametrize(
    ("text", "severity"),
    [("【上】【上】【上】", 0.6), ("甲甲甲甲甲", 0.25), ("甲乙甲乙甲乙甲乙", 0.6), ("大\n大\n大", 0.8), ("大\\n大\\n大", 0.8), ("a\nb\na\nb\na\nb\na\nc\na\nd", 0.8), ("。、。、。", 0.2), ("", 0), (None, 0), ("　甲　", 0), ("。。。。。。。。", 1.0)],
)
def test_repetition(spark, text, severity):
    assert many(spark, R.repetition, [text])[0] == pytest.approx(severity)


def plain_repetition(t):
    import re

    t = t.strip()
    lines = [x.strip() for x in t.replace("\\n", "\n").replace("\\f", "\n").split("\n") if x.strip()]
    run = best = 0
    for i, x in enumerate(lines):
        run = run + 1 if i and lines[i - 1] == x else 1
        best = max(best, run)
    most = max(Counter(lines).values(), default=0)
    bare = re.sub("[【】<>]", "", t)
    return (
        bool(re.search(r"(【[^】]{1,8}】|<[^>]{1,8}>)(?:\1){2,}", t)), bool(re.search(r"(.)\1{4,}", t)), bool(re.search(f"[{R.FLOOD}]{{5,}}", t)),
        bool(re.search(r"([^\s【】<>]{2,12})(?:\1){3,}", bare)), best >= 3, len(lines) >= 6 and most >= 5 and most / len(lines) >= 0.35,
    )


def test_repetition_parts_against_plain(spark):
    r = random.Random(9)
    texts = ["".join(r.choice(["甲", "乙", "\n", "【上】", "<b>", "。", "\\n", "甲乙", "　"]) for _ in range(r.randrange(30))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", *(c.alias(k) for k, c in R.repetition_parts("t").items())).orderBy("i").collect()
    for row, t in zip(got, texts, strict=True):
        assert tuple(row)[1:] == plain_repetition(t), repr(t)


@pytest.mark.parametrize(("han", "gate"), [(4, 0.2), (5, 0.2), (59, 0.2 + 0.8 * 54 / 55), (60, 1.0)])
def test_length_gate(spark, han, gate):
    assert spark.range(1).select(R.length_gate(F.lit(han)).alias("x")).first().x == pytest.approx(gate)


def test_model_reward(spark):
    rows = spark.createDataFrame([(0, "一二三四", [0.0]), (1, "一二三四五", []), (2, "一二三四五", [0.0, 0.5]), (3, "一二三四五", [1.0]), (4, "OCR: 一二三四五", None)], "i int, c string, p array<double>")
    assert [r.x for r in rows.select("i", R.model_reward("c", F.col("p")).alias("x")).orderBy("i").collect()] == [0.2, 0.0, pytest.approx(0.625), 0.05, 0.0]


def test_readable_tags(spark):
    assert many(spark, T.readable_tags, ["a\\nb<head>c\n</head><footnote>d</footnote><head>e\n\n\n\n"]) == ["a\nb<c\n>【d】<e"]


def test_flatten_brackets(spark):
    texts = ["【a【b】c】", "【a＜b＞c】", "a】b", "【a", "＜a【b】＞", "＜a＜b＞c＞", "【a\nb】", None]
    assert many(spark, T.flatten_brackets, texts) == ["【abc】", "【abc】", "ab", "【a】", "＜ab＞", "＜ab＞c", "【a\nb】", ""]


def test_measure_line(spark):
    assert many(spark, T.measure_line, ["甲【乙丙丁】●＜戊己＞庚", "【】", "甲", "【乙丙", "乙】", None]) == [4, 0, 1, 1, 1, 0]


def test_paths(spark):
    paths = ["a/【一期】/12.png", "x/实拍图/k/三期/7.jpg", "a/b/c.png", "【二期】12a.png", None]
    assert many(spark, T.detect_period, paths) == ["一期", "三期", None, "二期", None]
    assert many(spark, T.extract_sequence, paths) == [12, 7, None, None, None]


def test_colours_and_names(spark):
    got = many(spark, T.parse_colour, ["Red", "rgb(255,0,51)", "#ff0033", "x", None])
    assert [tuple(round(v, 3) for v in c) for c in got] == [(1, 0, 0), (1, 0, 0.2), (1, 0, 0.2), (0, 0, 0), (0, 0, 0)]
    assert many(spark, T.valid_layout_id, ["a_b-1", "a b", ""]) == [True, False, False]
    assert many(spark, T.base_name, ["a.b.png", "x"]) == ["a.b", "x"]


def test_completion_shapes(spark):
    raw = ['"a"', '["b", "x"]', '{"content": "c"}', '[{"content": [{"type": "image"}, {"type": "text", "text": "d"}]}]', "[]", "{}"]
    rows = spark.createDataFrame(list(enumerate(raw)), "i int, t string").withColumn("v", F.parse_json("t"))
    assert [r.x for r in rows.select("i", T.completion_text(F.col("v")).alias("x")).orderBy("i").collect()] == ["a", "b", "c", "d", "", ""]


def test_sides_of_a_metric_are_computed_once(spark):
    df = spark.createDataFrame([("a b", "b c")], "g string, p string")
    g, p = (F.regexp_extract_all(c, F.lit("[a-z]"), 0) for c in ("g", "p"))
    for metric in (M.set_f1(g, p), M.soft_f1(g, p)):
        shown = df.select(metric.alias("x"))
        assert shown._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(") == 2
        assert shown.first().x == 0.5
    assert df.select(M.main_text_ned("g", "p").alias("x"))._jdf.queryExecution().analyzed().toString().count("translate(") == 2
