"""Evaluation, typesetting, records and sources."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.operators import evaluate as E
from quire.operators import records as Q
from quire.operators import typeset as S
from quire.operators import windows as W
from quire.sources import files


def test_summary_ranking_and_pivot(spark):
    rows = [("m1", "【一期】/1.png", "甲乙", "stop", None), ("m1", "【一期】/2.png", "x", None, False), ("m1", "【三期】/1.png", "甲。", "stop", True), ("realphoto_a", "【一期】/1.png", "甲丁", None, True), ("m2", "【一期】/9.png", "甲", "stop", True), ("m3", "【二期】/1.png", "甲", "length", False)]
    predictions = spark.createDataFrame(rows, "model string, image string, ocr string, finish_reason string, ok boolean")
    truth = spark.createDataFrame([(1, "旧", "f", 0), (1, "甲乙", "f", 1), (2, None, "f", 2)], "index int, answer string, `from` string, at int")
    samples = E.joined(predictions, E.ground_truth(truth, "at"))
    assert samples.count() == 5
    total = E.summary(samples)
    got = {(r["模型"], r["期别"]): r for r in total.collect()}
    assert set(got) == {("m1", "一期"), ("realphoto_a", "一期"), ("m1", "三期-严格"), ("m1", "三期-宽松")}
    assert (got["m1", "一期"]["成功"], got["m1", "一期"]["失败"], got["m1", "一期"]["NED"]) == (1, 1, 1.0)
    assert got["realphoto_a", "一期"]["分数"] == pytest.approx((0.8 * 0.5 + 0.2) * 100)
    ranks = {(r["模型"], r["期别"]): r["名次"] for r in E.ranked(total).collect()}
    assert (ranks["m1", "一期"], ranks["realphoto_a", "一期"]) == (1, 2)
    wide = {r["模型"]: r for r in E.score_pivot(total).collect()}
    assert wide["m1"]["一期"] == "100.00" and wide["m1"]["二期"] == "--" and wide["realphoto_a"]["类别"] == "实拍"
    assert E.select_models(predictions, skip_realphoto=True).filter("model = 'realphoto_a'").count() == 0


def pages(text, rows=3, cells=12, **more):
    return list(S.paginate(text, S.Grid(rows, cells, **more)))


@pytest.mark.parametrize(
    ("text", "raw"),
    [
        ("甲乙丙", ["甲乙丙\\h"]),
        ("甲乙丙丁戊己", ["甲乙丙\\h丁戊己$"]),
        ("【甲】", ["【甲】"]),
        ("【】乙", ["【】乙"]),
        ("【甲。】", ["【甲。】"]),
        ("【甲。。】", ["【甲。。】"]),
        ("乙】丙", ["乙丙"]),
        ("甲%  乙", ["甲%", "乙"]),
        ("甲$  乙", ["甲$乙"]),
        ("甲&  乙", ["甲&乙"]),
        ("甲●●乙", ["甲●●乙"]),
    ],
)
def test_page_text(text, raw):
    assert [p[1] for p in pages(text, zero_note="●◎。")] == raw


def test_notes_are_closed_on_every_page():
    found = pages("一二三四五六七八九十【" + "注" * 12 + "】末")
    assert len(found) == 2
    for _, raw, _ in found:
        assert raw.count("【") == raw.count("】")
    assert "".join(p[1] for p in found).count("注") == 12


def test_breaks_inside_notes_and_comments():
    # the breaks stand at both halves of a column's first note cell
    assert pages("一二三【甲乙】")[0][1] == "一二三\\h【甲\\h乙】"
    assert pages("一＜眉＞二")[0][1:] == ("一＜眉＞二", [(1, "眉")])


def plain_pages(tokens, cells):
    """Pages by arithmetic on one running count of cells: a character takes one, a note half of one for each of its own, rounded up."""
    out, comments, at = {}, {}, 0

    def put(page, text):
        out.setdefault(page, []).append(text)

    for kind, text in tokens:
        if kind == "main":
            for c in text:
                put(at // cells, c)
                at += 1
        elif kind == "comment":
            put(at // cells, f"＜{text}＞")
            comments.setdefault(at // cells, []).append((at % cells, text))
        else:
            page, room, k = at // cells, 2 * (cells - at % cells), 0
            while True:
                put(page, f"【{text[k : k + room]}】")
                k += room
                if k >= len(text):
                    break
                page, room = page + 1, 2 * cells
            at += -(-len(text) // 2)
    return [("".join(out.get(i, [])), comments.get(i, [])) for i in range(max(out, default=0) + 1)]


@pytest.mark.parametrize("rows", [1, 3, 5])
def test_pages_with_notes_and_comments_against_arithmetic(rows):
    r = random.Random(rows)
    word = lambda most: "".join(r.choice("甲乙丙丁戊") for _ in range(r.randrange(most)))
    for _ in range(300):
        tokens = [(r.choice(("main", "main", "note", "comment")), word(30)) for _ in range(r.randrange(8))]
        text = "".join({"main": t, "note": f"【{t}】", "comment": f"＜{t}＞"}[k] for k, t in tokens)
        got = [(raw.replace("\\h", "").replace("$", ""), comments) for _, raw, comments in pages(text, rows, 4 * rows)]
        assert got == plain_pages(tokens, 4 * rows), text


def test_missing_glyphs_take_no_cell():
    assert pages("一二三四", missing="二")[0][1] == "一三四\\h"


def test_plain_pages_equal_the_table_function(spark):
    r = random.Random(2)
    rows = [(i, "\n".join("".join(r.choice("abc ") for _ in range(r.randrange(25))) for _ in range(r.randrange(6)))) for i in range(40)] + [(90, None), (91, "")]
    books = spark.createDataFrame(rows, "book long, text string")
    plain = S.paginate_plain(books, 4, 6).orderBy("book", "page_idx").collect()
    udtf = S.paginate_books(books, 4, 6).select("book", "page_idx", "pagetxt").orderBy("book", "page_idx").collect()
    assert [tuple(x) for x in plain] == [tuple(x) for x in udtf]


def plain_placement(comments, rows, half, height, base):
    free, out = 0, []
    for cell, seq, text in sorted(comments):
        column, n = max(cell // rows * 2, free), len([c for c in text if c not in "●◎。"])
        for size in range(base, 14, -1):
            deep = max(1, int(height / (size * 1.3)))
            if -(-n // deep) <= half - column:
                free = column + -(-n // deep)
                out.append((seq, column, size, True))
                break
        else:
            out.append((seq, column, None, False))
    return out


@pytest.mark.parametrize("height", [150.0, -33.0])
def test_comment_placement(spark, height):
    r = random.Random(4)
    comments = [(r.randrange(40), i, "字" * r.randrange(1, 40)) for i in range(8)]
    rows = spark.createDataFrame([(1, 0, s, c, t) for c, s, t in comments], "book int, page_idx int, seq int, cell int, text string")
    got = [(x.seq, x.column, x["size"], x.kept) for x in S.place_comments(rows, 5, 16, height, 20).collect()]
    assert got == plain_placement(comments, 5, 16, height, 20)


def test_rejected_comments_go_from_all_pages(spark):
    content = spark.createDataFrame([(1, 0, "甲＜长＞乙＜短＞"), (2, 0, "＜长＞")], "book int, page_idx int, content string")
    placed = spark.createDataFrame([(1, "长", False), (1, "短", True)], "book int, text string, kept boolean")
    assert {r.book: r.content for r in S.remove_rejected(content, placed).collect()} == {1: "甲乙＜短＞", 2: "＜长＞"}


def test_column_boxes(spark):
    rows = [(0, "10,300,200", "5,6,7", 0), (1, "10,300,200", None, 0), (2, "300,290,10", "10,20,30", 4), (3, "", "", 0), (4, None, None, 0), (5, "5", "", 0)]
    got = {r.i: [tuple(b) for b in r.b] for r in spark.createDataFrame(rows, "i int, p string, w string, n int").select("i", L.column_boxes("p", "w", F.col("n")).alias("b")).collect()}
    assert got == {0: [(300, 6), (200, 7), (10, 5)], 1: [(300, 100), (200, 190), (10, 290)], 2: [(295, 15), (10, 30)], 3: [], 4: [], 5: [(5, 0)]}


def test_sections_and_grids(spark):
    row = spark.range(1).select(L.row_sections(F.lit("30,20"), F.lit(7), F.lit(0)).alias("a"), L.row_sections(F.lit("30"), F.lit(7), F.lit(4)).alias("b"), L.row_sections(F.lit(""), F.lit(7), F.lit(4)).alias("c")).first()
    assert (row.a.row_num, row.a.sections, row.a.row_ys, row.b.row_num, row.b.sections, row.c.row_num) == (3, 1, [20.0, 30.0], 8, 2, 7)
    boxes = F.expr("array(named_struct('x', 30D, 'w', 5D), named_struct('x', 10D, 'w', 6D))")
    cells = spark.range(1).select(L.sectioned_grid(boxes, F.array(F.lit(50.0)), F.lit(100.0), F.lit(10.0), F.lit(10.0), F.lit(2)).alias("g"), L.boxed_grid(boxes, F.array().cast("array<double>"), F.lit(100.0), F.lit(10.0), F.lit(10.0), F.lit(2)).alias("h")).first()
    assert [(c.cell, c.x, c.y) for c in cells.g] == [(1, 30, 70), (2, 30, 50), (3, 30, 30), (4, 30, 10), (5, 10, 70), (6, 10, 50), (7, 10, 30), (8, 10, 10)]
    assert [(c.cell, c.x, c.y) for c in cells.h] == [(1, 30, 50), (2, 30, 10), (3, 10, 50), (4, 10, 10)]


def test_rectangles_and_scales(spark):
    row = spark.range(1).select(L.normalized_rectangle(F.lit(9.0), F.lit(1.0), F.lit(2.0), F.lit(8.0)).alias("a"), L.normalized_rectangle(F.lit(9.0), F.lit(1.0), F.lit(5.0), F.lit(8.0)).alias("b"), L.fit_scale(F.lit(10.0), F.lit(5.0), F.lit(20.0), F.lit(5.0)).alias("c")).first()
    assert tuple(row.a) == (2, 1, 7, 7) and row.b is None and row.c == 0.5


def test_images_bind_by_number(spark):
    records = Q.page_records(spark.createDataFrame([("b", 0, "x"), ("b", 1, "y")], "book string, page_idx int, content string"))
    bound = Q.bind_images(records, spark.createDataFrame([("b", 1, "p.jpg")], "book string, page_idx int, path string")).orderBy("page_idx").collect()
    assert [r.images for r in bound] == [[], ["p.jpg"]]
    assert [m.role for m in bound[0].messages] == ["user", "assistant"]


def test_layout_tables(spark):
    layouts = spark.createDataFrame([("a", 1), ("b", 2)], "canvas_id string, v int")
    assert {r.canvas_id for r in Q.copy_layout(layouts, "a", "c").collect()} == {"a", "b", "c"}
    assert Q.copy_layout(layouts, "a", "b").count() == 2
    assert Q.delete_layout(layouts, "a").count() == 1
    assert {r.canvas_id: r.canvas for r in Q.with_canvas(layouts, layouts.filter("v = 1"), "d").collect()} == {"a": "a", "b": "d"}
    assert {r.canvas_id: r.ok for r in Q.status_of(layouts.filter("v = 1"), layouts, "canvas_id").collect()} == {"a": True, "b": False}


def test_sources(spark, tmp_path):
    (tmp_path / "gt.csv").write_text('index,answer,from\n1,"甲\n乙",x\n2,,y\n', encoding="utf-8")
    assert [(r["index"], r.answer) for r in files.read_truth(spark, str(tmp_path / "gt.csv")).orderBy("index").collect()] == [(1, "甲\n乙"), (2, None)]
    (tmp_path / "m1").mkdir()
    (tmp_path / "m1/一期.jsonl").write_text('{"image": "a", "ok": true}\n\n{"ocr": "x"}\n', encoding="utf-8")
    got = files.read_predictions(spark, [str(tmp_path / "m1/一期.jsonl")]).collect()
    assert sorted((r.model, r.image, r.ocr, r.finish_reason, r.ok) for r in got) == [("m1", "", "x", "", False), ("m1", "a", "", "", True)]
    (tmp_path / "layout.yaml").write_text("a: 1 # x\nb: '#ff0000'\nc: \"1,2\"\n# no\nd 3\n", encoding="utf-8")
    assert files.read_layouts(spark, str(tmp_path / "layout.yaml")).first().settings == {"a": "1", "b": "#ff0000", "c": "1,2"}
    (tmp_path / "n.txt").write_text("1|一\nx\n2|二|三\n", encoding="utf-8")
    assert sorted(tuple(r) for r in files.read_lookup(spark, str(tmp_path / "n.txt")).collect()) == [("1", "一"), ("2", "二|三")]
    (tmp_path / "data.js").write_text('window.X = {"pages": [{"fileName": "f", "classifiedLines": [{"text": "甲乙", "words": [{"text": "甲", "l1_alert": true}, {"text": "乙", "suggest": "已", "l2_alert": true}]}]}]};\n', encoding="utf-8")
    words = Q.flatten_words(files.read_annotation(spark, str(tmp_path / "data.js")))
    assert tuple(Q.alert_counts(words).first()) == ("f", 2, 1, 1, 1)
    comments = spark.createDataFrame([(0, 3, "a|b")], "page_idx int, cell int, text string")
    files.write_comments(comments, str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_comments(spark, str(tmp_path / "c")).collect()] == [(0, 3, "a|b")]
    records = Q.page_records(spark.createDataFrame([("b", 0, "x")], "book string, page_idx int, content string"))
    files.write_chat(records, str(tmp_path / "chat"))
    assert files.read_chat(spark, str(tmp_path / "chat")).first().messages[1].content == "x"
    assert [r.path.endswith("n.txt") for r in files.list_files(spark, str(tmp_path), "n*").collect()] == [True]
    typed = spark.createDataFrame([("12",), ("1.5",), ("x",)], "v string").select(files.typed(F.col("v")).alias("t")).collect()
    assert [(r.t.i, r.t.d, r.t.s) for r in typed] == [(12, None, None), (None, 1.5, None), (None, None, "x")]


@pytest.mark.parametrize("parts", [1, 5])
def test_means_are_exact(spark, parts):
    r = random.Random(4)
    values = [r.choice([r.randrange(1, 900) / r.randrange(1, 900), 1 - r.randrange(300) / 300, r.uniform(-1, 1), 1 / 3, 0.1, 2.0**-40, -1e5]) for _ in range(4000)]
    got = spark.createDataFrame([(x,) for x in [*values, None]], "x double").repartition(parts).agg(E.exact_sum("x").alias("s"), E.mean("x").alias("m")).first()
    assert (got.s, got.m) == (math.fsum(values), math.fsum(values) / len(values))


def test_means_of_nothing_are_null(spark):
    assert spark.createDataFrame([(None,)], "x double").agg(E.mean("x").alias("m")).first().m is None


def test_only_marks_and_the_han_before_them_go_through_windows(spark):
    texts = ["。甲。乙x丙 、。丙○", "天天天", "", None, "甲y。甲◎甲、甲。", "。。", "abc"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    rows = W.circle_pair_rows(df, ["k"])
    got = {}
    for r in sorted(rows.collect()):
        got.setdefault(r.k, []).append((r.pos, r.ch, r.mark))
    assert got == {0: [(2, "甲", "。"), (7, "丙", "、"), (8, "丙", "。")], 4: [(2, "甲", "。"), (4, "甲", "◎")]}
    long = spark.createDataFrame([(1, "天" * 5000 + "。")], "k int, text string")
    counted = W.circle_pair_rows(long, ["k"])
    assert [(r.pos, r.ch) for r in counted.collect()] == [(5000, "天")]
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan


def test_books_and_predictions_are_dealt_over_tasks(spark):
    books = spark.createDataFrame([(k, f"text {k}") for k in range(100)], "book long, text string").coalesce(1)
    for pages in (S.paginate_plain(books, 5, 6), S.paginate_books(books, 5, 6)):
        plan = pages._jdf.queryExecution().executedPlan().toString()
        assert "RoundRobinPartitioning(4)" in plan and pages.count() == 100
    said = spark.createDataFrame([("m", "/【一期】/1.png", "x", "stop", True)], "model string, image string, ocr string, finish_reason string, ok boolean").coalesce(1)
    both = E.joined(said, spark.createDataFrame([(1, "x", "")], "index long, answer string, `from` string"))
    assert "RoundRobinPartitioning(4)" in both._jdf.queryExecution().executedPlan().toString() and both.count() == 1
