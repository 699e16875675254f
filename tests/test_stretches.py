"""Pagination in stretches against whole books, and trial runs that stop."""

import random

from pyspark.sql import functions as F

from quire.operators import typeset as S

PARTS = ["乙丙丁●", "【】", "%    ", "$    ", "&    ", "】", "-", "●", "◎◎", "戊-", "己●●●", "＜未", "辛缺", "《書》", " " * 7]


def book(rng):
    noted = lambda: "【" + "注" * rng.randrange(40) + rng.choice(["", "-", "●", "◎●", "缺"]) + "】"
    made = [rng.choice([*PARTS, "甲" * rng.randrange(1, 30), noted(), "＜評" + "論" * rng.randrange(5) + "＞", "壬" * 1300]) for _ in range(rng.randrange(120))]
    return "".join(made) + rng.choice(["", "【末", "＜末", "庚"])


def test_stretches_give_the_pages_of_whole_books(spark):
    rng = random.Random(11)
    texts = ["", *(book(rng) for _ in range(40))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for grid in (S.Grid(5, 30), S.Grid(4, 8, rotated="丁"), S.Grid(6, 6, vertical_lines=True), S.Grid(3, 15, missing="缺")):
        for size, stop in ((1, None), (3, 2), (8, None)):
            parts = rows.select("i", F.explode(S.stretches(F.col("t"), grid, size, 0, stop)).alias("p")).select("i", "p.*").collect()
            got = {i: [] for i in range(len(texts))}
            for p in parts:
                got[p.i] += [page for page in S.paginate(p.text, grid, p.start, p.stop) if page[0] >= p.first]
            for i, text in enumerate(texts):
                assert sorted(got[i], key=lambda page: page[0]) == list(S.paginate(text, grid))[:stop], (grid, size, stop, text)


def test_one_noted_book_takes_several_tasks(spark):
    rng = random.Random(12)
    text = "\n".join(rng.choice(["甲" * rng.randrange(200), "【注注注】乙丙" * 9, "$", "%", "&", "＜評＞丁", "戊●己-庚"]) for _ in range(3000))
    books = spark.createDataFrame([(1, text), (2, "甲"), (3, None)], "book int, text string")
    padded = books.select(S.load_text("text", F.lit(5))).first()[0]
    parts = books.select("book", F.explode(S.stretches(S.load_text("text", F.lit(5)), S.Grid(5, 30), 64, 1000)).alias("p"))
    assert parts.filter("book = 1").count() > 20
    pages = S.paginate_books(books, 5, 6, long=1000)
    assert pages.filter("book = 1").select(F.spark_partition_id()).distinct().count() > 1
    got = sorted((r.page_idx, r.pagetxt, [tuple(c) for c in r.comments]) for r in pages.filter("book = 1").collect())
    assert got == list(S.paginate(padded, S.Grid(5, 30)))
    assert sorted((r.book, r.page_idx, r.pagetxt) for r in pages.filter("book > 1").collect()) == [(2, 0, "甲    \\h"), (3, 0, "")]
    first = S.first_pages(books, 3, 5, 6, long=1000).filter("book = 1").collect()
    assert sorted((r.page_idx, r.pagetxt) for r in first) == [(i, x) for i, x, _ in got[:3]]


def test_no_page_beyond_the_last_one_asked_for_is_made(monkeypatch):
    made = []
    real = S._Page

    def page(index, *more, **named):
        made.append(index)
        return real(index, *more, **named)

    monkeypatch.setattr(S, "_Page", page)
    for text in ("甲" * 1000, "【" + "注" * 1000 + "】", "%    " * 50, "＜評＞甲" * 400):
        made.clear()
        assert [p[0] for p in S.paginate(text, S.Grid(5, 30), stop=2)] == [0, 1]
        assert max(made) <= 2
    assert list(S.paginate("甲", S.Grid(5, 30), 60, 2)) == []


def test_plain_characters_are_laid_out_by_columns(monkeypatch):
    fed = []
    real = S._Page.feed
    monkeypatch.setattr(S._Page, "feed", lambda self, grid: (fed.append(1), real(self, grid))[1])
    pages = [p[1] for p in S.paginate("甲" * 95 + "乙●丙【注】" + "丁" * 61, S.Grid(5, 30))]
    column = lambda c, n=1: (c * 5 + "\\h") * n
    first = column("甲", 2) + "甲" * 5 + "$" + column("甲", 3)
    assert pages[:3] == [first] * 3
    # 5 + 1 + 1 + 0.5, rounded up, then a run over two pages
    fourth = column("甲") + "乙●丙【注】丁丁\\h" + "丁" * 5 + "$" + column("丁", 3)
    assert pages[3:5] == [fourth, column("丁", 2) + "丁" * 5 + "$" + column("丁", 3)] and pages[5] == column("丁", 1) + "丁" * 4
    assert len(fed) < 10


def test_no_negated_class_runs_over_a_book(spark):
    from quire.functions import text as T
    from quire.plans.typesetting import PLAIN_SPARK

    rows = spark.createDataFrame([(1, "x")], "book int, text string")
    plan = S.paginate_books(rows, 5, 6, source=PLAIN_SPARK).select("book", "pagetxt")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" in plan and "[^" not in plan
    # outside gives what a negated class does, at both ends of the ranges too
    for dropped in ("【】＜＞", "b", "\x00\U0010ffff", "^]-\\"):
        kept = "".join(c for c in "\x00\x01abc\n ^]-\\【】＜＞甲\U0001f600\U0010ffff" if c not in dropped)
        text = F.lit("\x00\x01abc\n ^]-\\【】＜＞甲\U0001f600\U0010ffff")
        assert spark.range(1).select(F.array_join(F.regexp_extract_all(text, F.lit(T.outside(dropped) + "+"), F.lit(0)), "")).first()[0] == kept
