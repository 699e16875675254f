"""Books to pages: padded text, pagination into a grid of columns and rows, page content, and
placement of top-margin comments.

Where a page ends depends on all before it, but only by a position: characters and notes add to it,
and controls move it within its page. So a long book is cut into stretches of pieces (runs of plain
text, notes, comments, controls) whose first positions come from a fold of widths in the JVM, and a
Python table function lays out the stretches apart from each other: each makes the pages that it
opens, and reads on to the end of the last. Books without notes, comments, controls and zero-width marks can go through
``paginate_plain``, which is arithmetic on positions and stays in the JVM.

Where a note ends with a mark, is empty, or crosses a page, it is closed, and opened again on the
next page, so that every page's brackets are balanced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quire.functions import layout as L
from quire.functions import text as T
from quire.session import spread

#: Characters of a book that is laid out in one go; pieces of a stretch; characters of a plain piece.
LONG, STRETCH, PLAIN = 32768, 64, 512
PAGE = StructType(
    [
        StructField("page_idx", IntegerType()),
        StructField("pagetxt", StringType()),
        StructField("comments", ArrayType(StructType([StructField("cell", IntegerType()), StructField("text", StringType())]))),
    ]
)


def load_text(c: Column | str, rows: Column, zero_width: str = "●◎", vertical_lines: bool = False, **normalize: str) -> Column:
    """A book as one line: brackets flattened, white space removed, lines normalized and filled
    with spaces to whole columns of so many rows; blank lines go."""
    # spaces, of which there are many, need no regular expression
    lines = F.transform(F.split(T.flatten_brackets(c), "\n"), lambda x: F.regexp_replace(T.without(x, " "), r"(?U)\s", ""))
    kept = F.transform(F.filter(lines, lambda x: x != ""), lambda x: T.normalize_book_line(x, **normalize))
    fill = lambda x: F.pmod(rows - F.pmod(T.measure_line(x, zero_width, vertical_lines), rows), rows)
    return F.array_join(F.transform(kept, lambda x: F.concat(x, F.repeat(F.lit(" "), fill(x)))), "")


@dataclass
class Grid:
    """Rows of a column and cells of a page; marks that take no cell; characters without a glyph."""

    rows: int
    cells: int
    zero_text: str = "●◎"
    zero_note: str = "●◎"
    rotated: str = ""
    vertical_lines: bool = False
    missing: str = ""

    @classmethod
    def of_settings(cls, settings: dict[str, str], cells_key: str = "col_num") -> Grid:
        """From a layout's settings, whose sets of marks are |-joined; ● and ◎ never take a cell."""
        marks = lambda key: "".join(dict.fromkeys(settings.get(key, "").replace("|", "")))
        zero = lambda key: marks(key) + "".join(c for c in "●◎" if c not in marks(key))
        rows = int(settings["row_num"])
        return cls(rows, rows * int(settings[cells_key]), zero("text_comma_nop"), zero("comment_comma_nop"), marks("text_comma_90"), settings.get("if_book_vline", "0") not in ("", "0"))


@dataclass
class _Page:
    index: int
    out: list[str] = field(default_factory=list)
    comments: list[tuple[int, str]] = field(default_factory=list)
    at: float = 0

    def feed(self, grid: Grid) -> None:
        """Column or half-page break after a cell."""
        cell = int(self.at)
        if cell == grid.cells // 2:
            self.out.append("$")
        elif cell > 0 and cell % grid.rows == 0:
            self.out.append("\\h")

    def fill(self, breaks: list[tuple[int, str]], text: str) -> None:
        """Characters that take a cell each, not beyond the page's end, with the breaks after them."""
        start = done = self.at
        for cell, mark in breaks:
            if start < cell <= start + len(text):
                self.out += (text[done - start : cell - start], mark)
                done = cell
        self.out.append(text[done - start :])
        self.at = start + len(text)

    def row(self) -> tuple[int, str, list[tuple[int, str]]]:
        return self.index, "".join(self.out), self.comments


def _delimited(text: str, at: int, closer: str) -> tuple[str, int]:
    end = text.find(closer, at)
    return (text[at:], len(text)) if end < 0 else (text[at:end], end + 1)


def paginate(text: str, grid: Grid, start: int = 0, stop: int | None = None) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
    """Pages (index, raw text, comments) of a flattened, padded book, or of what stands in it from cell ``start`` on.

    No page from number ``stop`` on is made.

    Raw text keeps control marks: a literal \\h ends a column, $ a half page. A character takes a
    cell and a note's character half a cell, first all of a column's right halves, then the left.
    Zero-width marks, dashes and, with vertical lines, 《》 take none; characters without a glyph go.
    """
    page, i, n = _Page(start // grid.cells, at=start % grid.cells), 0, len(text)
    if stop is not None and page.index >= stop:
        return
    skip = set(grid.missing)
    plain = re.compile(f"[^{re.escape('＜【】%$&-' + grid.missing + grid.zero_text + ('《》' if grid.vertical_lines else ''))}]+")
    breaks = [(cell, "$" if cell == grid.cells // 2 else "\\h") for cell in range(grid.cells + 1) if cell == grid.cells // 2 or cell > 0 and cell % grid.rows == 0]

    def note(content: str) -> Iterator[tuple[int, str, list[tuple[int, str]]]]:
        nonlocal page
        page.out.append("【")
        chars = [c for c in content if c not in skip]
        width = sum(c not in grid.zero_note and not (grid.vertical_lines and c in "《》") for c in chars)
        room, k, drawn = 0, 0, False
        left = width
        started = False
        while k < len(chars):
            c = chars[k]
            free = c in grid.zero_note or c == "-" or (grid.vertical_lines and c in "《》")
            if not free:
                if room == 0:
                    if started and page.at >= grid.cells:
                        page.out.append("】")
                        yield page.row()
                        page = _Page(page.index + 1, ["【"])
                        if page.index == stop:
                            return
                    first = int(page.at)
                    room = 2 * (min(first + -(-left // 2), (first // grid.rows + 1) * grid.rows) - first)
                    drawn = False
                started = True
            page.out.append(c)
            k += 1
            if free:
                continue
            room, left, drawn = room - 1, left - 1, True
            page.at += 0.5
            if k < len(chars) and chars[k] in grid.zero_note and c not in grid.rotated:
                page.out.append(chars[k])
                k += 1
            if k == len(chars):
                page.out.append("】")
            page.feed(grid)
        if not chars or page.out[-1] != "】" and not (drawn and page.out[-1] in ("$", "\\h") and page.out[-2:-1] == ["】"]):
            page.out.append("】")
        page.at = int(page.at + 0.5)

    end = 0  # of the plain characters that stand at i
    while i < n:
        if page.at == grid.cells:
            yield page.row()
            page = _Page(page.index + 1)
            if page.index == stop:
                return
        if i >= end:
            end = found.end() if (found := plain.match(text, i)) else i
        # the last of them may have marks after it
        taken = min((end if end == n else end - 1) - i, grid.cells - page.at)
        if taken > 0:
            page.fill(breaks, text[i : i + taken])
            i += taken
            continue
        c = text[i]
        i += 1
        if c == "＜":
            said, i = _delimited(text, i, "＞")
            page.comments.append((int(page.at), said))
            page.out.append(f"＜{said}＞")
        elif c == "【":
            said, i = _delimited(text, i, "】")
            yield from note(said)
            if page.index == stop:
                return
        elif c == "】":
            continue
        elif c in "%$&":
            page.out.append(c)
            i = min(n, i + grid.rows - 1)  # what fills the control's own column
            if c == "%":
                page.at = grid.cells
            elif c == "&":
                if page.at <= grid.cells - grid.rows + 1:
                    page.at = grid.cells - grid.rows
            elif page.at not in (0, grid.cells // 2):
                page.at = grid.cells // 2 if page.at < grid.cells // 2 else grid.cells
        elif grid.vertical_lines and c in "《》":
            page.out.append(c)
        elif c not in skip:
            page.out.append(c)
            if c in grid.zero_text:
                continue
            if c != "-":
                page.at = min(page.at + 1, grid.cells)
                if i < n and text[i] in grid.zero_text and c not in grid.rotated:
                    if text[i] not in skip:
                        page.out.append(text[i])
                    i += 1
            page.feed(grid)
            if c != "-" and page.at == grid.cells and i < n and text[i] in grid.zero_text:
                i += 1  # a second mark at the end of a page has no place in its text
    yield page.row()


@udtf(returnType=PAGE)
class Paginate:
    """paginate(text, rows, cells[, zero_width[, missing[, start[, first[, stop]]]]]): the pages of one book.

    Of a stretch that begins at cell start, the pages from number first to before stop.
    """

    def eval(self, text: str, rows: int, cells: int, zero_width: str = "●◎", missing: str = "", start: int = 0, first: int = 0, stop: int = None):
        if text is not None and rows and cells:
            pages = paginate(text, Grid(rows, cells, zero_width, zero_width, missing=missing or ""), start or 0, stop)
            yield from (p for p in pages if p[0] >= (first or 0))


def register(spark: SparkSession) -> None:
    """Make the table function known to SQL as paginate."""
    spark.udtf.register("paginate", Paginate)


def _moved(grid: Grid, acc: Column, piece: Column) -> Column:
    """(cell, opened) after a piece (control, width): the cell counts from the book's first, and opened tells that its page, which it is the first of, has something on it."""
    at, cell = F.pmod(acc["cell"], F.lit(grid.cells)), acc["cell"]
    half = grid.cells // 2
    moved = (
        F.when(piece["control"] == "%", cell - at + grid.cells)
        .when(piece["control"] == "$", F.when(at.isin(0, half), cell).when(at < half, cell - at + half).otherwise(cell - at + grid.cells))
        .when(piece["control"] == "&", F.when(at <= grid.cells - grid.rows + 1, cell - at + grid.cells - grid.rows).otherwise(cell))
        .otherwise(cell + piece["width"])
    )
    return F.struct(moved.alias("cell"), ((F.pmod(moved, F.lit(grid.cells)) == 0) & (moved <= cell)).alias("opened"))


def stretches(text: Column, grid: Grid, size: int = STRETCH, long: int = LONG, stop: int | None = None) -> Column:
    """array of (text, start, first, stop): parts of a padded book for ``paginate``, each with the pages that it makes.

    Texts of up to ``long`` characters stay whole. A part has ``size`` pieces, and goes on until its last
    page is full. Pages from number ``stop`` on are left out.
    """
    lines = "《》" if grid.vertical_lines else ""
    # characters that take no cell, and open a page that stands full before them, but for two marks after one that does
    zero = f"-{grid.missing}{lines}{grid.zero_text}"
    free, turned = re.escape(zero), re.escape(grid.rotated)
    marks = f"[{re.escape(grid.zero_text)}]" if grid.zero_text else "(?!)."
    plain = f"{T.outside('＜【】%$&' + zero + grid.rotated)}{{1,{PLAIN}}}(?:{marks}){{0,2}}" + (f"|[{turned}](?:{marks})?" if turned else "")
    pattern = f"(?s)＜{T.outside('＞')}*＞?|【{T.outside('】')}*】?|[%$&].{{0,{grid.rows - 1}}}|】|{plain}|[{free}]+"

    def piece(x: Column) -> Column:
        first = F.substring(x, 1, 1)
        noted = F.length(F.translate(F.regexp_replace(x, r"^【|】\z", ""), f"-{grid.zero_note}{grid.missing}{lines}", ""))
        plain = F.length(F.translate(x, f"-{grid.zero_text}{grid.missing}{lines}", ""))
        width = F.when(first.isin("＜", "】"), 0).when(first == "【", F.ceil(noted / 2)).otherwise(plain)
        return F.struct(F.when(first.isin("%", "$", "&"), first).alias("control"), width.cast("long").alias("width"))

    found = F.regexp_extract_all(text, F.lit(pattern), 0)
    begin = F.struct(F.lit(0).cast("long").alias("cell"), F.lit(False).alias("opened"))

    def parts(pieces: Column) -> Column:
        count = F.ceil(F.size(pieces) / size).cast("int")
        groups = F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.transform(F.slice(pieces, k * size + 1, F.lit(size)), piece))
        step = lambda acc, g: F.struct(F.aggregate(g, acc["now"], lambda a, x: _moved(grid, a, x)).alias("now"), F.concat(acc["all"], F.array(acc["now"])).alias("all"))
        entries = F.aggregate(groups, F.struct(begin.alias("now"), F.array_repeat(begin, 0).alias("all")), step, lambda acc: F.concat(acc["all"], F.array(acc["now"])))
        return F.transform(F.array(entries), lambda e: F.transform(F.sequence(F.lit(0), count - 1), lambda k: part(pieces, count, e, k)))[0]

    def page(entry: Column) -> Column:
        return F.when(entry["opened"], F.floor(entry["cell"] / grid.cells) + 1).otherwise(F.ceil(entry["cell"] / grid.cells)).cast("int")

    def part(pieces: Column, count: Column, entries: Column, k: Column) -> Column:
        ends = page(entries[k + 1])
        # the first group that begins where the part's last page is full
        beyond = F.array_position(F.transform(F.slice(entries, k + 2, count), lambda e: e["cell"] >= ends.cast("long") * grid.cells), True)
        groups = F.when((beyond > 0) & (k + 1 < count), beyond).otherwise(count - k)
        own = F.array_join(F.slice(pieces, k * size + 1, (groups * size).cast("int")), "")
        return F.struct(own.alias("text"), entries[k]["cell"].alias("start"), page(entries[k]).alias("first"), F.when(k + 1 < count, ends).alias("stop"))

    none = F.lit(None).cast("int")
    whole = F.array(F.struct(text.alias("text"), F.lit(0).cast("long").alias("start"), F.lit(0).alias("first"), none.alias("stop")))
    cut = F.when(F.length(text) <= long, whole).otherwise(F.transform(F.array(found), parts)[0])
    kept = F.filter(cut, lambda x: (x["stop"].isNull() | (x["first"] < x["stop"])) & (F.lit(True) if stop is None else x["first"] < stop))
    return kept if stop is None else F.transform(kept, lambda x: F.struct(x["text"], x["start"], x["first"], F.least(x["stop"], F.lit(stop)).alias("stop")))


def paginate_books(books: DataFrame, rows: int, columns: int, zero_width: str = "●◎", stop: int | None = None, size: int = STRETCH, long: int = LONG, source: str = "text", **normalize: str) -> DataFrame:
    """(book, page_idx, pagetxt, comments, content) of books(book, text), the pages before number ``stop``.

    ``source`` is the SQL of a book's text where it is made from its column, a step that is done after books are dealt over tasks. A null text has one empty page. Books of more than ``long`` characters are laid out in stretches, by several tasks.
    """
    grid = Grid(rows, rows * columns, zero_width, zero_width)
    ready = spread(books.select("book", "text")).select("book", load_text(F.expr(source), F.lit(rows), zero_width, **normalize).alias("_text"))
    # so many partitions that few bytes, which take long to lay out, don't end up in one
    tasks = int(books.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = ready.select("book", F.explode(stretches(F.col("_text"), grid, size, long, stop)).alias("_part")).select("book", "_part.*").repartition(tasks, "book", "first")
    function = Paginate(F.col("text").outer(), F.lit(rows), F.lit(grid.cells), F.lit(zero_width), F.lit(""), F.col("start").outer(), F.col("first").outer(), F.col("stop").outer())
    pages = parts.select("book", *(F.col(c).alias(c) for c in ("text", "start", "first", "stop"))).lateralJoin(function)
    return pages.select("book", "page_idx", "pagetxt", "comments", T.page_content("pagetxt").alias("content"))


def first_pages(books: DataFrame, n: int, rows: int, columns: int, **more) -> DataFrame:
    """Of each book, the pages before number n: a trial run or a preview, for which no other page is made."""
    return paginate_books(books, rows, columns, stop=n, **more)


def paginate_plain(books: DataFrame, rows: int, columns: int, source: str = "text") -> DataFrame:
    """(book, page_idx, pagetxt) of books whose text, or what the SQL ``source`` makes of it, has no brackets, controls, dashes and marks."""
    cells = rows * columns
    pieces = lambda c, n: F.regexp_extract_all(c, F.lit(f"(?s).{{1,{n}}}"), 0)
    ready = spread(books.select("book", "text")).select("book", load_text(F.expr(source), F.lit(rows)).alias("_text"))
    # a text is cut once, so each page carries its own cells alone
    pages = ready.select("book", F.posexplode(F.when(F.length("_text") > 0, pieces(F.col("_text"), cells)).otherwise(F.array(F.lit("")))).alias("page_idx", "_own"))
    # a break stands after each full column; half a page's is another one
    ended = lambda c, k: F.when(F.length(c) < rows, "").when((k + 1) * rows == cells // 2, "$").otherwise("\\h")
    return pages.select("book", "page_idx", F.array_join(F.transform(pieces(F.col("_own"), rows), lambda c, k: F.concat(c, ended(c, k))), "").alias("pagetxt"))


def place_comments(comments: DataFrame, rows: int, half_columns: int, height: float, base: int, zero_width: str = "●◎。") -> DataFrame:
    """(book, page_idx, seq, cell, text, column, size, kept) of comments(book, page_idx, seq, cell, text).

    On each page, in cell order, a comment starts at its own column or the next free one, in the
    largest size that fits to the page's end; one that fits in none is rejected and takes no
    column. The fold runs over a page's few comments inside the JVM.
    """
    ordered = comments.groupBy("book", "page_idx").agg(F.array_sort(F.collect_list(F.struct("cell", "seq", "text"))).alias("_all"))
    start = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<seq:int,cell:int,text:string,column:int,size:int,kept:boolean>>").alias("rows"))

    def step(acc: Column, c: Column) -> Column:
        column = F.greatest((F.floor(c["cell"] / rows) * 2).cast("int"), acc["free"])
        length = F.length(F.translate(c["text"], zero_width, ""))
        size = L.comment_fit(length, F.lit(base), F.lit(half_columns) - column, F.lit(float(height)))
        depth = F.greatest(F.lit(1), (F.lit(float(height)) / (size * 1.3)).cast("int"))
        free = F.when(size.isNull(), acc["free"]).otherwise((column + F.ceil(length / depth)).cast("int"))
        row = F.struct(c["seq"].cast("int").alias("seq"), c["cell"].cast("int").alias("cell"), c["text"].alias("text"), column.alias("column"), size.cast("int").alias("size"), size.isNotNull().alias("kept"))
        return F.struct(free.alias("free"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    placed = ordered.select("book", "page_idx", F.explode(F.aggregate("_all", start, step, lambda acc: acc["rows"])).alias("_row"))
    return placed.select("book", "page_idx", "_row.*")


def remove_rejected(pages: DataFrame, placed: DataFrame) -> DataFrame:
    """Pages (book, page_idx, .., content) without the comments of their book that were rejected on any page.

    Each page's own comments are looked up among its book's, so work grows with the comments and no
    book's are gathered.
    """
    own = pages.select("book", "page_idx", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("＜([^＞]*)＞"), 1))).alias("text"))
    gone = own.join(placed.filter("not kept").select("book", "text").distinct(), ["book", "text"], "left_semi")
    each = gone.groupBy("book", "page_idx").agg(F.collect_set(F.concat(F.lit("＜"), "text", F.lit("＞"))).alias("_gone"))
    content = F.aggregate(F.coalesce("_gone", F.array().cast("array<string>")), F.col("content"), lambda a, g: F.replace(a, g))
    return pages.join(each, ["book", "page_idx"], "left").withColumn("content", content).select(pages.columns)
