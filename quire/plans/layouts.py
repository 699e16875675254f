"""Queries of layouts: merged columns, sections, grids, crops, copies; and of page records and comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as T
from quire.operators import records as Q
from quire.operators import typeset as S
from quire.plans import derived as D
from quire.plans.registry import query, table
from quire.plans.typesetting import BOOK, CELLS, COLUMNS, FLATTEN, PAGES, PLAIN_SPARK, RAW_PAGES, ROWS, raw_books

CLOSE = "concat(p_size * 13 % 60 + 100, ',', p_size * 7 % 60 + 100, ',', p_size * 11 % 60 + 110, ',400')"


@query(
    "merged_columns",
    """with c as (select p_partkey, list_reverse_sort([p_size * 13 % 60 + 100, p_size * 7 % 60 + 100, p_size * 11 % 60 + 110, 400]::double[]) as xs from part),
    b as (select p_partkey, list_transform(range(1, 5), lambda i: {'x': xs[i], 'w': case when i < 4 then xs[i] - xs[i + 1] else xs[1] - xs[4] end, 'n': []::struct(x double, w double)[]}) as bs from c),
    m as (select p_partkey, list_reduce(bs, lambda a, z: case when abs(a.x - z.x) < 20 then {'x': (a.x + z.x) / 2, 'w': (a.w + z.w) / 2, 'n': a.n} else {'x': z.x, 'w': z.w, 'n': list_append(a.n, {'x': a.x, 'w': a.w})} end) as f from b),
    r as (select p_partkey, list_append(f.n, {'x': f.x, 'w': f.w}) as rs from m)
    select p_partkey, generate_subscripts(rs, 1)::int as col, unnest(rs).x as x, unnest(rs).w as w from r""",
)
def merged_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns less than 20 pixels apart are one, in layouts of several sections."""
    boxes = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(L.column_boxes(F.expr(CLOSE), F.lit(""), F.lit(4))).alias("at", "b"))
    return boxes.select("p_partkey", (F.col("at") + 1).alias("col"), "b.x", "b.w")


@query(
    "row_sections",
    """select s_suppkey, case s_suppkey % 3 when 0 then 7 when 1 then case when s_suppkey % 2 = 0 then 3 * 5 else 3 end else 2 end::int as row_num,
    case when s_suppkey % 3 = 1 and s_suppkey % 2 = 0 then 3 else 1 end::int as sections, case s_suppkey % 3 when 0 then 0 when 1 then s_suppkey + 20 else 30 end::double as highest
    from (select s_suppkey from supplier) where s_suppkey % 3 < 2 or s_suppkey % 2 = 1""",
)
def row_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.expr("case s_suppkey % 3 when 0 then '' when 1 then concat(s_suppkey + 20, ', ', s_suppkey) else '30,' end")
    rows = table(spark, sf_dir, "supplier").filter("s_suppkey % 3 < 2 or s_suppkey % 2 = 1")
    made = rows.select("s_suppkey", L.row_sections(lines, F.lit(7), F.when(F.col("s_suppkey") % 2 == 0, 5).otherwise(0)).alias("r"))
    return made.select("s_suppkey", "r.row_num", "r.sections", F.coalesce(F.array_max("r.row_ys"), F.lit(0.0)).alias("highest"))


BOXES = "array(named_struct('x', 300D + n_nationkey, 'w', 50D), named_struct('x', 200D, 'w', 40D), named_struct('x', 90D, 'w', 30D))"


@query(
    "boxed_cells",
    """with n as (select n_nationkey, case when n_nationkey % 2 = 0 then [100.0, 300.0, 500.0]::double[] else [] end as ys from nation),
    c as (select n_nationkey, ys, unnest([{'i': 0, 'x': 300.0::double + n_nationkey, 'w': 50.0::double}, {'i': 1, 'x': 200.0, 'w': 40.0}, {'i': 2, 'x': 90.0, 'w': 30.0}]) as b from n),
    j as (select *, unnest(range(1, 5)) as j from c)
    select n_nationkey, (b.i * 4 + j)::int as cell, b.x as x, case when len(ys) > 0 and j <= 3 then 1000 - ys[j] - 200.0::double when len(ys) > 0 then 1000 - 60 - 200.0::double * j else 1000 - 60 - (1000 - 60 - 40) / 4.0::double * j end as y, b.w as w from j""",
)
def boxed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    ys = F.expr("case when n_nationkey % 2 = 0 then array(500D, 300D, 100D) else cast(array() as array<double>) end")
    grid = L.boxed_grid(F.expr(BOXES), F.sort_array(ys), F.lit(1000.0), F.lit(60.0), F.lit(40.0), F.lit(4))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(grid).alias("g")).select("n_nationkey", F.col("g.cell").cast("int").alias("cell"), "g.x", "g.y", "g.w")


@query(
    "sectioned_cells",
    """with b as (select n_nationkey, 400.0::double + n_nationkey as cut, unnest([{'side': 0, 'i': 0, 'x': 300.0::double + n_nationkey, 'w': 50.0::double}, {'side': 1, 'i': 1, 'x': 200.0, 'w': 40.0}, {'side': 1, 'i': 2, 'x': 90.0, 'w': 30.0}]) as b from nation),
    s as (select *, unnest(range(1, 3)) as s from b), j as (select *, unnest(range(1, 6)) as j, case s when 1 then 60.0::double else cut end as a, case s when 1 then cut else 960.0::double end as z from s)
    select n_nationkey, row_number() over (partition by n_nationkey order by b.side, s, b.i, j)::int as cell, b.x as x, 1000 - a - (z - a) / 5 * j as y, b.w as w from j""",
)
def sectioned_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = L.sectioned_grid(F.expr(BOXES), F.array(F.col("n_nationkey") + 400.0), F.lit(1000.0), F.lit(60.0), F.lit(40.0), F.lit(5))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(grid).alias("g")).select("n_nationkey", F.col("g.cell").cast("int").alias("cell"), "g.x", "g.y", "g.w")


HASH = "(('0x' || substr(md5('42:{0}:' || p_partkey), 1, 13))::bigint)"


@query(
    "crop_boxes",
    f"""with s as (select p_partkey, p_size::double as zw, 40.0::double as zh, 25::double as iw, (p_size % 30 + 20)::double as ih from part),
    g as (select *, greatest(zw / iw, zh / ih, 1.0::double) as scale from s),
    w as (select *, case when scale > 1 then greatest((iw * scale + 0.5)::double, zw) else iw end as nw, case when scale > 1 then greatest((ih * scale + 0.5)::double, zh) else ih end as nh from g),
    t as (select p_partkey, zw, zh, scale, trunc(nw)::int as width, trunc(nh)::int as height from w)
    select p_partkey, round(scale, 9) as scale, width, height, ({HASH.format('x')} % (width - zw::int + 1))::int as "left", ({HASH.format('y')} % (height - zh::int + 1))::int as top from t""",
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    box = L.crop_box(size.cast("double"), F.lit(40.0), F.lit(25.0), (size % 30 + 20).cast("double"), F.col("p_partkey"))
    return table(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", F.round("b.scale", 9).alias("scale"), "b.width", "b.height", "b.left", "b.top")


@query("fit_scales", "select p_partkey, round(least(300.0::double / (p_size * 10), 200.0::double / (p_size + 100), 1.0::double), 9) as scale from part")
def fit_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.round(L.fit_scale(F.lit(300.0), F.lit(200.0), F.col("p_size") * 10.0, F.col("p_size") + 100.0), 9).alias("scale"))


@query("layout_copies", "select 'n' || n_nationkey as canvas_id, n_name as name from nation where n_nationkey <> 3 union all select 'new', n_name from nation where n_nationkey = 7")
def layout_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout is copied under a new id, another copy is refused as its id is taken, and a third layout is deleted."""
    layouts = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("canvas_id"), F.col("n_name").alias("name"))
    return Q.delete_layout(Q.copy_layout(Q.copy_layout(layouts, "n7", "new"), "n8", "n9"), "n3")


@query("batch_status", "select n_nationkey, exists (select 1 from supplier where s_nationkey = n_nationkey and s_suppkey % 7 = 0) as ok from nation")
def batch_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each item that was wanted, with whether it was done."""
    done = table(spark, sf_dir, "supplier").filter("s_suppkey % 7 = 0").select(F.col("s_nationkey").alias("n_nationkey"))
    return Q.status_of(done, table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey")


@query("mark_sets", "select n_nationkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(string_split(replace(n_name || '|,|。' || n_name, '|', ''), ''), lambda z: z <> ''), ['●', '◎']))), '') as marks from nation")
def mark_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of a |-joined setting, and the two that always belong to it."""
    marks = T.mark_set(F.concat("n_name", F.lit("|,|。"), "n_name"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(F.sort_array(marks), "").alias("marks"))


@query("page_preview", f"select book, page_idx, pagetxt from ({PAGES}) where page_idx < 2")
def page_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No other page is made."""
    return S.first_pages(raw_books(spark, sf_dir), 2, ROWS, COLUMNS, source=PLAIN_SPARK).select("book", "page_idx", F.md5("pagetxt").alias("pagetxt"))


@query(
    "bound_records",
    f"""with r as ({RAW_PAGES}) select book, page_idx, 'user' as role, md5(regexp_replace(regexp_replace(regexp_replace(translate(replace(raw, '\\h', chr(10)), '$%&', chr(12)), '[ \\t\\f\\r]+(\\n)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as content,
    case when page_idx in (0, 2) then book || '_' || page_idx end as image from r""",
)
def bound_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records of plain pages with the image of their page, by number; pages without one have none."""
    pages = S.paginate_plain(raw_books(spark, sf_dir), ROWS, COLUMNS, PLAIN_SPARK).select("book", "page_idx", T.page_content("pagetxt").alias("content"))
    images = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.explode(F.array(F.lit(0), F.lit(2))).alias("page_idx"))
    bound = Q.bind_images(Q.page_records(pages), images.withColumn("path", F.concat_ws("_", F.col("book").cast("string"), F.col("page_idx").cast("string"))))
    return bound.select("book", "page_idx", F.col("messages")[0]["role"].alias("role"), F.md5(F.col("messages")[1]["content"]).alias("content"), F.try_element_at("images", F.lit(1)).alias("image"))


def placed_sql(source: str, rows: int, half: int) -> str:
    """CTEs after a table source (book, page_idx, seq, cell, text): placed has its comments from right to left, by a fold over a page's."""
    column = f"greatest(z.cell // {rows} * 2, a.free)"
    deep = "greatest(1, trunc(150 / ({0} * 1.3::double)))"
    size = f"list_max(list_filter(range(15, 21), lambda fs: ceil(z.n / {deep.format('fs')}) <= {half} - {column}))"
    free = f"case when {size} is null then a.free else ({column} + ceil(z.n / {deep.format(size)})) end::bigint"
    none = "[]::struct(seq bigint, cell bigint, col bigint, size bigint, text varchar)[]"
    return f"""
each as (select book, page_idx, list({{'free': 0::bigint, 'cell': cell::bigint, 'seq': seq::bigint, 'text': text, 'n': length(translate(text, '●◎。', ''))::bigint, 'rows': {none}}} order by cell, seq, text) as es from {source} group by all),
folded as (select book, page_idx, list_reduce(es, lambda a, z: {{'free': {free}, 'cell': z.cell, 'seq': z.seq, 'text': z.text, 'n': z.n, 'rows': list_append(a.rows, {{'seq': z.seq, 'cell': z.cell, 'col': {column}, 'size': {size}, 'text': z.text}})}},
  {{'free': 0::bigint, 'cell': 0::bigint, 'seq': 0::bigint, 'text': '', 'n': 0::bigint, 'rows': {none}}}) as s from each),
laid as (select book, page_idx, unnest(s.rows) as r from folded),
placed as (select book, page_idx, r.seq::int as seq, r.cell::int as cell, r.text as text, r.col::int as "column", r.size::int as size, r.size is not null as kept from laid)"""


COMMENT = "left(text, conv_id * 3 % 50 + 1)"


@query(
    "comments_placed",
    f"with c as (select conv_id as book, turn % 2 as page_idx, turn as seq, (conv_id * 7 + turn * 13) % 40 as cell, {COMMENT} as text from conversations), {placed_sql('c', 5, 16)} select * exclude (text) from placed",
)
def comments_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as comments of two pages a conversation, placed from right to left or rejected."""
    rows = table(spark, sf_dir, "conversations")
    comments = rows.select(F.col("conv_id").alias("book"), (F.col("turn") % 2).alias("page_idx"), F.col("turn").alias("seq"), ((F.col("conv_id") * 7 + F.col("turn") * 13) % 40).alias("cell"), F.expr(COMMENT).alias("text"))
    return S.place_comments(comments, 5, 16, 150, 20).drop("text")


#: Books with notes and comments, without control characters and marks: there a page's cells are one running count.
NOTED = f"translate({BOOK}, '%$&@●◎-', '')"
NOTED_PAGES = (
    FLATTEN.replace(BOOK, NOTED)
    + f""", ls as (select doc_id, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as pos from flat),
kept as (select doc_id, pos, regexp_replace(line, '\\s', '', 'g') as line from ls),
bare as (select *, regexp_replace(line, '＜[^＞]*(＞|$)', '', 'g') as b from kept where line <> ''),
sized as (select *, (coalesce(list_sum(list_transform(regexp_extract_all(b, '【([^】]*)(?:】|$)', 1), lambda z: ceil(length(z) / 2.0)::int)), 0) + length(replace(regexp_replace(b, '【[^】]*(】|$)', '', 'g'), '】', '')))::bigint as cells from bare),
book as (select doc_id, string_agg(line || repeat(' ', ({ROWS} - cells % {ROWS}) % {ROWS}), '' order by pos) as x from sized group by doc_id),
toks as (select doc_id, unnest(regexp_extract_all(x, '＜[^＞]*＞?|【[^】]*】?|[^＜【]+')) as tok, generate_subscripts(regexp_extract_all(x, '＜[^＞]*＞?|【[^】]*】?|[^＜【]+'), 1) as pos from book),
widths as (select *, case left(tok, 1) when '＜' then 0 when '【' then ceil(length(translate(tok, '【】', '')) / 2.0) else length(replace(tok, '】', '')) end::bigint as w from toks),
ats as (select *, (sum(w) over (partition by doc_id order by pos) - w)::bigint as place from widths),
c as (select doc_id as book, (place // {CELLS})::int as page_idx, row_number() over (partition by doc_id, place // {CELLS} order by pos) - 1 as seq, (place % {CELLS})::int as cell, translate(tok, '＜＞', '') as text from ats where left(tok, 1) = '＜')"""
)


@query("top_comments_placed", f"{NOTED_PAGES}, {placed_sql('c', ROWS, 2 * COLUMNS)} select * from placed")
def top_comments_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of all pages of books with notes, placed or rejected."""
    pages = S.paginate_books(raw_books(spark, sf_dir), ROWS, COLUMNS, source=NOTED)
    comments = pages.select("book", "page_idx", F.posexplode("comments").alias("seq", "c")).select("book", "page_idx", "seq", "c.cell", "c.text")
    return S.place_comments(comments, ROWS, 2 * COLUMNS, 150, 20)


WORD = "split_part(text, ' ', 1)"
BODY = f"concat('＜', {WORD}, '＞', text, '＜＞＜', {WORD}, 'x＞')"


@query(
    "rejected_removed",
    f"""with g as (select conv_id, list_distinct(list('＜' || {WORD} || '＞')) as gone from conversations where turn % 3 = 0 group by conv_id)
    select c.conv_id as book, turn as page_idx, md5(list_reduce(coalesce(gone, []::varchar[]), lambda a, z: replace(a, z, ''), {BODY.replace('text', 'c.text')})) as content from conversations c left join g on g.conv_id = c.conv_id""",
)
def rejected_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    pages = rows.select(F.col("conv_id").alias("book"), F.col("turn").alias("page_idx"), F.expr(BODY).alias("content"))
    placed = rows.select(F.col("conv_id").alias("book"), F.expr(WORD).alias("text"), (F.col("turn") % 3 != 0).alias("kept"))
    return S.remove_rejected(pages, placed).withColumn("content", F.md5("content"))


STRIPPED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(
    "debug_samples",
    f"""with n as (select conv_id as call, turn, {STRIPPED.replace('text', D.han('text'))} as t, row_number() over (partition by conv_id order by turn) as n from conversations where conv_id % 10 = 0)
    select call, turn, length(t)::int as length, length(regexp_replace(t, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))::int as han, replace(replace(left(t, 80), chr(10), '\\n'), chr(12), '\\f') as snippet from n where n <= 3""",
)
def debug_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.debug_samples(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call"), "turn", F.expr(D.han("text")).alias("completion")), "turn")
