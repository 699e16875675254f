"""Queries of typesetting, layouts and records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as T
from quire.operators import records as Q
from quire.operators import typeset as S
from quire.operators import windows as W
from quire.plans import derived as D
from quire.plans.registry import query, table
from quire.session import spread

BOOK = f"translate({D.bracketed('lower(text)')}, 'aeiouq', '一二三四五@')"
#: Control-free text: letters, spaces and line breaks only.
PLAIN = f"regexp_replace({D.ascii_image('text')}, '[^a-zA-Z \\n]', '', 'g')"
PLAIN_SPARK = f"array_join(regexp_extract_all({D.ascii_image('text')}, '[a-zA-Z \\n]+', 0), '')"
ROWS, COLUMNS = 10, 8


@query(
    "normalize_book",
    """select doc_id, md5(replace(regexp_replace(regexp_replace(translate(translate(replace(replace(lower(text), 'a', 'b'), 'b', 'c'), 'xyz', ''), ',.;', '。。。'), '。+', '。', 'g'), '^。', ''), '@', ' ')) as line from documents""",
)
def normalize_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = T.normalize_book_line(F.lower("text"), "ab|bc", "", "x|y", "z", ",|.|;")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(line).alias("line"))


#: (out, within, depth) as one text each, folded over pieces.
FLATTEN = f"""with t as (select doc_id, regexp_extract_all({BOOK}, '[【】＜＞]|[^【】＜＞]+') as pieces from documents),
f as (select doc_id, list_reduce(list_transform(pieces, lambda z: {{'out': z, 'box': '', 'depth': 0}}), lambda acc, p: {{
  'out': acc.out || case when p.out not in ('【', '】', '＜', '＞') then p.out when acc.box = '' and p.out in ('【', '＜') then p.out
          when acc.box = '【' and p.out = '】' and acc.depth = 1 then p.out when acc.box = '＜' and p.out = '＞' then p.out else '' end,
  'box': case when acc.box = '' and p.out in ('【', '＜') then p.out when acc.box = '【' and p.out = '】' and acc.depth = 1 then '' when acc.box = '＜' and p.out = '＞' then '' else acc.box end,
  'depth': case when acc.box = '' and p.out = '【' then 1 when acc.box = '【' and p.out = '【' then acc.depth + 1 when acc.box = '【' and p.out = '】' then acc.depth - 1 else acc.depth end
}}, {{'out': '', 'box': '', 'depth': 0}}) as s from t),
flat as (select doc_id, coalesce(s.out || case s.box when '【' then '】' when '＜' then '＞' else '' end, '') as x from f)"""


@query("flatten_brackets", FLATTEN + " select doc_id, md5(x) as flat, length(x)::bigint as n from flat")
def flatten_brackets(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = T.flatten_brackets(F.expr(BOOK))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(flat).alias("flat"), F.length(flat).cast("long").alias("n"))


MEASURE = """, lines as (select doc_id, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as pos from flat),
bare as (select *, regexp_replace(line, '＜[^＞]*(＞|$)', '', 'g') as b from lines)
select doc_id, pos::int as pos, (coalesce(list_sum(list_transform(regexp_extract_all(b, '【([^】]*)(?:】|$)', 1), lambda z: ceil(length(z) / 2.0)::int)), 0) + length(replace(regexp_replace(b, '【[^】]*(】|$)', '', 'g'), '】', '')))::int as cells from bare"""


@query("measure_lines", FLATTEN + MEASURE)
def measure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(T.flatten_brackets(F.expr(BOOK)), "\n")).alias("at", "line"))
    return lines.select("doc_id", (F.col("at") + 1).alias("pos"), T.measure_line("line").alias("cells"))


LOADED = f"""with l as (select doc_id, list_filter(list_transform(string_split({PLAIN}, chr(10)), lambda z: replace(z, ' ', '')), lambda z: z <> '') as ls from documents),
t as (select doc_id, array_to_string(list_transform(ls, lambda z: z || repeat(' ', (({ROWS} - length(z) % {ROWS}) % {ROWS})::bigint)), '') as x from l)"""


@query("load_text", LOADED + " select doc_id, md5(x) as text, length(x)::bigint as cells from t")
def load_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = S.load_text(F.expr(PLAIN_SPARK), F.lit(ROWS))
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", loaded.alias("x"))
    return lines.select("doc_id", F.md5("x").alias("text"), F.length("x").cast("long").alias("cells"))


CELLS = ROWS * COLUMNS
PAGES = f"""{LOADED}, p as (select doc_id, x, unnest(range(0, greatest(ceil(length(x) / {CELLS}.0), 1)::bigint)) as page from t),
k as (select doc_id, page, unnest(range(0, {COLUMNS})) as k, substr(x, page * {CELLS} + 1, {CELLS}) as own from p),
c as (select doc_id, page, k, substr(own, k * {ROWS} + 1, {ROWS}) as col from k)
select doc_id as book, page::int as page_idx, string_agg(col || case when length(col) < {ROWS} then '' when (k + 1) * {ROWS} = {CELLS // 2} then '$' else '\\h' end, '' order by k) as raw from c group by all"""
RAW_PAGES, PAGES = PAGES, f"select book, page_idx, md5(raw) as pagetxt from ({PAGES})"


def raw_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), "text")


@query("paginate_native", PAGES)
def paginate_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.paginate_plain(raw_books(spark, sf_dir), ROWS, COLUMNS, PLAIN_SPARK).withColumn("pagetxt", F.md5("pagetxt"))


@query("paginate_udtf", PAGES)
def paginate_udtf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table function over the same books gives the same pages."""
    return S.paginate_books(raw_books(spark, sf_dir), ROWS, COLUMNS, source=PLAIN_SPARK).select("book", "page_idx", F.md5("pagetxt").alias("pagetxt"))


def breaks(cell: str) -> str:
    """What ends a column or half a page after a cell."""
    return f"case when {cell} = {CELLS // 2} then '$' when {cell} > 0 and {cell} % {ROWS} = 0 then '\\h' else '' end"


#: Pages of books with notes, comments and controls: running counts of half cells between controls, whose effects are followed one after another.
NOTED_RAW = (
    FLATTEN.replace("with t as", "with recursive t as")
    + f""", ls as (select doc_id, unnest(string_split(x, chr(10))) as line, generate_subscripts(string_split(x, chr(10)), 1) as pos from flat),
kept as (select doc_id, pos, replace(regexp_replace(line, '\\s', '', 'g'), '@', ' ') as line from ls),
bare as (select *, regexp_replace(line, '＜[^＞]*(＞|$)', '', 'g') as b from kept where line <> ''),
sized as (select *, (coalesce(list_sum(list_transform(regexp_extract_all(b, '【([^】]*)(?:】|$)', 1), lambda z: ceil(length(z) / 2.0)::int)), 0) + length(replace(regexp_replace(b, '【[^】]*(】|$)', '', 'g'), '】', '')))::bigint as cells from bare),
book as (select doc_id, string_agg(line || repeat(' ', ({ROWS} - cells % {ROWS}) % {ROWS}), '' order by pos) as x from sized group by doc_id),
found as (select doc_id, regexp_extract_all(x, '(?s)＜[^＞]*＞?|【[^】]*】?|[%$&].{{0,{ROWS - 1}}}|.') as toks from book),
toks as (select doc_id, unnest(toks) as tok, generate_subscripts(toks, 1) as pos from found),
sorts as (select *, left(tok, 1) as k, case when left(tok, 1) in ('%', '$', '&') then left(tok, 1) end as control, case left(tok, 1) when '＜' then 0 when '】' then 0 when '-' then 0 when '%' then 0 when '$' then 0 when '&' then 0
  when '【' then ceil(length(translate(tok, '【】-', '')) / 2.0) else 1 end::bigint as w from toks),
parts as (select *, coalesce(count(control) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0) as part from sorts),
sums as materialized (select *, (sum(w) over (partition by doc_id, part order by pos) - w)::bigint as before from parts),
ends as materialized (select doc_id, part, sum(w)::bigint as w, max(control) as control from sums group by doc_id, part),
bases as (select distinct doc_id, 0::bigint as part, 0::bigint as base from ends union all
  select doc_id, part + 1, case control when '%' then p - p % {CELLS} + {CELLS} when '$' then case when p % {CELLS} in (0, {CELLS // 2}) then p when p % {CELLS} < {CELLS // 2} then p - p % {CELLS} + {CELLS // 2} else p - p % {CELLS} + {CELLS} end
    else case when p % {CELLS} <= {CELLS - ROWS + 1} then p - p % {CELLS} + {CELLS - ROWS} else p end end
  from (select b.doc_id, b.part, e.control, b.base + e.w as p from bases b join ends e on e.doc_id = b.doc_id and e.part = b.part and e.control is not null)),
spots as materialized (select s.doc_id, s.pos, s.tok, s.k, b.base + s.before as p from sums s join bases b on b.doc_id = s.doc_id and b.part = s.part),
notes as (select doc_id, pos, p, regexp_replace(tok, '^【|】$', '', 'g') as said from spots where k = '【'),
signs as (select doc_id, pos, p, unnest(string_split(said, '')) as c, generate_subscripts(string_split(said, ''), 1) as j, length(said) as n from notes where said <> ''),
drawn as (select *, (count(*) filter (c <> '-') over (partition by doc_id, pos order by j))::bigint as m from signs),
turned as (select *, (2 * p + greatest(m, 1) - 1) // {2 * CELLS} as page, max((2 * p + greatest(m, 1) - 1) // {2 * CELLS}) over (partition by doc_id, pos) as final from drawn),
spelt as (select *, case when c = '-' then c else c || case when j = n then '】' else '' end || {breaks(f"((2 * p + m - {2 * CELLS} * page) // 2)")} end as unit from turned),
noted as (select doc_id, pos, page, '【' || string_agg(unit, '' order by j) || case when page < any_value(final) or arg_max(c, j) = '-' then '】' else '' end as unit from spelt group by doc_id, pos, page),
units as (select * from noted union all select doc_id, pos, p // {CELLS}, '【】' from notes where said = '' union all
  select doc_id, pos, p // {CELLS}, case k when '】' then '' when '＜' then '＜' || replace(replace(tok, '＜', ''), '＞', '') || '＞' when '%' then k when '$' then k when '&' then k when '-' then k || {breaks(f"(p % {CELLS})")} else tok || {breaks(f"(p % {CELLS} + 1)")} end from spots where k <> '【'),
raw_pages as (select doc_id as book, page::int as page_idx, string_agg(unit, '' order by pos) as raw from units group by all union all select doc_id, 0, '' from documents where doc_id not in (select doc_id from found where x is not null and len(toks) > 0))"""
).replace("found as (select doc_id, regexp", "found as (select doc_id, x, regexp")


@query(
    "page_records",
    NOTED_RAW
    + """ select book, page_idx, '<image>' || chr(10) || 'OCR:【】＜＞。、' as prompt, md5(regexp_replace(regexp_replace(regexp_replace(translate(replace(raw, '\\h', chr(10)), '$%&', chr(12)), '[ \\t\\f\\r]+(\\n|$)', '\\1', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as content,
    case when page_idx in (0, 2, 4, 6) then printf('%d_%03d.jpg', book, page_idx) end as image from raw_pages""",
)
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books with notes, comments and controls to chat records; even ones of a book's first eight pages have an image."""
    records = Q.page_records(S.paginate_books(raw_books(spark, sf_dir), ROWS, COLUMNS, source=BOOK))
    numbered = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("book"), F.explode(F.sequence(F.lit(0), F.lit(6), F.lit(2))).alias("page_idx"))
    bound = Q.bind_images(records, numbered.withColumn("path", F.format_string("%s_%03d.jpg", F.col("book").cast("string"), "page_idx")))
    said = F.col("messages")
    return bound.select("book", "page_idx", said[0]["content"].alias("prompt"), F.md5(said[1]["content"]).alias("content"), F.try_element_at("images", F.lit(1)).alias("image"))


@query("cell_positions", f"with w as (select doc_id, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as pos from documents) select doc_id, pos::int - 1 as pos, (coalesce(sum(length(word)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0))::bigint as cell from w")
def cell_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "word")).withColumn("width", F.length("word"))
    return W.cell_positions(tokens, ["doc_id"]).select("doc_id", "pos", "cell")


CONTENT = "concat(replace(replace(replace(lower(text), 'th', '\\\\h'), 'er', '$'), 'on', '%'), '＜', doc_id, '＞  ')"
CONTENT_SQL = CONTENT.replace("\\\\h", "\\h")


@query(
    "page_content",
    f"""select doc_id, md5(regexp_replace(regexp_replace(regexp_replace(translate(replace(regexp_replace({CONTENT_SQL}, '＜[^＞]*＞', '', 'g'), '\\h', chr(10)), '$%&', chr(12)), '[ \\t\\f\\r]+(\\n)', '\\1', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) as content from documents""",
)
def page_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.page_content(F.expr(CONTENT), drop_comments=True)).alias("content"))


POSITIONS = "concat(n_nationkey * 37 % 500 + 40, ',', n_nationkey * 53 % 300 + 10, ', ', n_nationkey * 11 % 90 + 330, ',')"
WIDTHS = "case when n_regionkey < 2 then concat(n_nationkey + 20, ',30,', n_nationkey * 2 + 11) else '' end"
BOXES = f"""with n as (select n_nationkey, n_regionkey, list_transform([n_nationkey * 37 % 500 + 40, n_nationkey * 53 % 300 + 10, n_nationkey * 11 % 90 + 330], lambda z: z::double) as xs,
 [n_nationkey + 20, 30, n_nationkey * 2 + 11]::double[] as ws from nation),
p as (select n_nationkey, n_regionkey, unnest(xs) as x, unnest(ws) as w, generate_subscripts(xs, 1) as i from n),
c as (select n_nationkey, x, case when n_regionkey < 2 then w else coalesce(x - lead(x) over (partition by n_nationkey order by x desc, i), max(x) over (partition by n_nationkey) - min(x) over (partition by n_nationkey)) end as w,
 row_number() over (partition by n_nationkey order by x desc, i) as col from p)"""


@query("column_boxes", BOXES + " select n_nationkey, col::int as col, x, w from c")
def column_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(L.column_boxes(F.expr(POSITIONS), F.expr(WIDTHS))).alias("at", "b"))
    return boxes.select("n_nationkey", (F.col("at") + 1).alias("col"), "b.x", "b.w")


@query("derived_widths", """with p as (select o_custkey, o_orderkey % 997 as x from orders), d as (select distinct o_custkey, x::double as x from p)
select o_custkey, x, coalesce(x - lead(x) over (partition by o_custkey order by x desc), max(x) over (partition by o_custkey) - min(x) over (partition by o_custkey)) as w from d""")
def derived_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderkey") % 997).cast("double").alias("x")).distinct()
    return W.derived_widths(columns, ["o_custkey"])


ZONES = "concat(s_suppkey, ',', s_suppkey * 2, ',30,40;bad,1,2,3; ', s_suppkey + 1, ',5, 6 ,7;1,2')"


@query("image_zones", "with z as (select s_suppkey, unnest([{'x': s_suppkey::double, 'y': 1000.0 - s_suppkey * 2 - 40, 'w': 30.0, 'h': 40.0}, {'x': s_suppkey + 1.0, 'y': 1000.0 - 5 - 7, 'w': 6.0, 'h': 7.0}]) as z from supplier) select s_suppkey, z.x::double as x, z.y::double as y, z.w::double as w, z.h::double as h from z")
def image_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(L.image_zones(F.expr(ZONES), F.lit(1000.0))).alias("z")).select("s_suppkey", "z.*")


COLOUR = "case c_custkey % 5 when 0 then ' Red' when 1 then concat('rgb(', c_custkey % 256, ',2,255)') when 2 then '#0a10FF' when 3 then 'gray' else 'none' end"


@query(
    "colour_parse",
    """select c_custkey, round(case c_custkey % 5 when 0 then 1.0 when 1 then (c_custkey % 256) / 255.0 when 2 then 10 / 255.0 when 3 then 0.5 else 0.0 end::double, 6) as r,
    round(case c_custkey % 5 when 1 then 2 / 255.0 when 2 then 16 / 255.0 when 3 then 0.5 else 0.0 end::double, 6) as g, round(case c_custkey % 5 when 1 then 1.0 when 2 then 1.0 when 3 then 0.5 else 0.0 end::double, 6) as b from customer""",
)
def colour_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = table(spark, sf_dir, "customer").select("c_custkey", T.parse_colour(F.expr(COLOUR)).alias("c"))
    return parsed.select("c_custkey", *(F.round(f"c.{k}", 6).alias(k) for k in "rgb"))


@query(
    "grid_cells",
    """with g as (select n_nationkey, n_nationkey % 6 + 2 as cn, n_nationkey % 4 + 3 as rn, 2000.0::double as w, 1000.0::double as h from nation),
    i as (select *, unnest(range(1, cn + 1)) as i from g), j as (select *, unnest(range(1, rn + 1)) as j, (w - 50 - 60 - 80) / cn as cw, (h - 200 - 100) / rn as rh from i)
    select n_nationkey, ((i - 1) * rn + j)::int as cell, w - 60 - cw * i - case when i > cn // 2 then 80 else 0 end as x, h - 200 - rh * j as y, cw as w from j""",
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda v: F.lit(float(v))
    columns, rows = (F.col("n_nationkey") % 6 + 2).cast("int"), (F.col("n_nationkey") % 4 + 3).cast("int")
    grid = L.even_grid(c(2000), c(1000), c(50), c(60), c(200), c(100), c(80), columns, rows)
    return table(spark, sf_dir, "nation").select("n_nationkey", F.explode(grid).alias("g")).select("n_nationkey", F.col("g.cell").cast("int").alias("cell"), "g.x", "g.y", "g.w")


@query(
    "topcomment_fit",
    """with f as (select doc_id, unnest(range(15, 25)) as fs, length(text) as n, doc_id % 40 + 1 as cols from documents)
    select doc_id, max(fs) filter (ceil(n / greatest(1, trunc(900 / (fs * 1.3)))) <= cols)::int as size from f group by doc_id""",
)
def topcomment_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = L.comment_fit(F.length("text"), F.lit(24), F.col("doc_id") % 40 + 1, F.lit(900.0))
    return table(spark, sf_dir, "documents").select("doc_id", size.cast("int").alias("size"))


@query(
    "preview_info",
    "select p_partkey, (2000 - p_size * 2 - 80)::double / (p_size % 9 + 2) as col_width, (1000 - 300)::double / (p_size % 7 + 3) as row_height, ((p_size % 9 + 2) * (p_size % 7 + 3))::int as page_chars, greatest(p_size / 20.0::double, 40.0::double / p_size, 1.0::double) as cover from part",
)
def preview_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    info = L.preview(F.lit(2000), F.lit(1000), size, size, F.lit(200), F.lit(100), F.lit(80), size % 9 + 2, size % 7 + 3)
    rows = table(spark, sf_dir, "part").select("p_partkey", info.alias("i"), L.cover_scale(size.cast("double"), F.lit(40.0), F.lit(20.0), size.cast("double")).alias("cover"))
    return rows.select("p_partkey", "i.col_width", "i.row_height", F.col("i.page_chars").cast("int").alias("page_chars"), "cover")


SHAPES = """array(named_struct('tool', 'body', 'x', p_size * 1.5D, 'y', 300.5D, 'w', 1500D, 'h', 1000D + p_size), named_struct('tool', case when p_size % 2 = 0 then 'margin' else 'other' end, 'x', 10D, 'y', 20D, 'w', 30D, 'h', p_size * 1D),
 named_struct('tool', 'col_box', 'x', 100D, 'y', 0D, 'w', p_size + 30.4D, 'h', 9D), named_struct('tool', 'col_box', 'x', 900.5D, 'y', 0D, 'w', 60D, 'h', 9D))"""


@query(
    "derive_layout",
    """select p_partkey, 301::bigint as margins_top, floor(2000 - 300.5 - (1000 + p_size) + 0.5)::bigint as margins_bottom, floor(p_size * 1.5 + 0.5)::bigint as margins_left,
    case when p_size % 2 = 0 then floor(20 + p_size + 0.5)::bigint end as fish_top_y, case when p_size % 2 = 0 then 'top' end as fish_position, 2 as col_num, '901,100' as col_positions,
    '60,' || floor(p_size + 30.4 + 0.5)::bigint as col_widths, greatest(10, floor(least(60, p_size + 30.4)::double * 0.85::double / 2) * 2)::bigint as text_font1_size,
    greatest(1, floor((1000 + p_size) / (greatest(10, floor(least(60, p_size + 30.4)::double * 0.85::double / 2) * 2) * 1.1::double)))::bigint as row_num, case when p_size % 2 = 0 then 0 else 1 end as no_topcmt from part""",
)
def derive_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = L.derive_layout(F.expr(SHAPES), F.lit(2500.0), F.lit(2000.0), F.lit(None).cast("double"))
    names = ("margins_top", "margins_bottom", "margins_left", "fish_top_y", "fish_position", "col_num", "col_positions", "col_widths", "text_font1_size", "row_num", "no_topcmt")
    return table(spark, sf_dir, "part").select("p_partkey", *(fields[k].alias(k) for k in names))


WORDS = "named_struct('text', w, 'l1_alert', length(w) > 12, 'l2_alert', length(w) > 14, 'suggest', case when length(w) > 14 then left(w, 1) end)"


def annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as pages, turns as lines."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text"), F.expr(f"transform(split(text, ' '), w -> {WORDS})").alias("words"))
    return lines.groupBy(F.col("conv_id").alias("fileName")).agg(F.array_sort(F.collect_list(F.struct("turn", "text", "words"))).alias("classifiedLines"))


@query("annotation_flatten", """with l as (select conv_id, text, row_number() over (partition by conv_id order by turn, text) - 1 as line from conversations), w as (select conv_id, line, unnest(string_split(text, ' ')) as text, generate_subscripts(string_split(text, ' '), 1) - 1 as word from l)
select conv_id as "fileName", line::int as line, word::int as word, text, length(text) > 12 as l1_alert, length(text) > 14 as l2_alert from w""")
def annotation_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.flatten_words(annotation(spark, sf_dir)).drop("suggest")


@query("alert_counts", """with w as (select conv_id, unnest(string_split(text, ' ')) as text from conversations)
select conv_id as "fileName", count(*)::bigint as words, count_if(length(text) > 12)::bigint as l1, count_if(length(text) > 14)::bigint as l2, count_if(length(text) > 14)::bigint as suggested from w group by all""")
def alert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.alert_counts(Q.flatten_words(annotation(spark, sf_dir)))


@query("page_text", """select conv_id as "fileName", md5(string_agg(text, chr(10) order by turn, text)) as text from conversations group by all""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation(spark, sf_dir).select("fileName", F.md5(Q.page_text(F.col("classifiedLines"))).alias("text"))


@query("numerals", "select o_orderkey, case when o_orderkey % 1000 < 25 then n_name else (o_orderkey % 1000)::varchar end as pager from orders left join nation on n_nationkey = o_orderkey % 1000")
def numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("page_idx"))
    lookup = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n"), F.col("n_name").alias("zh"))
    return Q.numerals(pages, lookup).select("o_orderkey", "pager")


@query(
    "font_fallback",
    "with c as (select distinct unnest(string_split(text, '')) as ch from benchmark), g as (select n_name as font, n_nationkey as priority, unnest(range(60 + n_nationkey * 3, 90 + n_nationkey * 3)) as cp from nation), b as (select cp, arg_min(font, priority) as font from g group by cp) select ch, font from c left join b on cp = unicode(ch)",
)
def font_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    chars = table(spark, sf_dir, "benchmark").select(F.explode(T.chars(F.col("text"))).alias("ch")).distinct()
    glyphs = table(spark, sf_dir, "nation").select(F.col("n_name").alias("font"), F.col("n_nationkey").alias("priority"), F.explode(F.expr("sequence(60 + n_nationkey * 3, 89 + n_nationkey * 3)")).alias("codepoint"))
    return Q.choose_fonts(chars, glyphs)


@query(
    "sample_dataset",
    """with s as (select text, role, conv_id || '-' || turn as image_path, md5('42|user:OCR|assistant:' || text || '|' || conv_id || '-' || turn) as o from conversations),
    c as (select * from s order by o limit 100) select 'OCR' as prompt, image_path from c where image_path in (select image_path from s where role = 'user')""",
)
def sample_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled sample of records whose image exists; the order is a hash of the record."""
    turns = table(spark, sf_dir, "conversations")
    records = turns.select(Q.chat_messages(F.col("text"), "OCR").alias("messages"), F.array(F.concat_ws("-", "conv_id", "turn")).alias("images"))
    paths = turns.filter("role = 'user'").select(F.concat_ws("-", "conv_id", "turn").alias("path"))
    return Q.training_samples(records, paths, limit=100).select(F.col("prompt")[0]["content"].alias("prompt"), "image_path")
