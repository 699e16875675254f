"""Queries of the readers and writers: each writes a table in a file format and reads it back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import form
from quire.operators import evaluate as E
from quire.operators import records as Q
from quire.plans.evaluation import FIRST_SQL, samples
from quire.plans import derived as D
from quire.plans.registry import query, table
from quire.session import scratch
from quire.sources import files as S
from quire.sources.layout_table import LayoutTable, Refused

#: Files of a table that is written in order.
FILES = 5
ANSWER = "concat(text, chr(10), '\"', item_id, '\", ', case when item_id % 3 = 0 then '' else 'x' end)"


@query("truth_csv", f"select (item_id % 17)::bigint as index, md5(arg_max({ANSWER}, item_id)) as answer, arg_max('f' || item_id, item_id) as \"from\" from benchmark group by item_id % 17")
def truth_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth as CSV of quoted lines over several files, with repeated indices of which the last stands."""
    path = scratch(spark, "truth")
    rows = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 17).alias("index"), F.expr(ANSWER).alias("answer"), F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("from"), "item_id")
    in_order = rows.repartitionByRange(FILES, "item_id").sortWithinPartitions("item_id").drop("item_id")
    in_order.write.csv(path, header=True, escape="\"", quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return E.ground_truth(S.read_truth(spark, path), "row_order").withColumn("answer", F.md5("answer"))


PREDICTED = "case when turn % 4 = 0 then null else text end"


@query("predictions_jsonl", f"select 'm' || (conv_id % 3) as model, count(*)::bigint as n, count_if(ok)::bigint as ok, count_if(ocr = '')::bigint as blank, count_if(image = '')::bigint as unnamed, sum(length(ocr))::bigint as chars from (select conv_id, coalesce({PREDICTED}, '') as ocr, case when turn % 5 = 0 then '' else 'p' end as image, conv_id % 2 = 0 as ok from conversations) group by conv_id % 3")
def predictions_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions as JSON lines with missing keys and blank lines, in a folder for each model; one file that is asked for is missing."""
    root = scratch(spark, "predictions")
    rows = table(spark, sf_dir, "conversations").withColumn("model", F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")))
    line = F.to_json(F.struct(F.when(F.col("turn") % 5 != 0, F.lit("p")).alias("image"), F.expr(PREDICTED).alias("ocr"), F.when(F.col("conv_id") % 2 == 0, True).alias("ok")))
    rows.select("model", F.concat(line, F.lit("\n")).alias("value")).write.partitionBy("model").text(root)
    found = S.catalog(spark, root, "part-*").select(F.explode("files").alias("path"))
    paths = [r.path for r in found.collect()]  # as many as the writer's tasks made
    read = S.read_predictions(spark, [*paths, f"{root}/m9/missing.jsonl"])
    return read.groupBy("model").agg(F.count("*").alias("n"), F.count_if("ok").alias("ok"), F.count_if(F.col("ocr") == "").alias("blank"), F.count_if(F.col("image") == "").alias("unnamed"), F.sum(F.length("ocr").cast("long")).alias("chars"))


CALLED = "case when conv_id % 7 = 6 then 'realphoto_' else '' end || 'm' || (conv_id % 5)"


@query("model_catalog", f"select 'm' || k as model, k < 3 as known, count(c)::bigint as predictions from (select unnest([0, 1, 2, 9]) as k) left join (select {CALLED} as c from conversations) on c = 'm' || k group by k")
def model_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the models asked for, by a catalog of files; photographed ones go, and a name that is unknown is warned of."""
    root = scratch(spark, "catalog")
    rows = table(spark, sf_dir, "conversations").select(F.expr(CALLED).alias("model"), F.to_json(F.struct(F.col("text").alias("ocr"))).alias("value"))
    rows.repartition("model").write.partitionBy("model").text(root)
    found, asked = S.catalog(spark, root, "part-*"), ["m0", "m1", "m2", "m9"]
    paths = [r.path for r in E.select_models(found, asked).select(F.explode("files").alias("path")).collect()]
    chosen = E.select_models(S.read_predictions(spark, paths), asked, skip_realphoto=True, catalog=found)
    unknown = E.unknown_models(asked, found)
    counted = chosen.groupBy("model").agg(F.count("*").alias("predictions"))
    named = found.select("model").filter(F.col("model").isin(asked)).withColumn("known", F.lit(True))
    missing = spark.createDataFrame([(m, False) for m in unknown], "model string, known boolean")
    return named.unionByName(missing).join(counted, "model", "left").select("model", "known", F.coalesce("predictions", F.lit(0)).alias("predictions"))


@query("summary_csv", FIRST_SQL + "\nselect 模型, 期别, 成功::int as 成功, 失败::int as 失败, round(NED, 4) as NED, round(NER_F1, 4) as NER_F1, round(分数, 2) as 分数 from first_scored")
def summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary, rounded for output, as CSV."""
    path = scratch(spark, "summary")
    S.write_summary(E.report(E.summarize_first(E.first_phases(samples(spark, sf_dir, D.FIRST_TEXT)))), path)
    return spark.read.option("header", True).schema("`模型` string, `期别` string, `成功` int, `失败` int, NED double, NER_F1 double, `分数` double").csv(path)


@query("chat_jsonl", "select md5(text) as content, 'OCR' as prompt, conv_id || '-' || turn as image from conversations where turn % 2 = 0")
def chat_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat records as JSON lines, read back; those whose image isn't there go."""
    path = scratch(spark, "chat")
    turns = table(spark, sf_dir, "conversations")
    name = F.concat_ws("-", "conv_id", "turn")
    S.write_chat(turns.select(Q.chat_messages(F.col("text"), "OCR").alias("messages"), F.array(name).alias("images")), path)
    read = S.read_chat(spark, path).select(F.col("messages")[1]["content"].alias("text"), F.col("messages")[0]["content"].alias("prompt"), F.col("images")[0].alias("image"))
    have = turns.filter("turn % 2 = 0").select(name.alias("image"))
    return read.join(have, "image", "left_semi").select(F.md5("text").alias("content"), "prompt", "image")


@query("page_jsonl", "select item_id as page, md5(text) as content, ['p' || item_id || '.jpg'] = ['p' || item_id || '.jpg'] as named from benchmark")
def page_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page records, bound to their images, as JSON lines."""
    path = scratch(spark, "pages")
    pages = table(spark, sf_dir, "benchmark").select(F.lit("b").alias("book"), F.col("item_id").alias("page_idx"), F.col("text").alias("content"))
    images = pages.select("book", "page_idx", F.format_string("p%d.jpg", "page_idx").alias("path"))
    S.write_chat(Q.bind_images(Q.page_records(pages), images), path)
    read = S.read_chat(spark, path)
    page = F.regexp_extract(F.col("images")[0], r"p(\d+)\.jpg", 1).cast("long")
    return read.select(page.alias("page"), F.md5(F.col("messages")[1]["content"]).alias("content"), (F.size("images") == 1).alias("named"))


@query(
    "layout_files",
    "select 'l' || s_suppkey as file, s_suppkey::int as margins_top, 1000 + s_suppkey::int as canvas_width, s_suppkey % 2 = 0 as if_book_vline, '#0a10ff' as text_font_color, s_name as spine_title, null::int as row_num, s_suppkey / 4.0::double as ratio from supplier",
)
def layout_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts as key: value files with comments and quotes, typed by the form's fields."""
    root = scratch(spark, "layouts")
    content = "# layout %d\nmargins_top: %d # px\ncanvas_width: \"%d\"\n\nif_book_vline: %d\ntext_font_color: '#0a10ff'\nspine_title: %s # name\nrow_num: many\nratio: %s\nbroken"
    k = F.col("s_suppkey")
    title = F.concat(F.lit("'"), "s_name", F.lit("'"))  # quoted, since names hold a #
    S.write_named(table(spark, sf_dir, "supplier").select(F.concat(F.lit("l"), k.cast("string")).alias("name"), F.format_string(content, k, k, k + 1000, 1 - k % 2, title, (k / 4).cast("string")).alias("content")), root)
    read = S.read_layouts(spark, root).select("file", form.typed_settings(F.col("settings")).alias("s"), S.typed(F.element_at("settings", "ratio")).alias("ratio"))
    ratio = F.coalesce("ratio.d", F.col("ratio.i").cast("double"))
    return read.select("file", "s.margins_top", "s.canvas_width", "s.if_book_vline", "s.text_font_color", "s.spine_title", "s.row_num", ratio.alias("ratio"))


@query("canvas_files", "select 'c' || s_suppkey as file, 'width' as key, (s_suppkey * 10)::varchar as value from supplier union all select 'c' || s_suppkey, 'colour', '#fff' from supplier")
def canvas_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canvases as key=value files with comments."""
    root, k = scratch(spark, "canvases"), F.col("s_suppkey")
    S.write_named(table(spark, sf_dir, "supplier").select(F.concat(F.lit("c"), k.cast("string")).alias("name"), F.format_string("# canvas\nwidth=%d\ncolour=#fff\nnothing\n#x=1", k * 10).alias("content")), root)
    return S.read_settings(spark, root, "=")


@query("lookup_file", "select c_custkey::varchar as n, c_name || '|' || c_nationkey as zh from customer where c_custkey % 5 <> 0")
def lookup_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lookup")
    line = F.expr("case when c_custkey % 5 = 0 then concat('no ', c_name) else concat(c_custkey, '|', c_name, '|', c_nationkey) end")
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return S.read_lookup(spark, path)


@query("book_files", "select 'b' || item_id as book, md5(text || chr(10) || item_id || chr(10)) as text from benchmark")
def book_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books, a file each, read whole."""
    root, k = scratch(spark, "books"), F.col("item_id").cast("string")
    S.write_named(table(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), k).alias("name"), F.concat("text", F.lit("\n"), k).alias("content")), root)
    return S.read_books(spark, root).withColumn("text", F.md5("text"))


@query("comment_log", "select conv_id::int as page_idx, turn::int as cell, md5(replace(text, chr(10), ' ') || '|z') as text from conversations")
def comment_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "comments")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_idx"), F.col("turn").alias("cell"), F.concat(F.translate("text", "\n", " "), F.lit("|z")).alias("text"))
    S.write_comments(rows, path)
    return S.read_comments(spark, path).withColumn("text", F.md5("text"))


@query("file_list", "select 'f' || s_suppkey as name, length(s_name)::bigint + 1 as length from supplier where s_suppkey % 3 > 0")
def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one extension in all subfolders, beside those of another."""
    root = scratch(spark, "fonts")
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_name").alias("content"))
    S.write_named(rows.filter("s_suppkey % 3 > 0"), f"{root}/a/b")
    S.write_named(rows.filter("s_suppkey % 3 = 0"), f"{root}/c", extension="csv")
    return S.list_files(spark, root, "*.txt").select(S.file_name("path").alias("name"), "length")


@query("annotation_script", "select 'f' || item_id as \"fileName\", md5(text) as text, len(string_split(text, ' '))::bigint as words, md5(array_to_string(string_split(text, ' '), '')) as joined from benchmark")
def annotation_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated pages as scripts that assign one object each, some pages a script; words join to the text of their line."""
    path = scratch(spark, "annotation")
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("text")))
    page = F.to_json(F.struct(F.concat(F.lit("f"), F.col("item_id").cast("string")).alias("fileName"), F.array(F.struct("text", words.alias("words"))).alias("classifiedLines")))
    scripts = table(spark, sf_dir, "benchmark").groupBy(F.expr("concat('s', item_id div 10)").alias("name")).agg(F.array_join(F.collect_list(page), ", ").alias("pages"))
    S.write_named(scripts.select("name", F.concat(F.lit('window.DATA_JSON = {"pages": ['), "pages", F.lit("]};")).alias("content")), path)
    read = S.read_annotation(spark, path)
    line = F.col("classifiedLines")[0]
    return read.select("fileName", F.md5(Q.page_text(F.col("classifiedLines"))).alias("text"), F.size(line["words"]).cast("long").alias("words"), F.md5(Q.line_text(line["words"])).alias("joined"))


def _bitmap(rgb_row: Column, width: Column, height: Column) -> Column:
    """A bitmap file's text: rows that are all alike, each filled to a multiple of four bytes, of bytes below 128."""
    number = lambda n, size: F.concat(*(F.char(F.expr(f"({n}) div {1 << (8 * i)} % 256")) for i in range(min(size, 4))), F.repeat(F.char(F.lit(0)), F.lit(max(0, size - 4))))
    row = F.concat(F.regexp_replace(rgb_row, "(.)(.)(.)", "$3$2$1"), F.repeat(F.char(F.lit(0)), F.pmod(-3 * width, F.lit(4))))
    head = F.concat(F.lit("BM"), number("54 + height * (3 * width + pmod(-3 * width, 4))", 4), number("0", 4), number("54", 4), number("40", 4), number("width", 4), number("height", 4), number("1", 2), number("24", 2), number("0", 24))
    return F.concat(head, F.repeat(row, height))


@query("images", "select 'i' || s_suppkey as name, (s_suppkey % 5 + 1)::int as width, (s_suppkey % 3 + 2)::int as height, md5(repeat(left(s_name, 3 * (s_suppkey % 5 + 1)::int), (s_suppkey % 3 + 2)::int)) as rgb from supplier where s_suppkey % 10 < 9 union all select 'i' || s_suppkey, null, null, null from supplier where s_suppkey % 10 = 9")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of striped pixels, decoded on the executors; some are broken."""
    root = scratch(spark, "images")
    sized = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_name", "concat('i', s_suppkey) as name", "int(s_suppkey % 5 + 1) as width", "int(s_suppkey % 3 + 2) as height")
    drawn = _bitmap(F.expr("left(s_name, 3 * width)"), F.col("width"), F.col("height"))
    S.write_named(sized.select("name", F.when(F.col("s_suppkey") % 10 < 9, drawn).otherwise("not an image").alias("content")), root)
    return S.read_images(spark, root).select(S.file_name("path").alias("name"), "width", "height", F.md5("rgb").alias("rgb"))


@query(
    "layout_table",
    """select 'l' || c_custkey as id, case when c_custkey % 4 = 1 then 'v' || c_custkey else 'l' || c_custkey end as name, case when c_custkey % 4 = 1 then 'v' || c_custkey end as canvas,
       case when c_custkey % 2 = 0 then (c_custkey * 2)::varchar else c_custkey::varchar end as rows, 4::bigint as versions, true as refused from customer where c_custkey % 5 <> 0""",
)
def layout_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts created, saved over and beside, and deleted; creating some of them again is refused and changes nothing."""
    layouts = LayoutTable(spark, scratch(spark, "layout-table"))
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "concat('l', c_custkey) as id", "concat(if(c_custkey % 4 = 1, concat('canvas_id: v', c_custkey, '\n'), ''), 'row_num: ', c_custkey, ' # rows') as yaml")
    layouts.create(rows.filter("c_custkey % 3 > 0"))
    layouts.save(rows.filter("c_custkey % 3 = 0 or c_custkey % 7 = 0"))
    layouts.update(rows.filter("c_custkey % 2 = 0").withColumn("yaml", F.expr("concat('row_num: ', c_custkey * 2)")))
    try:
        layouts.create(rows.filter("c_custkey % 11 = 1"))
        refused = False
    except Refused:
        refused = True
    layouts.delete(rows.filter("c_custkey % 5 = 0"))
    settings = F.col("settings")
    return layouts.layouts().select("id", "name", F.element_at(settings, "canvas_id").alias("canvas"), F.element_at(settings, "row_num").alias("rows"), F.lit(len(layouts.versions())).cast("long").alias("versions"), F.lit(refused).alias("refused"))
