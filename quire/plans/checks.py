"""Queries of the small functions: names, drags, layout text, speeds, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import layout as L
from quire.functions import text as T
from quire.operators import evaluate as E
from quire.operators import records as Q
from quire.plans.registry import query, table

NAME = "concat(s_name, case s_suppkey % 3 when 0 then '.tar.gz' when 1 then '' else ' x' end)"


@query(
    "layout_names",
    f"select s_suppkey, regexp_matches({NAME}, '^[A-Za-z0-9_-]+$') as valid, regexp_replace({NAME}, '[^A-Za-z0-9_.-]', '_', 'g') as safe, regexp_replace({NAME}, '\\.[^.]+$', '') as base from supplier",
)
def layout_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.expr(NAME)
    return table(spark, sf_dir, "supplier").select("s_suppkey", T.valid_layout_id(name).alias("valid"), T.safe_name(name).alias("safe"), T.base_name(name).alias("base"))


@query(
    "drag_rectangles",
    "select p_partkey, least(p_size, 30)::int as x, least(p_partkey % 40, 20)::int as y, abs(p_size - 30)::int as w, abs(p_partkey % 40 - 20)::int as h from part where abs(p_size - 30) > 5 and abs(p_partkey % 40 - 20) > 5",
)
def drag_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, y = F.col("p_size").cast("int"), (F.col("p_partkey") % 40).cast("int")
    drawn = table(spark, sf_dir, "part").select("p_partkey", L.normalized_rectangle(F.lit(30), F.lit(20), size, y).alias("r")).filter("r is not null")
    return drawn.select("p_partkey", *(F.col(f"r.{k}").cast("int").alias(k) for k in "xywh"))


@query("layout_yaml", "select n_nationkey, concat_ws(chr(10), 'canvas_id: ' || n_name, 'col_num: ' || n_nationkey::varchar, case when n_regionkey > 1 then 'rows_per_section: ' || n_regionkey::varchar end) as yaml from nation")
def layout_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"canvas_id": F.col("n_name"), "col_num": F.col("n_nationkey"), "rows_per_section": F.when(F.col("n_regionkey") > 1, F.col("n_regionkey"))}
    return table(spark, sf_dir, "nation").select("n_nationkey", L.layout_yaml(fields).alias("yaml"))


@query("comment_area", "select p_partkey, ((p_size % 9 + 2) * 2)::int as half_columns, (2000 - p_size * 2 - 80)::double / ((p_size % 9 + 2) * 2) as half_width, 200 + p_size - 30 - 10 / 2.0::double - 5 - 30 as height from part")
def comment_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    area = L.comment_area(F.lit(2000), size, size, F.lit(80), size % 9 + 2, 200 + size, F.lit(10.0), F.lit(5.0))
    return table(spark, sf_dir, "part").select("p_partkey", area.alias("a")).select("p_partkey", F.col("a.half_columns").cast("int").alias("half_columns"), "a.half_width", "a.height")


@query("token_speed", "select o_orderkey, case when o_custkey % 7 > 0 then o_totalprice::double / (o_custkey % 7) end as speed, o_custkey::double / 4 * 2 as steps from orders")
def token_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    speed = E.speed(F.col("o_totalprice").cast("double"), F.col("o_custkey") % 7)
    steps = L.training_steps(F.col("o_custkey"), F.lit(4), F.lit(2))
    return table(spark, sf_dir, "orders").select("o_orderkey", speed.alias("speed"), steps.alias("steps"))


SHAPES = "transform(split(text, ' '), w -> named_struct('tool', left(w, 1), 'x', 1))"


@query("tool_counts", "with w as (select conv_id, turn, unnest(string_split(text, ' ')) as w from conversations) select conv_id, turn, left(w, 1) as tool, count(*)::int as n from w group by all")
def tool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "conversations").select("conv_id", "turn", L.tool_counts(F.expr(SHAPES)).alias("c"))
    return counted.select("conv_id", "turn", F.explode("c").alias("tool", "n"))


@query(
    "canvas_fallback",
    "select n_nationkey, case when r_regionkey is not null and n_regionkey < 3 then n_regionkey::varchar else 'plain' end as canvas from nation left join region on r_regionkey = n_regionkey",
)
def canvas_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("canvas_id"))
    canvases = table(spark, sf_dir, "region").filter("r_regionkey < 3").select(F.col("r_regionkey").cast("string").alias("canvas_id"))
    return Q.with_canvas(layouts, canvases, "plain").select("n_nationkey", "canvas")


@query("last_answer", "select conv_id as index, arg_max(text, turn) as answer from conversations group by 1")
def last_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth with repeated indices: the last row of each wins."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("index"), F.col("text").alias("answer"), F.lit("").alias("from"), "turn")
    return E.ground_truth(rows, "turn").select("index", "answer")
