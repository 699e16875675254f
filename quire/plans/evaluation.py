"""Queries of the evaluation: leaderboards, metrics, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import metrics as M
from quire.functions import text as T
from quire.operators import evaluate as E
from quire.operators import windows as W
from quire.plans import derived as D
from quire.plans.registry import query, table
from quire.session import spread


def samples(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Turns as predictions of benchmark passages."""
    predictions = table(spark, sf_dir, "conversations").select(*(F.expr(v).alias(k) for k, v in D.PREDICTIONS.items()), F.expr(text).alias("ocr"))
    truth = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("index"), F.expr(text).alias("answer"), F.lit("").alias("from"))
    return E.joined(predictions, E.ground_truth(truth))


SAMPLES_SQL = """
p as (select {predictions}, {text} as pred from conversations),
d as (select *, case when image like '%【一期】%' then '一期' when image like '%【二期】%' then '二期' when image like '%【三期】%' then '三期' end as period,
      try_cast(nullif(regexp_extract(image, '/([0-9]+)\\.png$', 1), '') as bigint) as seq, ok or finish_reason = 'stop' as success from p),
s as (select d.*, {text_b} as answer from d join benchmark b on b.item_id = d.seq)"""


def samples_sql(text: str) -> str:
    return SAMPLES_SQL.format(predictions=D.PREDICTIONS_SQL, text=text, text_b=text.replace("text", "b.text"))


STRIP = """regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace({0}, '</?(footnote|head)>', '', 'g'), '【', ''), '】', ''), '＜', ''), '＞', ''), '<[^>]+>', '', 'g'),
 '[●◎○☆◇◆△▲▽▼※。，、；：！？「」『』《》（）—…·～]|[,.!?;:''"\\[\\]{{}}()<>/\\\\|@$%^&*+=`~]', '', 'g')"""
LINE = "replace(replace({0}, chr(10), ''), chr(13), '')"
#: The exact sum, of whole numbers of 2^-96, is rounded by way of its digits.
MEAN = "(sum(({0} * 79228162514264337593543950336.0::double)::hugeint)::varchar::double / 79228162514264337593543950336.0::double) / count({0})"
CHARS = "list_distinct(string_split({0}, ''))"


def set_f1_sql(a: str, b: str) -> str:
    """F1 of two lists without repeats."""
    hits = f"len(list_intersect({a}, {b}))::double"
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 or {hits} = 0 then 0.0::double else 2 * ({hits} / len({b})) * ({hits} / len({a})) / ({hits} / len({b}) + {hits} / len({a})) end)"


def soft_f1_sql(a: str, b: str, threshold: float) -> str:
    """Soft F1 of two lists of entities, by a fold over candidates in falling order of score."""
    score = set_f1_sql("list_distinct(list_filter(string_split(g, ''), lambda z: z <> ''))", "list_distinct(list_filter(string_split(q, ''), lambda z: z <> ''))")
    score = score.replace("g, ''", f"{a}[i], ''").replace("q, ''", f"{b}[j], ''")
    scored = f"flatten(list_transform(range(1, len({a}) + 1), lambda i: list_transform(range(1, len({b}) + 1), lambda j: {{'less': -({score}), 'i': i, 'j': j}})))"
    wanted = f"list_sort(list_filter({scored}, lambda c: c.less < 0 and c.less <= -{threshold}))"
    fold = f"list_reduce(list_transform({wanted}, lambda c: [c]), lambda acc, c: case when len(list_filter(acc, lambda m: m.i = c[1].i or m.j = c[1].j)) > 0 then acc else list_concat(acc, c) end, [{{'less': 0.0::double, 'i': -1::bigint, 'j': -1::bigint}}])"
    total = f"(-list_sum(list_transform({fold}, lambda m: m.less)))"
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 or {total} <= 0 then 0.0::double else 2 * ({total} / len({b})) * ({total} / len({a})) / ({total} / len({b}) + {total} / len({a})) end)"


FIRST_SQL = f"""
with {samples_sql(D.FIRST_TEXT)},
t as (select *, {LINE.format(STRIP.format("answer"))} as g, {LINE.format(STRIP.format("pred"))} as q,
      regexp_extract(answer, '<head>(.*?)</head>', 1, 's') as ge, regexp_extract(pred, '<head>(.*?)</head>', 1, 's') as pe from s where period <> '三期'),
e as (select *, len(list_intersect({CHARS.format("ge")}, {CHARS.format("pe")}))::double as hit from t),
f as (select *, case when ge = '' and pe = '' then 1.0::double when ge = '' or pe = '' or hit = 0 then 0.0::double
      else 2 * (hit / len({CHARS.format("pe")})) * (hit / len({CHARS.format("ge")})) / (hit / len({CHARS.format("pe")}) + hit / len({CHARS.format("ge")})) end as es from e),
m as (select model, period, success, case when success then case when greatest(length(g), length(q)) = 0 then 0.0::double else 1 - levenshtein(g, q)::double / greatest(length(g), length(q)) end end as ned,
      case when success then case when es >= 0.5 then es else 0.0::double end end as ner from f),
first_rows as (select model as 模型, period as 期别, count_if(success)::bigint as 成功, count_if(not success)::bigint as 失败, {MEAN.format("ned")} as NED, {MEAN.format("ner")} as NER_F1
      from m group by all having count_if(success) > 0),
first_scored as (select *, (0.8::double * NED + 0.2::double * NER_F1) * 100 as 分数 from first_rows)"""

BACK = "translate({0}, '" + D.HANZI + "', 'abcdefghijkl')"
HALF = "translate({0}, '＜＞', '<>')"
MAIN = BACK.format("regexp_replace(regexp_replace(regexp_replace({0}, '<(.|\\n)*?>', '', 'g'), '【(.|\\n)*?】', '', 'g'), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')")


def pairs_sql(table_name: str, key: str, column: str) -> str:
    """CTE body: key and the sorted list of mark pairs of a column."""
    return f"""
select {key}, list({{'ch': c, 'mark': translate(mark, '○〇', '。。')}} order by pos) as pairs from (
  select *, row_number() over (partition by {key}, c order by pos) as place from (
    select {key}, pos, ch as mark, last_value(case when ch >= '一' and ch <= chr(40959) then ch end ignore nulls) over (partition by {key} order by pos rows between unbounded preceding and current row) as c
    from (select {key}, unnest(string_split({column}, '')) as ch, generate_subscripts(string_split({column}, ''), 1) as pos from {table_name})
  ) where mark in ('○','●','◎','〇','△','▲','▽','▼','※','☆','◇','◆','。','、') and c is not null
) where place <= 2 group by {key}"""


STRICT_HITS = "list_sum(list_transform(list_distinct({0}), lambda x: least(len(list_filter({0}, lambda y: y = x)), len(list_filter({1}, lambda y: y = x)))))"
CIRCLED = "list_distinct(list_transform({0}, lambda p: p.ch))"


def strict_sql(a: str, b: str) -> str:
    hits = f"coalesce({STRICT_HITS.format(a, b)}, 0)::double"
    return f"(case when len({a}) = 0 and len({b}) = 0 then 1.0::double when len({a}) = 0 or len({b}) = 0 or {hits} = 0 then 0.0::double else 2 * ({hits} / len({b})) * ({hits} / len({a})) / ({hits} / len({b}) + {hits} / len({a})) end)"


THIRD_SQL = f"""
with {samples_sql(D.THIRD_TEXT)},
n as (select *, row_number() over () as rid, {MAIN.format(HALF.format("answer"))} as g, {MAIN.format(HALF.format("pred"))} as q from s where period = '三期'),
gp as ({pairs_sql("n", "rid", "answer")}),
pp as ({pairs_sql("n", "rid", "pred")}),
l as (select n.*, coalesce(gp.pairs, []) as ga, coalesce(pp.pairs, []) as pa,
      regexp_extract_all({HALF.format("answer")}, '(?s)<(.*?)>', 1) as gm, regexp_extract_all({HALF.format("pred")}, '(?s)<(.*?)>', 1) as pm,
      regexp_extract_all(answer, '(?s)【(.*?)】', 1) as gj, regexp_extract_all(pred, '(?s)【(.*?)】', 1) as pj
      from n left join gp using (rid) left join pp using (rid)),
m as (select model, success,
      case when success then case when greatest(length(g), length(q)) = 0 then 1.0::double else 1 - levenshtein(g, q)::double / greatest(length(g), length(q)) end end as ned,
      case when success then {strict_sql("ga", "pa")} end as cs, case when success then {set_f1_sql(CIRCLED.format("ga"), CIRCLED.format("pa"))} end as cl,
      case when success then {soft_f1_sql("gm", "pm", 0.3)} end as mf, case when success then {soft_f1_sql("gj", "pj", 0.5)} end as jf from l),
third_means as (select model as 模型, count_if(success)::bigint as 成功, count_if(not success)::bigint as 失败, {MEAN.format("ned")} as NED, {MEAN.format("cs")} as cs, {MEAN.format("cl")} as cl,
      {MEAN.format("mf")} as 眉批NER, {MEAN.format("jf")} as 夹注NER from m group by all having count_if(success) > 0),
third_scored as (
  select 模型, '三期-严格' as 期别, 成功, 失败, NED, cs as 圈点, 眉批NER, 夹注NER, (0.5::double * NED + 0.3::double * cs + 0.1::double * 眉批NER + 0.1::double * 夹注NER) * 100 as 分数 from third_means
  union all
  select 模型, '三期-宽松', 成功, 失败, NED, cl, 眉批NER, 夹注NER, (0.5::double * NED + 0.3::double * cl + 0.1::double * 眉批NER + 0.1::double * 夹注NER) * 100 from third_means)"""

@query("ned_leaderboard", FIRST_SQL + "\nselect *, row_number() over (partition by 期别 order by 分数 desc, 模型)::int as 名次 from first_scored")
def ned_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.ranked(E.summarize_first(E.first_phases(samples(spark, sf_dir, D.FIRST_TEXT))))


@query("phase3_scores", THIRD_SQL + "\nselect * from third_scored")
def phase3_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.summarize_third(E.third_phase(samples(spark, sf_dir, D.THIRD_TEXT)))


def _both(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of all phases, whose texts are marked as their phase has it, are scored in one pass."""
    raw = samples(spark, sf_dir, "text")
    marked = {c: F.when(F.col("period") == E.THIRD, F.expr(D.THIRD_TEXT.replace("text", c))).otherwise(F.expr(D.FIRST_TEXT.replace("text", c))) for c in ("answer", "pred")}
    return E.summary(raw.withColumns(marked))


FIRST_PART, THIRD_PART = f"first_part as ({FIRST_SQL} select * from first_scored)", f"third_part as ({THIRD_SQL} select * from third_scored)"
UNION = f"with {FIRST_PART}, {THIRD_PART}, every as (select * from first_part union all by name select * from third_part)"


@query("sparse_union", UNION + " select * from every")
def sparse_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir)


@query(
    "score_pivot",
    UNION
    + " select case when starts_with(模型, 'realphoto_') then '实拍' else '原始' end as 类别, 模型, "
    + ", ".join(f"coalesce(printf('%.2f', round(max(分数) filter (期别 = '{p}'), 2)), '--') as \"{p}\"" for p in E.PERIODS)
    + " from every group by all",
)
def score_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.score_pivot(_both(spark, sf_dir))


@query(
    "status_counts",
    f"with {samples_sql('text')} select model, period, count(*)::bigint as total, count_if(success)::bigint as success, count_if(not success)::bigint as failed from s group by all having count_if(success) > 0",
)
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = samples(spark, sf_dir, "text").groupBy("model", "period").agg(F.count("*").alias("total"), F.count_if("success").alias("success"), F.count_if(~F.col("success")).alias("failed"))
    return counted.filter("success > 0")


PATH = "concat(url, case when page_id % 3 = 0 then '/实拍图/a/二期/' else '/【三期】/' end, page_id, case when page_id % 5 = 0 then '.tar.gz' else '.png' end)"


@query(
    "period_and_sequence",
    f"""select page_id, coalesce(nullif(regexp_extract(p, '实拍图/[^/]+/([一二]期|三期)/', 1), ''), case when p like '%【一期】%' then '一期' when p like '%【二期】%' then '二期' when p like '%【三期】%' then '三期' end) as period,
    try_cast(nullif(regexp_extract(p, '/([0-9]+)\\.[^./]*$', 1), '') as bigint) as seq from (select page_id, {PATH} as p from pages)""",
)
def period_and_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr(PATH)
    return table(spark, sf_dir, "pages").select("page_id", T.detect_period(path).alias("period"), T.extract_sequence(path).alias("seq"))


MARKED = D.bracketed(D.ascii_image("text"))


@query("strip_markup", f"select doc_id, md5({STRIP.format(MARKED)}) as stripped, length({STRIP.format(MARKED)})::bigint as n from documents")
def strip_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = T.strip_markup(F.expr(MARKED))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(out).alias("stripped"), F.length(out).cast("long").alias("n"))


@query("strip_to_han", f"select doc_id, md5(regexp_replace({D.tagged('text')}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) as han from documents")
def strip_to_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.strip_to_han(F.expr(D.tagged("text")))).alias("han"))


TAGS = "replace(replace(replace(replace(replace(replace(lower(text), 'th', '【'), 'er', '】'), 'on', '<head>'), 'in', '</head>'), 'es', '<footnote>'), 'en', '</footnote>')"
FOUND = " || ".join(f"regexp_extract_all(x, '(?s){p}', 1)" for p in ("<footnote>(.*?)</footnote>", "<head>(.*?)</head>", "【(.*?)】"))


@query("entity_extract", f"with t as (select doc_id, {TAGS} as x from documents) select doc_id, len({FOUND})::bigint as n, md5(array_to_string({FOUND}, '|')) as entities from t")
def entity_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.entities(F.expr(TAGS))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, "|")).alias("entities"))


NEIGHBOURS = "select a.item_id, {0} as gt, {1} as pred from benchmark a join benchmark b on b.item_id = a.item_id + 1"


def neighbours(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Each passage beside the next."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.expr(text).alias("gt"))
    return b.join(b.select((F.col("item_id") - 1).alias("item_id"), F.col("gt").alias("pred")), "item_id")


def neighbours_sql(text: str) -> str:
    return NEIGHBOURS.format(text.replace("text", "a.text"), text.replace("text", "b.text"))


@query(
    "soft_ner_f1",
    f"with n as ({neighbours_sql(TAGS)}), l as (select item_id, {FOUND.replace('(x', '(gt')} as g, {FOUND.replace('(x', '(pred')} as p from n) select item_id, round({soft_f1_sql('g', 'p', 0.5)}, 6) as f1 from l",
)
def soft_ner_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, TAGS).select("item_id", F.round(M.ner_f1("gt", "pred"), 6).alias("f1"))


@query("entity_score", f"with n as ({neighbours_sql('text')}), s as (select item_id, {set_f1_sql(CHARS.format('gt'), CHARS.format('pred'))} as s from n) select item_id, round(case when s >= 0.9 then s else 0 end, 6)::double as score from s")
def entity_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, "text").select("item_id", F.round(M.entity_score(F.col("gt"), F.col("pred"), 0.9), 6).alias("score"))


@query("ned_pairs", f"with n as ({neighbours_sql(D.ascii_image('text'))}), t as (select item_id, {LINE.format(STRIP.format('gt'))} as g, {LINE.format(STRIP.format('pred'))} as q from n) select item_id, levenshtein(g, q)::int as edit_distance, greatest(length(g), length(q))::int as longest from t")
def ned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.with_ned(neighbours(spark, sf_dir, D.ascii_image("text")), "gt", "pred").select("item_id", "edit_distance", "longest")


#: Rows of the distance table one after another: a row is the least, over all columns before, of what
#: comes from above, plus the columns between.
WILDCARD = f"""with recursive n as ({neighbours_sql("text")}),
c as (select item_id, {LINE.format(STRIP.format("case when item_id % 2 = 0 then replace(gt, 'e', '#') else gt end"))} as g, {LINE.format(STRIP.format("pred"))} as q from n),
d as (select item_id, 0::bigint as i, unnest(range(0, length(q) + 1)) as j, unnest(range(0, length(q) + 1)) as v from c
  union all
  select item_id, i, j, j + min(t - j) over (partition by item_id order by j rows between unbounded preceding and current row) from (
    select item_id, i + 1 as i, j, case when j = 0 then i + 1 else least(v + 1, lag(v) over (partition by item_id order by j) + case when substr(g, i + 1, 1) = '#' or substr(g, i + 1, 1) = substr(q, j, 1) then 0 else 1 end) end as t
    from d join c using (item_id) where i < length(g)))
select item_id, v::int as edit_distance, greatest(length(g), length(q))::int as longest, round(1 - v::double / greatest(length(g), length(q)), 6) as ned from d join c using (item_id) where i = length(g) and j = length(q)"""


@query("wildcard_ned", WILDCARD)
def wildcard_ned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the passages have wildcards."""
    marked = neighbours(spark, sf_dir, "text").withColumn("gt", F.when(F.col("item_id") % 2 == 0, F.translate("gt", "e", "#")).otherwise(F.col("gt")))
    return M.with_ned(marked, "gt", "pred").select("item_id", "edit_distance", "longest", F.round("ned", 6).alias("ned"))


PAIR_TEXT = "md5(array_to_string(list_transform(pairs, lambda p: p.ch || p.mark), ''))"


@query("circle_pairs", f"with t as (select doc_id, {D.tagged('text')} as x from documents), c as ({pairs_sql('t', 'doc_id', 'x')}) select t.doc_id, coalesce(len(pairs), 0)::bigint as n, coalesce({PAIR_TEXT}, md5('')) as pairs from t left join c using (doc_id)")
def circle_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "documents").select("doc_id", T.circle_pairs(F.expr(D.tagged("text"))).alias("p"))
    return pairs.select("doc_id", F.size("p").cast("long").alias("n"), F.md5(F.array_join(F.transform("p", lambda x: F.concat(x["ch"], x["mark"])), "")).alias("pairs"))


@query("circle_pair_windows", f"with t as (select doc_id, {D.tagged('text')} as x from documents), c as ({pairs_sql('t', 'doc_id', 'x')}) select doc_id, p.ch as ch, p.mark as mark, count(*)::bigint as n from (select doc_id, unnest(pairs) as p from c) group by all")
def circle_pair_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = W.circle_pair_rows(spread(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("text", F.expr(D.tagged("text"))), ["doc_id"])
    return rows.groupBy("doc_id", "ch", "mark").agg(F.count("*").alias("n"))


@query(
    "circle_scores",
    f"""with n as ({neighbours_sql(D.tagged('text'))}), a as ({pairs_sql('n', 'item_id', 'gt')}), b as ({pairs_sql('n', 'item_id', 'pred')}),
    l as (select n.item_id, coalesce(a.pairs, []) as ga, coalesce(b.pairs, []) as pa from n left join a using (item_id) left join b using (item_id))
    select item_id, round({strict_sql('ga', 'pa')}, 6) as strict, round({set_f1_sql(CIRCLED.format('ga'), CIRCLED.format('pa'))}, 6) as lenient from l""",
)
def circle_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = neighbours(spark, sf_dir, D.tagged("text")).select("item_id", T.circle_pairs("gt").alias("g"), T.circle_pairs("pred").alias("p"))
    return pairs.select("item_id", F.round(M.circle_strict(F.col("g"), F.col("p")), 6).alias("strict"), F.round(M.circle_lenient(F.col("g"), F.col("p")), 6).alias("lenient"))


@query(
    "circle_overlap",
    f"""with n as ({neighbours_sql(D.tagged('text'))}), a as ({pairs_sql('n', 'item_id', 'gt')}), b as ({pairs_sql('n', 'item_id', 'pred')}),
    ac as (select item_id, x, count(*) as n from (select item_id, unnest(pairs) as x from a) group by all), bc as (select item_id, x, count(*) as n from (select item_id, unnest(pairs) as x from b) group by all)
    select item_id, sum(least(ac.n, bc.n))::bigint as overlap from ac join bc using (item_id, x) group by item_id""",
)
def circle_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = neighbours(spark, sf_dir, D.tagged("text"))
    sides = [W.circle_pair_rows(n.select("item_id", F.col(c).alias("text")), ["item_id"]) for c in ("gt", "pred")]
    return W.multiset_overlap(*sides, ["item_id"], ["ch", "mark"])
