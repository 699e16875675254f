"""Queries of the quality scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rewards as R
from quire.functions import text as T
from quire.operators import windows as W
from quire.plans import derived as D
from quire.plans.registry import query, table

KEY = ["conv_id", "turn"]
BRACKETS = "translate({0}, '＜＞', '<>')".format(D.bracketed("lower(text)"))
#: Fewer brackets, so that a good part is balanced.
FEW = "replace(replace(replace(replace(lower(text), 'tha', '【'), 'the', '】'), 'and', '<'), 'are', '>')"

STACK = """list_reduce(list_transform(string_split({0}, ''), lambda z: z), lambda stack, z: case when stack = '!' then stack when z in ('【', '<') then stack || z
 when (z = '】' and right(stack, 1) = '【') or (z = '>' and right(stack, 1) = '<') then left(stack, length(stack) - 1) when z = '' then stack else '!' end, '')"""
SYMBOLS = "regexp_replace(regexp_replace({0}, '[^【】<>]', '', 'g'), '[【<]+$', '')"
FORMAT = "case when {0} = '' then 1.0::double else 0.0::double end".format(STACK.format(SYMBOLS.format(FEW)))


@query("format_reward", f"select conv_id, turn, {FORMAT} as reward from conversations")
def format_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*KEY, R.format_reward(F.expr(FEW)).alias("reward"))


LINES = """list_filter(list_transform(string_split(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10)), lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> '')"""
LINE_ROWS = f"l as (select doc_id, unnest({LINES}) as line, generate_subscripts({LINES}, 1) as pos from documents)"
RUNS = f"""with {LINE_ROWS},
c as (select *, case when line = lag(line) over (partition by doc_id order by pos) then 0 else 1 end as changed from l),
i as (select *, sum(changed) over (partition by doc_id order by pos) as island from c),
r as (select doc_id, island, line, count(*) as n from i group by all),
f as (select doc_id, line, sum(n) as times, max(n) as run from r group by all)
select doc_id, max(run)::bigint as longest_run, sum(times)::bigint as n_lines, max(times)::bigint as most_frequent from f group by doc_id"""


@query("line_runs", RUNS)
def line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(R.lines_of("text")).alias("pos", "line"))
    return W.line_runs(lines, ["doc_id"])


@query("line_frequency", f"with r as ({RUNS}) select doc_id, longest_run::int as longest_run, most_frequent::int as most_frequent from r")
def line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The folds in place of the windows, without a shuffle."""
    lines = table(spark, sf_dir, "documents").select("doc_id", R.lines_of("text").alias("lines")).filter(F.size("lines") > 0)
    return lines.select("doc_id", R.longest_line_run(F.col("lines")).alias("longest_run"), R.most_frequent_line(F.col("lines")).alias("most_frequent"))


@query(
    "char_runs",
    """with c as (select doc_id, unnest(string_split(t, '')) as ch, generate_subscripts(string_split(t, ''), 1) as pos from (select doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as t from documents)),
    m as (select *, case when ch = lag(ch) over (partition by doc_id order by pos) then 0 else 1 end as changed from c), i as (select *, sum(changed) over (partition by doc_id order by pos) as island from m),
    r as (select doc_id, island, ch, count(*) as n from i group by all) select doc_id, bool_or(n >= 5 and ch <> chr(10)) as repeated from r group by doc_id""",
)
def char_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.repetition_parts("text")["char"].alias("repeated"))


#: Text with brackets, and with repeated tags and words now and then.
ECHOED = "concat({0}, case doc_id % 6 when 0 then repeat('【甲】', 3) when 1 then repeat('<ab>', 2) when 2 then repeat('xyz', 4) when 3 then '。。、；：' when 4 then repeat('<1234567>', 3) else '' end)".format(BRACKETS)
_SPACES = "(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(12288))"
_LAGS = ", ".join(f"ch = lag(ch, {n}) over w and ch not in {_SPACES} as s{n}" for n in range(2, 13))
_SUMS = " or ".join(f"coalesce(sum(s{n}::int) over (partition by rid order by pos rows between {3 * n - 1} preceding and current row) = {3 * n}, false)" for n in range(2, 13))


def repetition_sql(keys: str, text: str, source: str) -> str:
    """keys, each kind of repetition, and the severity. A phrase of n characters four times over is a
    run of 3 n characters each equal to the one n before."""
    lines = "list_filter(list_transform(string_split(replace(replace(t, '\\n', chr(10)), '\\f', chr(10)), chr(10)), lambda z: regexp_replace(z, '^\\s+|\\s+$', '', 'g')), lambda z: z <> '')"
    return f"""
with t as (select {keys}, row_number() over () as rid, regexp_replace({text}, '^\\s+|\\s+$', '', 'g') as t from {source}),
chs as (select rid, unnest(string_split(t, '')) as ch, generate_subscripts(string_split(t, ''), 1) as pos from t),
same as (select *, ch = lag(ch) over (partition by rid order by pos) as s from chs),
runs as (select rid, bool_or(coalesce(r = 4, false) and ch <> chr(10)) as found from (select rid, ch, sum(s::int) over (partition by rid order by pos rows between 3 preceding and current row) as r from same) group by rid),
tails as (select c.rid, substr(t.t, c.pos::bigint) as s from chs c join t using (rid) where c.ch in ('【', '<')),
tags as (select rid, bool_or(l between 3 and 10 and starts_with(s, repeat(left(s, l), 3))) as found from (select rid, s, instr(s, case when left(s, 1) = '【' then '】' else '>' end)::bigint as l from tails) group by rid),
bare as (select rid, unnest(string_split(translate(t, '【】<>', ''), '')) as ch, generate_subscripts(string_split(translate(t, '【】<>', ''), ''), 1) as pos from t),
lags as (select rid, pos, {_LAGS} from bare window w as (partition by rid order by pos)),
phrases as (select rid, bool_or(f) as found from (select rid, {_SUMS} as f from lags) group by rid),
ls as (select rid, unnest({lines}) as line, generate_subscripts({lines}, 1) as pos from t),
lr as (select rid, line, pos - row_number() over (partition by rid, line order by pos) as island from ls),
lc as (select rid, line, sum(n) as times, max(n) as run from (select rid, line, island, count(*) as n from lr group by all) group by all),
lm as (select rid, max(run) >= 3 as line_run, sum(times) >= 6 and max(times) >= 5 and max(times)::double / sum(times) >= 0.35 as line_share from lc group by rid),
parts as (select t.*, coalesce(tags.found, false) as tag, coalesce(runs.found, false) as char, regexp_matches(t, '[○●□■△▲◎〇。、，；：！？…—～]{{5,}}') as flood, coalesce(phrases.found, false) as phrase, coalesce(line_run, false) as line_run, coalesce(line_share, false) as line_share
  from t left join tags using (rid) left join runs using (rid) left join phrases using (rid) left join lm using (rid)),
scored as (select * exclude (rid, t), least(tag::int * 0.6::double + char::int * 0.25::double + flood::int * 0.2::double + phrase::int * 0.6::double + line_run::int * 0.8::double + line_share::int * 0.8::double, 1.0::double) as severity from parts)"""


@query("repetition_parts", repetition_sql("doc_id", ECHOED, "documents") + " select * replace (round(severity, 6) as severity) from scored")
def repetition_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds at once, and their severity."""
    found = table(spark, sf_dir, "documents").select("doc_id", R.repetitions(F.expr(ECHOED)).alias("found")).select("doc_id", "found.*")
    return found.withColumn("severity", F.round("severity", 6))


PROBS = "transform(embedding, x -> least(abs(cast(x as double)) / 4, 1d))"
PROBS_SQL = "list_transform(embedding, lambda x: least(abs(x::double) / 4, 1))"
MODEL = f"greatest(0.05::double, 1 - 4.0::double * (len(list_filter({PROBS_SQL}, lambda p: p >= 0.6))::double / len(embedding)) - 1.5::double * list_reduce({PROBS_SQL}, lambda a, p: a + p, 0.0::double) / len(embedding))"


#: Completions of up to eight Han characters behind a prompt.
SAID = "concat('  OCR: ', repeat('字', cast(vec_id % 9 as int)), ' abc。')"


@query("model_reward", f"select vec_id, round(case when vec_id % 9 < 5 then 0.2::double else {MODEL} end, 6) as reward from embeddings")
def model_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("completion", F.expr(SAID))
    return rows.select("vec_id", F.round(R.model_reward("completion", F.expr(PROBS), 0.6), 6).alias("reward"))


HAN_COUNT = f"length(regexp_replace({D.han('text')}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g'))"
GATE = "case when {0} < 5 then 0.2::double when {0} < 60 then 0.2::double + 0.8::double * ({0} - 5) / 55 else 1.0::double end"


@query("length_gate", f"select conv_id, turn, {HAN_COUNT}::int as han, round({GATE.format(HAN_COUNT)}, 6) as gate from conversations")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "conversations").withColumn("han", F.length(T.strip_to_han(F.expr(D.han("text")))))
    return counted.select(*KEY, "han", F.round(R.length_gate(F.col("han")), 6).alias("gate"))


COMBINED = repetition_sql("conv_id, turn, text", "text", "conversations") + f""",
v as (select vec_id, {MODEL} as model from embeddings),
c as (select conv_id, turn, case when {HAN_COUNT} < 5 then 0.2::double else model end as model, {FORMAT} as form, severity as rep, {GATE.format(HAN_COUNT)} as gate from scored join v on vec_id = conv_id)
select conv_id, turn, round(greatest(0, least(1, (0.7::double * (model * (1 - 0.3::double * rep)) + 0.3::double * form - 0.35::double * rep) * gate)), 6)::double as reward from c"""


@query("combined_reward", COMBINED)
def combined_reward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts from the completion itself; classifier probabilities come from the embedding with the conversation's number."""
    probabilities = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("conv_id"), F.expr(PROBS).alias("probs"))
    rows = table(spark, sf_dir, "conversations").join(probabilities, "conv_id")
    han = F.expr(D.han("text"))
    model = R.model_reward(han, F.col("probs"), 0.6)
    return rows.select(*KEY, F.round(R.combined_reward(model, R.format_reward(F.expr(FEW)), R.repetition("text"), R.length_gate(F.length(T.strip_to_han(han)))), 6).alias("reward"))


@query("completion_han", f"select conv_id, turn, md5(regexp_replace({D.han('text')}, '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')) as han from conversations")
def completion_han(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Han characters of completions that begin with a prompt."""
    return table(spark, sf_dir, "conversations").select(*KEY, F.md5(T.han_of_completion(F.concat(F.lit(" OCR:\n "), F.expr(D.han("text"))))).alias("han"))


RAW = "case when turn % 3 = 0 then to_json(named_struct('content', text)) when turn % 3 = 1 then to_json(array(named_struct('content', array(named_struct('type', 'text', 'text', text))))) else to_json(array(text)) end"


@query("completion_text", "select conv_id, turn, md5(text) as text from conversations")
def completion_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completions of three shapes, each turned back into its text."""
    raw = table(spark, sf_dir, "conversations").withColumn("raw", F.parse_json(F.expr(RAW)))
    return raw.select(*KEY, F.md5(T.completion_text(F.col("raw"))).alias("text"))


HTML = "replace(replace(replace(replace(html, '<p>', '<footnote>'), '</p>', '</footnote>'), '<h1>', '<head>'), '</h1>', '</head>')"
READABLE = "replace(replace({0}, '\\n', chr(10)), '\\f', chr(10))".format(HTML)
READABLE = f"regexp_replace(regexp_replace({READABLE}, '(?s)<footnote>(.*?)</footnote>', '【\\1】', 'g'), '(?s)<head>(.*?)</head>', '<\\1>', 'g')"
for _tag, _symbol in (("<footnote>", "【"), ("</footnote>", "】"), ("<head>", "<"), ("</head>", ">")):
    READABLE = f"replace({READABLE}, '{_tag}', '{_symbol}')"
READABLE = f"rtrim(regexp_replace({READABLE}, '\\n{{3,}}', chr(10) || chr(10), 'g'), chr(10))"


@query("post_process", f"select page_id, md5({READABLE}) as text from pages")
def post_process(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.readable_tags(F.expr(HTML))).alias("text"))
