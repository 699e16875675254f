"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

A source of n documents and target weight w, of a mixture with T documents, has the mean
repetition rate w * T / n. Each document's number of copies is the inverse of that Poisson
distribution at a uniform number hashed from the seed and the document's id, so it depends on
nothing else and any executor can compute it again. Copies are dealt to partitions and sorted
inside them by a hash of their own: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import cut

#: Rates above this are split into equal parts, whose independent counts add up; exp(-rate) stays far from zero.
PART = 500.0
#: Sources up to which their rates are broadcast; beyond it they are joined, salted.
BROADCAST_SOURCES = 10_000
SALT = 64


def _uniform(*parts: Column) -> Column:
    """52 bits of a hash as an integer."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: float | None) -> DataFrame:
    """(mix_source, rate, parts, cdf): the distribution of each source's number of copies, per part."""
    sizes = docs.groupBy(F.coalesce("source", F.lit("")).alias("mix_source")).agg(F.count("*").alias("n"))
    if weights is None:
        weighted = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(float(temperature))))
    else:
        given = docs.sparkSession.createDataFrame(sorted(weights.items()), "mix_source string, w double")
        weighted = sizes.join(given, "mix_source", "left").fillna(0.0, ["w"])
    sums = weighted.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()
    wanted = float(total) if total else float(sums.n or 0)
    rated = weighted.select("mix_source", (F.col("w") / F.lit(float(sums.w or 1.0)) * F.lit(wanted) / F.col("n")).alias("rate"))
    parted = rated.fillna(0.0, ["rate"]).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int")).withColumn("part_rate", F.col("rate") / F.col("parts"))
    steps = F.sequence(F.lit(1), F.ceil(F.col("part_rate") + 12 * F.sqrt("part_rate") + 30).cast("int"))
    start = F.struct(F.exp(-F.col("part_rate")).alias("p"), F.array(F.exp(-F.col("part_rate"))).alias("cdf"))
    cdf = F.aggregate(
        steps,
        start,
        lambda acc, k: F.struct((acc["p"] * F.col("part_rate") / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * F.col("part_rate") / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return parted.select("mix_source", "rate", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.7, total: float | None = None, seed: int = 7) -> DataFrame:
    """docs replicated to the target weights, with copy (from 1) and shuffle_key, in shuffled order.

    weights are relative targets by source (a source without one is left out); without weights a
    source's target is its number of documents to the power ``temperature``. total is the expected
    size of the mixture, by default that of docs. A null source counts as the empty one, a null
    doc_id hashes as the empty text, repeated rows are replicated alike, empty and very long texts
    are like any others, and an empty table gives an empty result. Columns pass through whatever
    their names, but for those that are added: copy and shuffle_key, in any case, are refused.
    """
    clash = {c for c in docs.columns if c.lower() in ("copy", "shuffle_key")}
    if clash:
        raise ValueError(f"columns that this operator adds are there already: {sorted(clash)}")
    rates = cut(source_rates(docs, weights, temperature, total))
    quoted = {n: "`" + n.replace("`", "``") + "`" for n in docs.columns}
    source = F.coalesce("source", F.lit(""))
    # the input goes along as one column, so that no name of it can clash. Rows of one id, and those of none,
    # share a key, which may be hot; so copies are dealt out by the row's place as well
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALT))
    packed = docs.select(F.struct(*quoted.values()).alias("row"), source.alias("mix_source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("identity"), spread.alias("spread"))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = packed.join(F.broadcast(rates), "mix_source")
    else:
        salted = rates.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = packed.withColumn("mix_salt", F.pmod(F.xxhash64("identity"), F.lit(SALT)).cast("int")).join(salted, ["mix_source", "mix_salt"])
    identity = F.col("identity")
    drawn = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda part: F.size(F.filter(F.col("cdf"), lambda c: c <= _uniform(F.lit(str(seed)), identity, part.cast("string")) / F.lit(float(1 << 52)))),
    )
    copies = F.aggregate(drawn, F.lit(0), lambda a, b: a + b)
    replicated = joined.select("row", "identity", "spread", copies.alias("copies")).filter("copies > 0").select("row", "identity", "spread", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    keyed = replicated.select("row", "copy", "spread", _uniform(F.lit(str(seed)), F.lit("order"), identity, F.col("copy").cast("string")).alias("shuffle_key"))
    dealt = keyed.repartition("shuffle_key", "spread")
    return dealt.sortWithinPartitions("shuffle_key", "copy").select(*(F.col(f"row.{q}").alias(n) for n, q in quoted.items()), "copy", "shuffle_key")


MIX_SQL = """
with d as (select *, coalesce(source, '') as mix_source, coalesce(doc_id::varchar, '') as ident from documents),
s as (select mix_source, count(*) as n from d group by mix_source),
w as (select mix_source, n, pow(n::double, 0.7) as w from s),
r as (select mix_source, w / (select sum(w) from w) * (select sum(n) from w)::double / n as rate from w),
p as (select mix_source, greatest(1, ceil(rate / 500.0))::int as parts, rate / greatest(1, ceil(rate / 500.0)) as lam from r),
k as (select mix_source, parts, lam, unnest(range(0, ceil(lam + 12 * sqrt(lam) + 30)::bigint + 1)) as k from p),
c as (select mix_source, sum(exp(-lam + k * ln(lam) - lgamma(k + 1.0))) over (partition by mix_source order by k) as cdf from k),
u as (select d.*, i.part, ('0x' || substr(md5('7:' || ident || ':' || i.part), 1, 13))::bigint / 4503599627370496.0 as u
      from d join p using (mix_source), lateral (select unnest(range(0, p.parts)) as part) i),
n as (select u.doc_id, u.ident, u.text, u.lang, u.source, u.n_chars, count(*) as copies from u join c on c.mix_source = u.mix_source and c.cdf <= u.u group by all),
e as (select *, unnest(range(1, copies + 1))::int as copy from n)
select doc_id, text, lang, source, n_chars, copy, ('0x' || substr(md5('7:order:' || ident || ':' || copy), 1, 13))::bigint as shuffle_key from e
"""
