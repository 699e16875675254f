"""The driver's queries over the corpus operators, whole tables each, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import baselines, conversations, decontaminate, htmltext, lmscore, mixing, pii, runs, secrets, tokenids, topk, toxicity, warc
from quire.llm.shared import table
from quire.llm.simhash import simhash_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str | None] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name], ORACLES[name] = f, sql
        return f

    return add


@query("op8_simhash_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op7_source_mixing", mixing.MIX_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


@query("op1_topk_search", topk.TOPK_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op5_secrets")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


@query("op10_warc", warc.WARC_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op3_html_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


@query("op6_lm_score")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(table(spark, sf_dir, "documents"))


@query("op11_token_ids")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenids.round_trip(table(spark, sf_dir, "documents"))


@query("op12_conversation_repair", conversations.CONVERSATION_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.describe(table(spark, sf_dir, "conversations"))


@query("op13_periodic_runs", runs.RUNS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.describe(table(spark, sf_dir, "documents"))


# What the contract fixes of three of them, which SQL can express.


@query("base_secrets", baselines.SECRETS_SQL)
def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5(spark, sf_dir).drop("spans")


@query("base_personal_data", baselines.PII_SQL)
def base_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")


@query("base_word_scores", baselines.WORDS_SQL)
def base_word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", 4))
