"""The registered queries of this subpackage, and the SQL that checks those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire.llm import bytepairs, common, importance, languages, linetemplates, merkle, paritysketch, phraseindex, repeats, sanitise, secretscan, tokenfiles, toxicity, urlrules

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op6_byte_pairs")
def byte_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return bytepairs.digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query("op5_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    return tokenfiles.written_and_read(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op1_toxicity")
def toxic_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    held_out = common.remainder("doc_id", 5) == 0
    rows = toxicity.scored(docs, toxicity.train(docs, labels, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query("op10_languages")
def language_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = common.remainder("doc_id", 4) == 2
    rows = languages.predicted(docs, languages.train(docs, ~held_out))
    return rows.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op2_merkle", merkle.FINGERPRINTS_SQL)
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.compared(table(spark, folder, "documents"))


@query("op4_secrets", secretscan.digest_sql())
def secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secretscan.digest(table(spark, folder, "documents"))


@query("op9_decontamination", phraseindex.CONTAMINATION_SQL)
def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return phraseindex.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("n_near")


@query("op3_parity_join")
def near_groups(spark: SparkSession, folder: str) -> DataFrame:
    return paritysketch.grouped(table(spark, folder, "documents"))


@query("op7_line_templates")
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = linetemplates.deduplicated(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "text", "dropped_lines", "dropped_sentences")


@query("op8_personal_data")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return sanitise.digest(table(spark, folder, "documents"))


@query("op11_importance", importance.RESAMPLING_SQL)
def importance_draw(spark: SparkSession, folder: str) -> DataFrame:
    return importance.drawn(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op12_url_rules", urlrules.JUDGED_SQL)
def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return urlrules.judged(pages, urlrules.page_labels(pages, table(spark, folder, "labels")), urlrules.rule_table(pages, urlrules.RULES))


@query("op13_word_runs", repeats.RUNS_SQL)
def word_runs(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.digests(table(spark, folder, "documents"))
