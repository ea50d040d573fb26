"""One query per operator over its whole table, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import chats, conversations, decontamination, exact, mixing, phrases, pii, quality, records, simhash, spelling, suffixes, warc

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_warc", warc.DIGESTS_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_digests(_table(spark, sf_dir, "pages"))


@_query("op2_decontamination", decontamination.LEAKS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op3_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"))


@_query("op4_token_records")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.token_records(_table(spark, sf_dir, "documents"))


@_query("op5_chat_templates")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.conversation_digests(chats.with_control_strings(_table(spark, sf_dir, "conversations")))


@_query("op6_repeated_phrases", phrases.REPEATS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digest(_table(spark, sf_dir, "documents"))


@_query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(_table(spark, sf_dir, "documents"))


@_query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).select("doc_id", "quality.*")


@_query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op10_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op11_spelling", spelling.VARIANTS_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.digest(_table(spark, sf_dir, "documents"))


@_query("op12_prefix_trie", conversations.NODES_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(_table(spark, sf_dir, "conversations"))


@_query("op13_exact_dedup", exact.GROUPS_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.digest(_table(spark, sf_dir, "documents"))
