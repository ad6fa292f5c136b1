"""Registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import sql
from staylens.llm.shared import table


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.chat import digest
    return digest(table(spark, sf_dir, "conversations"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.tokencount import digest
    return digest(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.packing import digest
    return digest(table(spark, sf_dir, "documents"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.tokenfiles import digest
    return digest(table(spark, sf_dir, "documents"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.jaccard import digest
    return digest(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.pii import digest
    return digest(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.decontaminate import digest
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.hnsw import digest
    return digest(table(spark, sf_dir, "embeddings"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.warc import digest
    return digest(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.toxicity import digest
    return digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.collocations import digest
    return digest(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.fim import digest
    return digest(table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from staylens.llm.repeats import digest
    return digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: fn for name, fn in sorted(globals().items()) if name.startswith("op") and callable(fn)
}

SQL: dict[str, str] = {
    "op1_chat_formatting": sql.CHAT,
    "op5_ngram_jaccard": sql.JACCARD,
    "op7_decontaminate": sql.DECONTAMINATE,
    "op8_embedding_near_dedup": sql.NEAR_VECTORS,
    "op9_warc": sql.WARC,
    "op11_collocations": sql.COLLOCATIONS,
    "op12_fill_in_middle": sql.FIM,
    "op13_substring_dedup": sql.REPEATS,
}
