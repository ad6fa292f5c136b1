"""A corpus pipeline of five operators: toxicity, near duplicates, benchmark
decontamination, personal data, packing.

Every stage works on all documents that the one before kept, and its result
is written as Parquet and read again, so a lost executor repeats one stage at
most. Null and empty texts pass the filters; rows that are kept keep all
their columns; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm.decontaminate import decontaminate
from staylens.llm.jaccard import keep_one
from staylens.llm.packing import digest as pack
from staylens.llm.pii import mask_pii
from staylens.llm.shared import col, free_name, table, written
from staylens.llm.toxicity import fit_documents, score


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5; the model learns from the
    labels of these documents that are not held out."""
    scored, name = score(docs, fit_documents(docs, table(spark, sf_dir, "labels")))
    return scored.where(col(name) < 0.5).select(*map(col, docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each group linked by n-gram overlap."""
    return keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of a benchmark item."""
    found, name = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(col(name)["n_hit"] == 0).select(*map(col, docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text."""
    if "n_chars" not in docs.columns:
        return mask_pii(docs)
    before = free_name(docs, "before")
    masked = mask_pii(docs.withColumn(before, F.length("text")))
    n_chars = F.when(F.length("text") == col(before), col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return masked.withColumn("n_chars", F.when(col(before).isNull(), col("n_chars")).otherwise(n_chars)).select(*map(col, docs.columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Classifier, tokenizer and components are not SQL; tests/llm/test_pipeline.py
#: checks the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
