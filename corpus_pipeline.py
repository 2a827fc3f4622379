"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Language ID drops texts without a learned language, line dedup takes recurring lines out of the texts, the n-gram join
keeps one document of each group of near-duplicates, decontamination drops documents with benchmark passages, and
mixing draws the sample with its weights.

Defined results: a null, empty or letterless text goes at the first stage; a null id is a document like any other, never a
near-duplicate and drawn as the empty id; rows that repeat an id and a text become one row at the n-gram join; ties between
near-duplicates go to the smallest id; texts of any length are read whole; empty tables give no rows and the same columns;
further columns pass through untouched, whatever their names, and the last stage appends n_tokens and weight after them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import decontaminate, langid, linededup, mixing, ngramjoin
from quillgraph.session import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.without_recurring_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngramjoin.keep_representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sample(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("decontamination", decontamination),
    ("mixing_sources", mixing_sources),
]

#: A trained classifier decides the first stage, which SQL cannot express; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
