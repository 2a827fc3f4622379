"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quillgraph.llm import chatformat, decontaminate, langid, linededup, lmscore, mixing, ngramjoin, pii, tokencount, vectordedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op2(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op3(_table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op4(_table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectordedup.link_vectors(_table(spark, sf_dir, "embeddings"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(_table(spark, sf_dir, "documents"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.op7(_table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.op8(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.op9(_table(spark, sf_dir, "conversations"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op10(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_pii": op2_pii,
        "op3_language_id": op3_language_id,
        "op4_mix_sources": op4_mix_sources,
        "op5_vector_dedup": op5_vector_dedup,
        "op6_lm_score": op6_lm_score,
        "op7_ngram_join": op7_ngram_join,
        "op8_line_dedup": op8_line_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_decontaminate": op10_decontaminate,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_mix_sources": f"WITH {mixing.sql('documents')} SELECT doc_id, topic, n_tokens, round(prob, 6) AS prob, round(weight, 6) AS weight, sampled FROM mix_rows",
        "op8_line_dedup": f"""WITH RECURSIVE {linededup.SQL.format(docs="documents")}
            SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN clean END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
            FROM documents d LEFT JOIN line_kept k ON d.text = k.text""",
    }
