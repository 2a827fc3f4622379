"""Every query over the driver tables and its DuckDB oracle, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.functions import vectors

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query function under name, with its oracle where SQL can express it."""

    def add(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    """The modules that register queries."""
    from quillgraph.plans import graph_queries, table_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


@query(
    "r3_semantic_topk",
    """SELECT e.vec_id, e.label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
       FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q
       WHERE e.embedding IS NOT NULL ORDER BY score DESC, vec_id LIMIT 100""",
)
def r3_semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    probe = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return (
        rows.join(F.broadcast(probe))
        .select("vec_id", "label", F.round(vectors.cosine("embedding", "q"), 6).alias("score"))
        .orderBy(F.desc("score"), "vec_id")
        .limit(100)
    )
