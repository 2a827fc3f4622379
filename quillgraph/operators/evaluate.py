"""Evaluation of rankings against expected ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import vectors
from quillgraph.operators import graph


def score_blocks(rows: DataFrame, queries: DataFrame, vector: str = "embedding", block: int = 1024) -> DataFrame:
    """rows with query columns (query, category) and score, every row against every query (EV3, EV5).

    queries: query, q, category. They are dealt into blocks of about `block` by a hash of their id, and each block's side of
    the join is broadcast: at most some thousand vectors, however many queries there are.
    """
    n = -(-queries.count() // block) or 1
    parts = []
    for k in range(n):
        mine = F.broadcast(queries.where(F.pmod(F.xxhash64("query"), F.lit(n)) == k))
        parts.append(rows.join(mine).select(*[c for c in rows.columns if c != vector], "query", "category", vectors.cosine(vector, "q").alias("score")))
    return reduce(DataFrame.unionByName, parts)


def rank_results(results: DataFrame, query: str = "query", key: str = "id", score: str = "score") -> DataFrame:
    """results with rank by score, ties by key (EV3)."""
    return results.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), key)))


def first_hits(ranked: DataFrame, expected: DataFrame, query: str = "query", key: str = "id") -> DataFrame:
    """query, first_rank, reciprocal_rank, recall_10, recall_20; 0 without a hit (EV1)."""
    n = expected.groupBy(query).agg(F.count("*").alias("n"))
    hits = ranked.join(expected.select(query, key), [query, key], "left_semi").groupBy(query).agg(
        F.min("rank").alias("first_rank"), F.count_if(F.col("rank") <= 10).alias("h10"), F.count_if(F.col("rank") <= 20).alias("h20")
    )
    return n.join(hits, query, "left").select(
        query, "first_rank", F.coalesce(1 / F.col("first_rank"), F.lit(0.0)).alias("reciprocal_rank"),
        (F.coalesce("h10", F.lit(0)) / F.col("n")).alias("recall_10"), (F.coalesce("h20", F.lit(0)) / F.col("n")).alias("recall_20"),
    )


def candidate_pool(views: list[DataFrame], query: str = "query", key: str = "id", top: int = 50) -> DataFrame:
    """query, id, ord: each view's top rows, once each, in the order of the views (EV2); views have rank."""
    rows = None
    for k, v in enumerate(views):
        one = v.where(F.col("rank") <= top).select(query, key, (F.lit(k * top) + F.col("rank")).alias("ord"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(query, key).agg(F.min("ord").alias("ord"))


def rerank(pool: DataFrame, query: str = "query", key: str = "id") -> DataFrame:
    """pool with winning and losing score, and the rank before and after (EV3); pool: ord, doc_score, symbol_score."""
    w = Window.partitionBy(query)
    return (
        pool.withColumn("winning", F.greatest("doc_score", "symbol_score")).withColumn("losing", F.least("doc_score", "symbol_score"))
        .withColumn("rank_before", F.row_number().over(w.orderBy("ord", key)))
        .withColumn("rank_after", F.row_number().over(w.orderBy(F.desc("winning"), F.desc("losing"), key)))
    )


def report(per_query: DataFrame, category: str = "category") -> DataFrame:
    """category, n, mrr, recall_10, recall_20, with a row `all` (EV4)."""
    every = per_query.unionByName(per_query.withColumn(category, F.lit("all")))
    return every.groupBy(category).agg(F.count("*").alias("n"), F.avg("reciprocal_rank").alias("mrr"), F.avg("recall_10").alias("recall_10"), F.avg("recall_20").alias("recall_20"))


def channel_candidates(channels: list[tuple[str, DataFrame]], view: str, per_channel: int = 20) -> DataFrame:
    """query, id, view, channel, score, ord: each channel's best rows, an id under the first channel that has it (EV5).

    channels: (name, rows of query, id, score), in their order of precedence.
    """
    w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    parts = [
        rows.select("query", "id", F.round("score", 4).alias("score")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= per_channel)
        .select("query", "id", F.struct(F.lit(k).alias("k"), F.col("r"), F.lit(name).alias("channel"), F.col("score")).alias("c"))
        for k, (name, rows) in enumerate(channels)
    ]
    first = reduce(DataFrame.unionByName, parts).groupBy("query", "id").agg(F.min("c").alias("c"))
    order = Window.partitionBy("query").orderBy("c.k", "c.r")
    return first.select("query", "id", F.lit(view).alias("view"), "c.channel", "c.score", F.row_number().over(order).alias("ord"))


def graph_candidates(edges: DataFrame, found: DataFrame, known: DataFrame, seeds: int) -> DataFrame:
    """query, id, seed, relation: neighbours of a query's first `seeds` candidates, without the seeds (EV5, GR28).

    found: query, id, ord over all views. A neighbour stands once for a query, under its first seed.
    """
    w = Window.partitionBy("query").orderBy("ord", "id")
    top = found.groupBy("query", "id").agg(F.min("ord").alias("ord")).withColumn("r", F.row_number().over(w)).where(F.col("r") <= seeds)
    near = graph.seed_neighbours(edges, top.select(F.col("id").alias("seed")), known)
    rows = top.select("query", F.col("id").alias("seed"), "r").join(near, "seed")
    rows = rows.join(top.select("query", F.col("id").alias("node")), ["query", "node"], "left_anti")
    return rows.groupBy("query", F.col("node").alias("id")).agg(F.min(F.struct("r", "seed", "relation")).alias("x")).select("query", "id", "x.seed", "x.relation")


def expected_ids(defined: DataFrame, stored: DataFrame) -> DataFrame:
    """The defined queries with the stored expected ids, an empty list where none are stored (EV5); stored: query, expected_ids."""
    return defined.join(stored.select("query", "expected_ids"), "query", "left").withColumn("expected_ids", F.coalesce("expected_ids", F.array().cast("array<string>")))
