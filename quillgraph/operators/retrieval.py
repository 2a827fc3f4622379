"""Retrieval channels, their merge, and the ranking stages, each a DataFrame to DataFrame step.

A search is one lazy plan: every channel prunes to its key and score and keeps its own top rows, the merge is one grouped
pivot over the union of channels, and wide rows are joined only for the survivors.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars, text, vectors

# Fixed values of the ranking stages.
CHANNEL_LIMIT = 100
TRIGRAM_FLOOR = 0.2
FLOORS = {"doc_semantic": 0.3, "symbol_semantic": 0.3, "doc_keyword_shaped": 0.05, "symbol_keyword_shaped": 0.05, "trigram": TRIGRAM_FLOOR}
RERANK_FLOOR = 0.5
SYMBOL_MARGIN = 2.0
SPARSITY_PENALTY = 3.0
EXACT_MIN_SCORE = 0.0
USAGE_KEYWORD_WEIGHT, USAGE_SEMANTIC_WEIGHT, USAGE_FLOOR = 0.4, 0.6, 0.2
ID_LENGTH = 15
# Fixed values of the deterministic scorer.
SCORER = {"start": -1.25, "token": 0.65, "contained": 1.4, "scoped": 0.4, "no_overlap": -0.35}


def top(rows: DataFrame, key: str, limit: int = CHANNEL_LIMIT, score: str = "score") -> DataFrame:
    return rows.orderBy(F.desc(score), key).limit(limit)


def keyword_channel(postings: DataFrame, key: str, terms: list[str], limit: int = CHANNEL_LIMIT) -> DataFrame:
    """Rows with every term; the score adds the terms' weights.

    The sum is a decimal's, so equal weights give equal scores in whatever order they come and ties stay ties.
    """
    terms = sorted(set(terms))
    total = F.sum(F.col("weight").cast("decimal(28,18)")).cast("double")
    hit = postings.where(F.col("lexeme").isin(*terms)).groupBy(key).agg(total.alias("score"), F.count("*").alias("n"))
    return top(hit.where(F.col("n") == len(terms)).select(key, "score"), key, limit)


def semantic_channel(rows: DataFrame, key: str, vector: str, query: list[float], limit: int = CHANNEL_LIMIT) -> DataFrame:
    """Exact cosine with the query vector; null and zero vectors drop out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.where(F.col(vector).isNotNull()).select(key, vectors.cosine(F.col(vector), q).alias("score"))
    return top(scored.where(F.col("score").isNotNull()), key, limit)


def trigram_channel(rows: DataFrame, key: str, column: str, query: str, floor: float = TRIGRAM_FLOOR, limit: int = CHANNEL_LIMIT) -> DataFrame:
    """Trigram similarity with the query from the floor on."""
    s = text.trigram_similarity(text.trigrams(F.col(column)), text.trigrams(F.lit(query)))
    return top(rows.where(F.col(column).isNotNull()).select(key, s.alias("score")).where(F.col("score") >= floor), key, limit)


def exact_channel(entities: DataFrame, query: str) -> DataFrame:
    """Name or signature equal to the query, or a qualified name holding its scope and name."""
    scope, _, bare = query.rpartition("::")
    hit = (F.col("name") == query) | (F.col("signature") == query)
    if scope.strip() and bare.strip():
        hit = hit | scalars.like_contains(F.col("qualified_name"), F.lit(f"{scope.strip()}::{bare.strip()}"))
    return entities.where(hit).select("entity_id", F.lit(1.0).alias("score"))


def merge_channels(channels: dict[str, DataFrame], key: str) -> DataFrame:
    """One row per key with every channel's score, 0 where it is absent."""
    rows = reduce(DataFrame.unionByName, [c.select(key, F.lit(n).alias("signal"), "score") for n, c in channels.items()])
    return rows.groupBy(key).agg(*[F.coalesce(F.max(F.when(F.col("signal") == n, F.col("score"))), F.lit(0.0)).alias(n) for n in channels])


def floor_filter(merged: DataFrame, floors: dict[str, float] = FLOORS, exact: str = "exact") -> DataFrame:
    """Keeps exact matches and rows with any signal at its floor."""
    ok = F.col(exact) > 0 if exact in merged.columns else F.lit(False)
    for c, v in floors.items():
        if c in merged.columns:
            ok = ok | (F.col(c) >= v)
    return merged.where(ok)


def deterministic_score(query: Column, doc: Column) -> Column:
    """Token overlap scorer, the default behind the reranking interface."""
    q, d = text.tokens(query, False), text.tokens(doc, False)
    both = F.size(F.array_intersect(q, d))
    inside = F.contains(F.lower(doc), F.lower(query)) & (F.trim(query) != "")
    score = F.lit(SCORER["start"]) + SCORER["token"] * both
    score = score + F.when(inside, SCORER["contained"]).otherwise(0.0)
    score = score + F.when(inside & F.contains(query, F.lit("::")), SCORER["scoped"]).otherwise(0.0)
    return score + F.when(both == 0, SCORER["no_overlap"]).otherwise(0.0)


def arbitrate(rows: DataFrame, symbol_query: Column) -> DataFrame:
    """Adds winning_view, winning_score and losing_score from ce_doc, ce_symbol and brief."""
    sparse = (F.col("ce_doc") > F.col("ce_symbol")) & scalars.blank_to_null(F.col("brief")).isNull()
    out = rows.withColumn("_doc", F.when(sparse, F.col("ce_doc") - SPARSITY_PENALTY).otherwise(F.col("ce_doc")))
    doc_wins = F.when(symbol_query, F.col("_doc") > F.col("ce_symbol") + SYMBOL_MARGIN).otherwise(F.col("_doc") >= F.col("ce_symbol"))
    return (
        out.withColumn("winning_view", F.when(doc_wins, "doc").otherwise("symbol"))
        .withColumn("winning_score", F.when(doc_wins, F.col("_doc")).otherwise(F.col("ce_symbol")))
        .withColumn("losing_score", F.when(doc_wins, F.col("ce_symbol")).otherwise(F.col("_doc")))
        .drop("_doc")
    )


def rerank_floor(rows: DataFrame, signals: list[str]) -> DataFrame:
    """Drops rows that are not exact, score under the floor and have no corroborating signal."""
    best = F.greatest(*[F.col(s) for s in signals]) if len(signals) > 1 else F.col(signals[0])
    return rows.where((F.col("exact") > 0) | (F.col("winning_score") >= RERANK_FLOOR) | (best > 0))


def final_order(rows: DataFrame, symbol_query: Column, key: str, limit: int) -> DataFrame:
    """Exact matches of symbol-like queries first, then winning and losing score, then the key."""
    tier = F.when(symbol_query & (F.col("exact") > 0) & (F.col("winning_score") >= EXACT_MIN_SCORE), 1).otherwise(0)
    return rows.withColumn("tier", tier).orderBy(F.desc("tier"), F.desc("winning_score"), F.desc("losing_score"), key).limit(limit)


def hybrid_search(
    entities: DataFrame,
    query: str,
    doc_query_vector: list[float] | None = None,
    symbol_query_vector: list[float] | None = None,
    kind: str | None = None,
    capability: str | None = None,
    limit: int = 20,
    doc_ceiling: float = 1.0,
    symbol_ceiling: float = 1.0,
    scorer=deterministic_score,
) -> DataFrame:
    """The full pipeline over entities (R15, R17); a blank query gives no rows."""
    pool = entities
    if kind:
        pool = pool.where(F.col("kind") == kind)
    if capability:
        pool = pool.where(F.col("capability") == capability)
    scope, _, bare = query.rpartition("::")
    scoped = bool(scope.strip() and bare.strip())
    words = bare.strip() if scoped else query.strip()
    terms = sorted(set(re.findall("[a-z0-9_]+", words.lower())))
    if not query.strip():
        pool, terms = pool.limit(0), ["-"]
    prose = pool.select(
        "entity_id", "name", F.concat_ws(" ", "brief", "details").alias("body"),
        F.concat_ws(" ", "notes", "rationale", "returns", F.array_join(F.map_values("params"), " ")).alias("rest"),
    )
    symbols = pool.select("entity_id", "name", F.concat_ws(" ", "qualified_name", "signature").alias("body"), F.col("definition_text").alias("rest"))
    weights = {"name": 1.0, "body": 0.4, "rest": 0.2}
    channels = {
        "exact": exact_channel(pool, words if not scoped else query),
        "doc_keyword": keyword_channel(text.postings(prose, "entity_id", weights), "entity_id", terms or ["-"]),
        "symbol_keyword": keyword_channel(text.postings(symbols, "entity_id", weights), "entity_id", terms or ["-"]),
        "trigram": trigram_channel(pool, "entity_id", "symbol_searchable", words.lower()),
    }
    if doc_query_vector is not None:
        channels["doc_semantic"] = semantic_channel(pool, "entity_id", "doc_embedding", doc_query_vector)
    if symbol_query_vector is not None:
        channels["symbol_semantic"] = semantic_channel(pool, "entity_id", "symbol_embedding", symbol_query_vector)
    merged = merge_channels(channels, "entity_id")
    merged = merged.withColumn("doc_keyword_shaped", scalars.shape_rank(F.col("doc_keyword"), doc_ceiling)).withColumn(
        "symbol_keyword_shaped", scalars.shape_rank(F.col("symbol_keyword"), symbol_ceiling)
    )
    rows = floor_filter(merged).join(pool, "entity_id")
    q_tokens = text.tokens(F.lit(words))
    symbol_tokens = text.tokens(F.concat_ws(" ", "name", "signature"))
    doc_tokens = text.tokens(
        F.concat_ws(" ", "brief", "details", "notes", "rationale", "returns", F.array_join(F.map_values("params"), " "), "name", "signature")
    )
    rows = rows.withColumn("token_jaccard", text.token_jaccard(q_tokens, symbol_tokens)).withColumn("query_coverage", text.query_coverage(q_tokens, doc_tokens))
    if scoped:
        flagged = F.contains(F.lower("qualified_name"), F.lit(f"{scope.strip()}::{bare.strip()}".lower()))
        rows = rows.withColumn("exact", F.when(F.coalesce(flagged, F.lit(False)), 1.0).otherwise(F.col("exact")))
    doc_text = scalars.doc_embed_text(F.col("brief"), F.col("details"), F.col("params"), F.col("returns"), F.col("notes"), F.col("rationale"), F.col("name"))
    symbol_text = scalars.symbol_embed_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("signature"))
    rows = rows.withColumn("ce_doc", scorer(F.lit(query), doc_text)).withColumn("ce_symbol", scorer(F.lit(query), symbol_text))
    symbol_like = scalars.is_symbol_like(F.lit(query))
    rows = rerank_floor(arbitrate(rows, symbol_like), ["doc_keyword_shaped", "symbol_keyword_shaped", "trigram", "token_jaccard", "query_coverage"])
    return final_order(rows, symbol_like, "entity_id", limit).select(
        "entity_id", "name", "kind", "capability", "winning_view", F.col("winning_score").alias("score"), "losing_score", "tier"
    )


def usage_scores(keyword: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """0.4 keyword score normalised by its largest, plus 0.6 cosine, over rows with either."""
    best = keyword.agg(F.max("score").alias("best"))
    kw = keyword.join(F.broadcast(best)).select(*keys, (F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(F.col("score"))).alias("kw"))
    return kw.join(semantic.withColumnRenamed("score", "sem"), keys, "full_outer").select(
        *keys, (F.coalesce("kw", F.lit(0.0)) * USAGE_KEYWORD_WEIGHT + F.coalesce("sem", F.lit(0.0)) * USAGE_SEMANTIC_WEIGHT).alias("score")
    )


def best_usages(scored: DataFrame, callee: str, keys: list[str], limit: int, evidence: int = 3) -> DataFrame:
    """The best callees and their top usages; limited before callee filters are applied (AG23, R16)."""
    w = Window.partitionBy(callee).orderBy(F.desc("score"), *keys)
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= evidence)
    callees = top(scored.groupBy(callee).agg(F.max("score").alias("callee_score")), callee, limit, "callee_score")
    return ranked.join(callees, callee).where(F.col("callee_score") >= USAGE_FLOOR)


def resolve(entities: DataFrame, query: str, postings: DataFrame | None = None, limit: int = 20, vector: str | None = None, embedded: list[float] | None = None) -> DataFrame:
    """The first stage that finds anything: id, signature, name, prefix, keyword, and with a vector column and the embedded query semantic."""
    base = entities.select("entity_id", "name", "signature", "fan_in")
    stages = [("name", F.col("name") == query), ("signature", F.col("signature") == query)]
    found = [base.where(cond).select("entity_id", "name", F.lit(n).alias("match_type"), F.lit(k).alias("stage"), F.lit(0.0).alias("o1"), F.lit(0).cast("long").alias("o2")) for k, (n, cond) in ((2, stages[0]), (1, stages[1]))]
    if ":" in query and len(query) <= ID_LENGTH:
        found.append(base.where(F.col("entity_id") == query).select("entity_id", "name", F.lit("entity_id").alias("match_type"), F.lit(0).alias("stage"), F.lit(0.0).alias("o1"), F.lit(0).cast("long").alias("o2")))
    found.append(
        base.where(scalars.like_prefix(F.col("name"), F.lit(query))).select(
            "entity_id", "name", F.lit("prefix").alias("match_type"), F.lit(3).alias("stage"), F.length("name").cast("double").alias("o1"), (-F.col("fan_in")).cast("long").alias("o2")
        )
    )
    if postings is not None:
        hits = keyword_channel(postings, "entity_id", re.findall("[a-z0-9_]+", query.lower()) or ["-"], limit)
        found.append(hits.join(base, "entity_id").select("entity_id", "name", F.lit("keyword").alias("match_type"), F.lit(4).alias("stage"), (-F.col("score")).alias("o1"), F.lit(0).cast("long").alias("o2")))
    if vector and embedded:
        near = semantic_channel(entities, "entity_id", vector, embedded, limit)
        found.append(near.join(base, "entity_id").select("entity_id", "name", F.lit("semantic").alias("match_type"), F.lit(5).alias("stage"), (-F.col("score")).alias("o1"), F.lit(0).cast("long").alias("o2")))
    every = reduce(DataFrame.unionByName, found)
    first = every.agg(F.min("stage").alias("stage"))
    rows = every.join(F.broadcast(first), "stage", "left_semi").orderBy("o1", "o2", "entity_id").limit(limit)
    return rows.withColumn("n", F.count("*").over(Window.partitionBy("stage"))).select(
        "entity_id", "name", "match_type", F.when((F.col("n") == 1) & ~F.col("match_type").isin("keyword", "semantic"), "exact").otherwise("ambiguous").alias("status")
    )
