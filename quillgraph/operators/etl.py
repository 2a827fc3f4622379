"""Joins, deduplication, metrics and enrichment of the build, as DataFrame to DataFrame steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars


def fetch_in_order(rows: DataFrame, ids: list, key: str) -> DataFrame:
    """The listed rows in the order of the list, missing ones skipped."""
    spark = rows.sparkSession
    wanted = spark.createDataFrame([(x, i) for i, x in enumerate(ids)], f"{key} {dict(rows.dtypes)[key]}, ord int")
    return rows.join(F.broadcast(wanted), key).orderBy("ord")  # the caller's list


def top_callers(usages: DataFrame, entities: DataFrame, limit: int = 5) -> DataFrame:
    """Usages with the largest fan_in of their caller's signature, 0 where unknown, best first."""
    best = entities.groupBy(F.col("signature").alias("caller_sig")).agg(F.max("fan_in").alias("caller_fan_in"))
    joined = usages.join(best, "caller_sig", "left").withColumn("caller_fan_in", F.coalesce("caller_fan_in", F.lit(0)))
    return joined.orderBy(F.desc("caller_fan_in"), "callee_id", "caller_compound", "caller_sig").limit(limit)


def attach_documents(entities: DataFrame, documents: DataFrame) -> DataFrame:
    """Left join on (compound, signature); else the first documented one of that compound and name."""
    exact = documents.select("compound", "signature", F.struct("name", "brief", "details").alias("doc"))
    w = Window.partitionBy("compound", "name").orderBy("signature")
    by_name = (
        documents.where(scalars.blank_to_null(F.col("brief")).isNotNull())
        .withColumn("r", F.row_number().over(w)).where("r = 1")
        .select("compound", "name", F.struct("name", "brief", "details").alias("other"))
    )
    return (
        entities.join(exact, ["compound", "signature"], "left").join(by_name, ["compound", "name"], "left")
        .withColumn("doc", F.coalesce("doc", "other")).drop("other")
    )


def dedupe_declarations(fragments: DataFrame, group: str, order: str, has_body: str, doc: str) -> DataFrame:
    """One row per group: the first fragment with a body, its document or else a sibling's; a group without one raises."""
    w = Window.partitionBy(group)
    ranked = fragments.select(
        "*",
        F.row_number().over(w.orderBy(F.desc(has_body), order)).alias("_rank"),
        F.first(doc, ignorenulls=True).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_sibling"),
    )
    first = ranked.where("_rank = 1").withColumn(doc, F.coalesce(doc, "_sibling")).drop("_rank", "_sibling")
    checked = F.when(F.col(has_body), F.col(group)).otherwise(F.raise_error(F.concat(F.lit("no definition: "), F.col(group).cast("string"))))
    return first.withColumn(group, checked)


def rewrite_edges(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges between entity ids as a set, edges with an unresolved end); ids: node, entity_id."""
    a = ids.select(F.col("node").alias("src"), F.col("entity_id").alias("source_id"))
    b = ids.select(F.col("node").alias("dst"), F.col("entity_id").alias("target_id"))
    both = edges.join(a, "src", "left").join(b, "dst", "left")
    found = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    kept = both.where(found).select("source_id", "target_id", F.lower("relationship").alias("relationship")).distinct()
    return kept, both.where(~found).select("src", "dst", "relationship")


def assign_by_name(entities: DataFrame, assignments: DataFrame) -> DataFrame:
    """capability by name, the last assignment of a name wins; assignments: name, capability, ord."""
    last = assignments.groupBy("name").agg(F.max_by("capability", "ord").alias("capability"))
    return entities.drop("capability").join(last, "name", "left")


def body_entity(nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """The entity of a node's body: a non-extern singleton, else one on the body's file and line, else the first in a .cc file.

    candidates: node, entity, extern, on_body, path.
    """
    n = Window.partitionBy("node")
    rank = F.when(~F.col("extern") & (F.count_if(~F.col("extern")).over(n) == 1), 0).when(F.col("on_body"), 1).when(F.endswith("path", F.lit(".cc")), 2).otherwise(3)
    best = candidates.withColumn("rank", rank).withColumn("r", F.row_number().over(n.orderBy("rank", "entity"))).where("r = 1 and rank < 3")
    return nodes.join(best.select("node", "entity", "rank"), "node", "left")


def signature_map(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full union of document keys and entity keys: preserved, rekeyed (same compound and name, other signature) or dropped."""
    w = Window.partitionBy("compound", "signature").orderBy(F.desc("has_body"), "entity_id")
    best = new.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
    same = old.select("compound", "signature", F.col("name").alias("old_name")).join(best, ["compound", "signature"], "full_outer")
    named = best.groupBy("compound", "name").agg(F.min("signature").alias("new_signature"))
    out = same.join(named.withColumnRenamed("name", "old_name"), ["compound", "old_name"], "left")
    return out.select(
        "compound", "signature", "entity_id",
        F.when(F.col("old_name").isNull(), "new").when(F.col("entity_id").isNotNull(), "preserved").when(F.col("new_signature").isNotNull(), "rekeyed").otherwise("dropped").alias("change"),
        F.when(F.col("entity_id").isNull(), F.col("new_signature")).alias("new_signature"),
    )


def mirror_missing(forward: DataFrame, backward: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(forward edges without a reverse, reverse edges without a forward); both src, dst."""
    turned = backward.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return forward.join(turned, ["src", "dst"], "left_anti"), turned.join(forward, ["src", "dst"], "left_anti")


def explode_usages(entities: DataFrame, key: str = "entity_id", usages: str = "usages") -> DataFrame:
    """callee_id, caller_compound, caller_sig, description; a key splits at its first `, ` (AG5)."""
    rows = entities.where(F.col(usages).isNotNull()).select(F.col(key).alias("callee_id"), F.explode(usages).alias("k", "description"))
    parts = F.split("k", ", ", 2)
    return rows.select("callee_id", parts[0].alias("caller_compound"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("caller_sig"), "description")


def statistics(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """section, name, n: totals and counts by kind and edge type (AG3, AG15, SRC14)."""
    total = entities.select(F.lit("total").alias("section"), F.lit("entities").alias("name"))
    kinds = entities.select(F.lit("kind").alias("section"), F.col("kind").alias("name"))
    types = edges.select(F.lit("edge").alias("section"), F.col("relationship").alias("name"))
    return total.unionByName(kinds).unionByName(types).groupBy("section", "name").agg(F.count("*").alias("n"))


def rank_ceiling(scores: DataFrame, column: str = "score", floor: float = 0.01, default: float = 1.0) -> DataFrame:
    """The interpolated 99th percentile, at least the floor, the default without scores (AG4)."""
    return scores.agg(F.greatest(F.coalesce(F.expr(f"percentile({column}, 0.99)"), F.lit(default)), F.lit(floor)).alias("ceiling"))


def check_unique(rows: DataFrame, key: str) -> DataFrame:
    """rows, failing when a key occurs twice (FN2)."""
    n = rows.groupBy(key).agg(F.count("*").alias("_n"))
    return rows.join(n, key).withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.concat(F.lit("duplicate id: "), F.col(key))))).drop("_n")


def sync_plan(wanted: DataFrame, cached: DataFrame, key: str = "key") -> DataFrame:
    """key, action: embed what the cache lacks, prune what is stale, keep the rest (EM2)."""
    w, c = wanted.select(key).distinct().withColumn("w", F.lit(1)), cached.select(key).distinct().withColumn("c", F.lit(1))
    return w.join(c, key, "full_outer").select(
        key, F.when(F.col("c").isNull(), "embed").when(F.col("w").isNull(), "prune").otherwise("keep").alias("action")
    )


def sync_cache(wanted: DataFrame, cached: DataFrame, embed, key: str = "key") -> DataFrame:
    """The cache after a sync: kept vectors and new ones of embed(rows without a vector), which maps key, text to key, vector."""
    kept = cached.join(wanted.select(key).distinct(), key, "left_semi")
    missing = wanted.join(cached.select(key).distinct(), key, "left_anti")
    return kept.select(key, "vector").unionByName(embed(missing).select(key, "vector"))


def dangling_usages(usages: DataFrame, valid: DataFrame) -> DataFrame:
    """Usages whose (compound, signature) is no entity's (NB8)."""
    return usages.join(valid.select(F.col("compound").alias("caller_compound"), F.col("signature").alias("caller_sig")), ["caller_compound", "caller_sig"], "left_anti")


def judge_usages(usages: DataFrame, verdicts: DataFrame, floor: float = 0.5) -> DataFrame:
    """Keeps usages from the floor on, and all of a callee whose usages would all go; a missing verdict raises (NB9)."""
    keys = ["callee_id", "caller_compound", "caller_sig"]
    scored = usages.join(verdicts.select(*keys, "verdict_score"), keys, "left").withColumn(
        "verdict_score", F.coalesce("verdict_score", F.raise_error(F.concat(F.lit("no verdict: "), F.col("callee_id"))).cast("double"))
    )
    some = F.count_if(F.col("verdict_score") >= floor).over(Window.partitionBy("callee_id"))
    return scored.withColumn("_some", some).where((F.col("verdict_score") >= floor) | (F.col("_some") == 0)).drop("_some")


def field_commonality(fields: DataFrame, buckets: list[str], path: str = "path") -> DataFrame:
    """path, n_buckets, scope: `all` for a path in every bucket, `some`, or `unique` for one bucket (NB2)."""
    b = F.struct(*buckets)
    total = fields.select(b.alias("b")).distinct().count()
    n = fields.groupBy(path).agg(F.countDistinct(b).alias("n_buckets"))
    return n.withColumn("scope", F.when(F.col("n_buckets") == total, "all").when(F.col("n_buckets") == 1, "unique").otherwise("some"))
