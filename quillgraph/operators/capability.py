"""Capability analytics: classification, dependencies, tiers, comparison, waves and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from quillgraph.functions import vectors
from quillgraph.functions.wordlists import CAPABILITY_TYPES, EDGE_TYPE_BY_TARGET
from quillgraph.operators import cones
from quillgraph.session import materialize

# Fixed values.
SIMILARITY_FLOOR, EDGE_FLOOR, UNIVERSAL_FAN_IN, SHARED_FAN_IN, LARGE_CHUNK = 0.40, 3, 10, 3, 60
NONE = "uncategorized"


def classify(rows: DataFrame, groups: DataFrame, key: str, vector: str = "vector", floor: float = SIMILARITY_FLOOR, locked: DataFrame | None = None) -> DataFrame:
    """key, grp, similarity: the locked group, else the most similar one from the floor on, ties to the first name (R21, J11, NB5).

    groups: grp, centre; a list of group descriptions whose number the caller keeps small (checked here).
    """
    n = groups.limit(10_001).count()
    if n > 10_000:
        raise ValueError("classification compares with at most 10,000 groups")
    scored = rows.join(F.broadcast(groups)).select(key, "grp", vectors.cosine(F.col(vector), F.col("centre")).alias("similarity"))
    top = scored.groupBy(key).agg(F.max("similarity").alias("similarity"))
    name = scored.join(top.withColumnRenamed("similarity", "top"), key).where("similarity = top").groupBy(key).agg(F.min("grp").alias("grp"), F.max("similarity").alias("similarity"))
    out = rows.select(key).join(name, key, "left").select(
        key, F.when(F.col("similarity") >= floor, F.col("grp")).otherwise(NONE).alias("grp"), "similarity"
    )
    if locked is not None:
        out = out.join(locked.select(key, F.col("grp").alias("fixed")), key, "left").select(key, F.coalesce("fixed", "grp").alias("grp"), "similarity")
    return out


def probe(rows: DataFrame, wanted: list[float], avoid: list[float], floor: float, avoid_floor: float, key: str, vector: str = "vector", locked: DataFrame | None = None) -> DataFrame:
    """Rows near the wanted text and not nearer to the avoided one, without locked ones."""
    array = lambda v: F.array(*[F.lit(float(x)) for x in v])
    out = rows.select("*", vectors.cosine(F.col(vector), array(wanted)).alias("sim"), vectors.cosine(F.col(vector), array(avoid)).alias("avoid_sim"))
    if locked is not None:
        out = out.join(locked.select(key), key, "left_anti")
    return out.where((F.col("sim") >= floor) & ~((F.col("avoid_sim") > F.col("sim")) | (F.col("avoid_sim") >= avoid_floor)))


def probe_diagnostic(members: DataFrame, groups: DataFrame, vector: str = "vector") -> DataFrame:
    """grp, n, mean, least, most similarity of locked members to their own description, worst first."""
    s = members.join(groups, "grp").select("grp", vectors.cosine(F.col(vector), F.col("centre")).alias("s"))
    return s.groupBy("grp").agg(F.count("*").alias("n"), F.avg("s").alias("mean"), F.min("s").alias("least"), F.max("s").alias("most")).orderBy("mean", "grp")


def edge_type(source_type: Column, target_type: Column) -> Column:
    """By the target's type if both types are known, else `requires`."""
    by_target = F.create_map(*[F.lit(x) for kv in EDGE_TYPE_BY_TARGET.items() for x in kv])[target_type]
    return F.when(source_type.isin(*CAPABILITY_TYPES), F.coalesce(by_target, F.lit("requires"))).otherwise("requires")


def capability_edges(calls: DataFrame, member: DataFrame, types: DataFrame | None = None, floor: int = EDGE_FLOOR) -> DataFrame:
    """source_cap, target_cap, call_count, edge_type over calls between groups, from the floor on (AG6).

    member: node, capability; types: capability, type (a missing type counts as domain).
    """
    m = member.where((F.col("capability") != NONE) & F.col("capability").isNotNull())
    pairs = calls.join(m.toDF("src", "source_cap"), "src").join(m.toDF("dst", "target_cap"), "dst").where("source_cap <> target_cap")
    out = pairs.groupBy("source_cap", "target_cap").agg(F.count("*").alias("call_count")).where(F.col("call_count") >= floor)
    if types is None:
        return out.withColumn("edge_type", F.lit("requires_core"))
    a, b = types.toDF("source_cap", "st"), types.toDF("target_cap", "tt")
    return out.join(a, "source_cap", "left").join(b, "target_cap", "left").select(
        "source_cap", "target_cap", "call_count", edge_type(F.coalesce("st", F.lit("domain")), F.coalesce("tt", F.lit("domain"))).alias("edge_type")
    )


def entry_point_capabilities(reached: DataFrame, member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entry point with its sorted capabilities, capability with the number of entry points that use it) (AG7)."""
    pairs = reached.join(member, "node").where("capability is not null").select("seed", "capability").distinct()
    by_entry = pairs.groupBy("seed").agg(F.array_join(F.array_sort(F.collect_set("capability")), ",").alias("capabilities"))
    return by_entry, pairs.groupBy("capability").agg(F.count("*").alias("entry_points"))


def _numbered(edges: DataFrame, entry_points: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(src, dst), (node) and (node, id): nodes as longs, which they may be already (then no third)."""
    edges, entry_points = edges.select("src", "dst"), entry_points.select("node")
    if edges.schema["src"].dataType == LongType():
        return edges, entry_points, None
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst")).union(entry_points).where("node is not null").distinct()
    # Neighbouring names get neighbouring numbers: cones of neighbours often share nodes.
    names = materialize(every.orderBy(F.length("node"), "node").select("node", F.monotonically_increasing_id().alias("id")), "names")
    ends = edges.join(names.toDF("src", "a"), "src").join(names.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return ends, entry_points.join(names, "node").select(F.col("id").alias("node")), names


def exercise_counts(edges: DataFrame, entry_points: DataFrame, member: DataFrame, max_depth: int = 5) -> DataFrame:
    """seed, capability, direct, transitive counts over every entry point's cone (AG9, NB4)."""
    ends, seeds, names = _numbered(edges.where("relationship = 'calls'"), entry_points)
    member = member.select("node", "capability").where("capability is not null")
    if names is not None:
        member = member.join(names, "node").select(F.col("id").alias("node"), "capability")
    known = materialize(member.select("capability").distinct().select("capability", F.monotonically_increasing_id().alias("member")), "capabilities", shrink=16)
    counts = cones.count_members(ends, seeds, member.join(known, "capability").select("node", "member"), max_depth)
    found = counts.join(known, "member").select("seed", "capability", "direct", "transitive")
    return found if names is None else found.join(names.toDF("name", "seed"), "seed").select(F.col("name").alias("seed"), "capability", "direct", "transitive")


def depth_distribution(calls: DataFrame, entry_points: DataFrame, max_depth: int = 5) -> DataFrame:
    """depth, pairs of entry point and node, distinct nodes over all cones (NB4)."""
    ends, seeds, _ = _numbered(calls, entry_points)
    return cones.count_depths(ends, seeds, max_depth)


def compare(calls: DataFrame, member: DataFrame, wanted: list[str], limit: int = 50) -> DataFrame:
    """section, node, capabilities: callees shared by two or more of the capabilities, unique to one, and bridges (AG10)."""
    mine = member.where(F.col("capability").isin(*wanted))
    called = calls.join(mine.toDF("src", "from_cap"), "src").select("dst", "from_cap").distinct()
    sets = called.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("from_cap")).alias("caps"))
    shared = sets.where(F.size("caps") >= 2).select(F.lit("shared").alias("section"), "node", F.array_join("caps", ",").alias("capabilities"))
    unique = sets.where(F.size("caps") == 1).select(F.lit("unique").alias("section"), "node", F.array_join("caps", ",").alias("capabilities"))
    bridge = (
        called.withColumnRenamed("dst", "node").join(mine, "node").where("from_cap <> capability")
        .groupBy("node", "capability").agg(F.array_join(F.array_sort(F.collect_set("from_cap")), ",").alias("from_caps"))
        .select(F.lit("bridge").alias("section"), "node", F.concat_ws(">", "from_caps", "capability").alias("capabilities"))
    )
    rows = reduce(DataFrame.unionByName, [shared, unique, bridge])
    w = Window.partitionBy("section").orderBy("node", "capabilities")
    return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")


def fan_in(edges: DataFrame, names: DataFrame) -> DataFrame:
    """capability, dag_fan_in, all_fan_in, fan_out of (source_cap, target_cap, in_dag) (AG11)."""
    into = edges.groupBy(F.col("target_cap").alias("capability")).agg(F.count_if("in_dag").alias("dag_fan_in"), F.count("*").alias("all_fan_in"))
    out = edges.groupBy(F.col("source_cap").alias("capability")).agg(F.count("*").alias("fan_out"))
    cols = ("dag_fan_in", "all_fan_in", "fan_out")
    return names.join(into, "capability", "left").join(out, "capability", "left").select(*names.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])


def tier(kind: Column, dag_fan_in: Column) -> Column:
    """0 utility, 1 universal, 2 shared, 4 leaf, 3 the rest (AG12)."""
    return F.when(kind == "utility", 0).when(dag_fan_in >= UNIVERSAL_FAN_IN, 1).when(dag_fan_in >= SHARED_FAN_IN, 2).when(dag_fan_in == 0, 4).otherwise(3)


TIER_NAMES = ["utility_foundation", "foundation", "shared", "domain", "leaf"]


def bundling(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Policy and projection groups with one or two domain consumers in the DAG (AG13)."""
    support = types.where(F.col("type").isin("policy", "projection")).toDF("target_cap", "support_type")
    domain = types.where("type = 'domain'").select(F.col("capability").alias("source_cap"))
    users = edges.where("in_dag").join(support, "target_cap").join(domain, "source_cap").groupBy("target_cap", "support_type").agg(F.array_sort(F.collect_set("source_cap")).alias("c"))
    return users.where(F.size("c").between(1, 2)).select(F.col("target_cap").alias("support_group"), "support_type", F.array_join("c", ",").alias("domain_consumers"))


def chunk_warnings(chunks: DataFrame, edges: DataFrame, waves: DataFrame) -> DataFrame:
    """type, chunk: chunks in a cycle, over-large ones, orphans outside the utility tier (AG14); edges: src, dst."""
    cycle = waves.where("wave < 0").select(F.lit("cycle").alias("type"), F.col("node").alias("chunk"))
    large = chunks.where(F.col("member_count") > LARGE_CHUNK).select(F.lit("large_chunk").alias("type"), "chunk")
    ends = edges.select(F.col("src").alias("chunk")).union(edges.select("dst"))
    orphan = chunks.where("tier_name <> 'utility_foundation'").join(ends, "chunk", "left_anti").select(F.lit("orphan").alias("type"), "chunk")
    return reduce(DataFrame.unionByName, [cycle, large, orphan])


def chunk_edges(edges: DataFrame, chunk_of: DataFrame) -> DataFrame:
    """src, dst, call_count, edge_types between chunks over DAG edges (J13); chunk_of: capability, chunk."""
    a, b = chunk_of.toDF("source_cap", "src"), chunk_of.toDF("target_cap", "dst")
    return (
        edges.where("in_dag").join(a, "source_cap").join(b, "target_cap").where("src <> dst")
        .groupBy("src", "dst").agg(F.sum("call_count").alias("call_count"), F.array_join(F.array_sort(F.collect_set("edge_type")), ",").alias("edge_types"))
    )


def enablement(required: DataFrame, waves: DataFrame) -> DataFrame:
    """entry, wave: the largest wave it needs; none needed: the first; one missing: past the last (GR23).

    required: entry, capability (null or uncategorized rows ask for nothing); waves: capability, wave.
    """
    ends = waves.agg(F.min("wave").alias("first"), F.max("wave").alias("last"))
    need = required.where(F.col("capability").isNotNull() & (F.col("capability") != NONE)).join(waves, "capability", "left")
    top = need.groupBy("entry").agg(F.max("wave").alias("wave"), F.count_if(F.col("wave").isNull()).alias("missing"))
    return required.select("entry").distinct().join(top, "entry", "left").join(F.broadcast(ends)).select(
        "entry", F.when(F.col("missing") > 0, F.col("last") + 1).otherwise(F.coalesce("wave", "first")).alias("wave")
    )


def enabling_chunk(required: DataFrame, chunk_of: DataFrame, waves: DataFrame) -> DataFrame:
    """entry, chunk: of the chunks it needs the one implemented last, ties to the first name (GR25)."""
    rows = required.join(chunk_of, "capability").join(waves, "chunk").select("entry", "chunk", "wave").distinct()
    w = Window.partitionBy("entry").orderBy(F.desc("wave"), "chunk")
    return rows.withColumn("r", F.row_number().over(w)).where("r = 1").select("entry", "chunk", "wave")


def registry(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks with a reviewer's decision (mode required; phase and notes may be missing)."""
    return chunks.join(decisions.where("mode is not null"), "chunk").select(
        *chunks.columns, "mode", F.coalesce("phase", F.lit("unscheduled")).alias("phase"), F.coalesce("notes", F.lit("")).alias("notes")
    )


def entry_points(entities: DataFrame) -> DataFrame:
    """Entry points by short name with their prefix (NB3)."""
    from quillgraph.functions.scalars import entry_point_name, entry_type, is_entry_point

    return entities.where(is_entry_point(F.col("kind"), F.col("name"))).select(
        "entity_id", entry_point_name(F.col("signature")).alias("short_name"), entry_type(F.col("name")).alias("entry_type")
    ).orderBy("short_name", "entity_id")
