"""Graph queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import graph
from quillgraph.plans.registry import query
from quillgraph.plans.views import CALLS_SQL, EDGES_SQL, NODES_SQL, calls, edges, nodes


def _bfs_sql(seed: str, depth: int, a: str, b: str) -> str:
    return f"""WITH RECURSIVE {CALLS_SQL}, walk AS (
      SELECT '{seed}' AS node, 0 AS depth UNION SELECT calls.{b}, depth + 1 FROM walk JOIN calls ON calls.{a} = walk.node WHERE depth < {depth}),
    least AS (SELECT node, min(depth) AS depth FROM walk GROUP BY node)"""


@query("gr1_call_cone", f"""{_bfs_sql("c:1", 3, "src", "dst")},
  ranked AS (SELECT node, depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS part,
    row_number() OVER (PARTITION BY depth = 1 ORDER BY depth, node) AS rank FROM least WHERE depth > 0)
  SELECT node, depth, part, (SELECT count(*) >= 200 FROM least WHERE depth > 1) AS truncated FROM ranked WHERE part = 'direct' OR rank <= 200""")
def gr1(spark, sf):
    return graph.call_cone(edges(spark, sf), "c:1", 3, 200)


@query("gr2_callers", f"""{_bfs_sql("s:1", 2, "dst", "src")},
  ranked AS (SELECT node, depth, row_number() OVER (PARTITION BY depth ORDER BY node) AS rank, count(*) OVER (PARTITION BY depth) AS level_size FROM least WHERE depth > 0)
  SELECT node, depth, level_size, level_size >= 50 AS truncated FROM ranked WHERE rank <= 50""")
def gr2(spark, sf):
    return graph.neighbours_by_depth(edges(spark, sf), "s:1", 2, 50, reverse=True)


@query("gr3_callees", f"""{_bfs_sql("c:1", 3, "src", "dst")}
  SELECT node, depth, count(*) OVER (PARTITION BY depth) AS level_size, false AS truncated FROM least WHERE depth > 0""")
def gr3(spark, sf):
    return graph.neighbours_by_depth(edges(spark, sf), "c:1", 3)


@query("gr4_hierarchy", """SELECT DISTINCT 'derived' AS direction, 'p:' || p_partkey AS node FROM part WHERE p_type = (SELECT min(p_type) FROM part)""")
def gr4(spark, sf):
    first = spark.read.parquet(f"{sf}/part.parquet").agg(F.min("p_type")).first()[0]
    return graph.class_hierarchy(edges(spark, sf), f"t:{first}")


@query("gr6_dependencies", f"""WITH {EDGES_SQL} SELECT node, relationship, direction FROM (
  SELECT DISTINCT dst AS node, relationship, 'outgoing' AS direction FROM edges WHERE src = 'p:1'
  UNION SELECT DISTINCT src, relationship, 'incoming' FROM edges WHERE dst = 'p:1')
  ORDER BY direction DESC, relationship, node LIMIT 40""")
def gr6(spark, sf):
    return graph.dependencies(edges(spark, sf), "p:1", limit=40)


@query("gr7_related", f"""WITH {EDGES_SQL}, g AS (SELECT DISTINCT relationship || '_outgoing' AS grp, dst AS node FROM edges WHERE src = 'p:1'
  UNION SELECT DISTINCT relationship || '_incoming', src FROM edges WHERE dst = 'p:1')
  SELECT grp, node, total FROM (SELECT *, count(*) OVER (PARTITION BY grp) AS total, row_number() OVER (PARTITION BY grp ORDER BY node) AS r FROM g) WHERE r <= 20""")
def gr7(spark, sf):
    return graph.related_entities(edges(spark, sf), "p:1")


_CONE = f"""{_bfs_sql("c:1", 2, "src", "dst")},
  ranked AS (SELECT node, depth, CASE WHEN depth = 1 THEN 'direct' ELSE 'transitive' END AS part, row_number() OVER (PARTITION BY depth = 1 ORDER BY depth, node) AS rank FROM least WHERE depth > 0),
  cone AS (SELECT * FROM ranked WHERE part = 'direct' OR rank <= 200), {NODES_SQL}"""


@query("gr9_capabilities_touched", f"""{_CONE} SELECT capability, count(*) FILTER (WHERE part = 'direct') AS direct_count, count(*) FILTER (WHERE part = 'transitive') AS transitive_count,
  array_to_string((list(node ORDER BY depth, node))[1:10], ',') AS members FROM cone JOIN nodes USING (node) WHERE capability IS NOT NULL GROUP BY capability""")
def gr9a(spark, sf):
    ents = nodes(spark, sf).withColumnRenamed("node", "entity_id")
    return graph.behavior_slice(edges(spark, sf), ents, "c:1", 2)[1].withColumn("members", F.array_join("members", ","))


@query("gr9_globals_used", f"""{_CONE} SELECT variable, CASE WHEN min(access) = 0 THEN 'direct' ELSE 'transitive' END AS access FROM (
  SELECT 'b:' || p_brand AS variable, 1 AS access FROM cone JOIN part ON node = 'p:' || p_partkey) GROUP BY variable""")
def gr9b(spark, sf):
    ents = nodes(spark, sf).withColumnRenamed("node", "entity_id")
    return graph.behavior_slice(edges(spark, sf), ents, "c:1", 2)[2]


@query("gr10_state_touches", f"""WITH {CALLS_SQL} SELECT DISTINCT 'b:' || p_brand AS node, 'transitive' AS access FROM calls JOIN part ON dst = 'p:' || p_partkey WHERE src = 'c:1'""")
def gr10(spark, sf):
    return graph.state_touches(edges(spark, sf), "c:1")


@query("gr11_reachable_capabilities", f"""WITH RECURSIVE {CALLS_SQL}, {NODES_SQL}, reach AS (
  SELECT capability AS label, node FROM nodes WHERE capability IS NOT NULL AND kind = 'part'
  UNION SELECT label, src FROM reach JOIN calls ON dst = node)
  SELECT n.node AS seed, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels FROM nodes n LEFT JOIN reach r ON n.node = r.node WHERE n.kind = 'supplier' GROUP BY n.node""")
def gr11(spark, sf):
    n = nodes(spark, sf)
    return graph.reachable_labels(calls(spark, sf), n.where("kind = 'supplier'"), n.where("kind = 'part'").select("node", F.col("capability").alias("label")))


@query("gr12_callee_map", f"""WITH RECURSIVE {CALLS_SQL}, starts AS (SELECT 'c:' || c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING'),
  walk AS (SELECT node, 0 AS depth FROM starts UNION SELECT dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 3 AND dst NOT IN (SELECT node FROM starts))
  SELECT node, min(depth) AS depth FROM walk WHERE depth > 0 GROUP BY node""")
def gr12(spark, sf):
    starts = spark.read.parquet(f"{sf}/customer.parquet").where("c_mktsegment = 'BUILDING'").select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("node"))
    # Only the least depth over all starts matters, so they walk as one.
    one = starts.select(F.lit("all").alias("seed"), "node")
    found = graph.traverse(calls(spark, sf), one, 3, closed=starts)
    return found.where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))


@query("gr13_qualified_name", f"""WITH {NODES_SQL} SELECT 's:' || s_suppkey AS node, r_name || '::' || n_name || '::' || s_name AS qualified_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'n:' || n_nationkey, r_name || '::' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'r:' || r_regionkey, r_name FROM region""")
def gr13(spark, sf):
    e = edges(spark, sf).where("relationship = 'contained_by' and src not like 'c:%'")
    return graph.qualified_names(nodes(spark, sf).where("kind in ('supplier', 'nation', 'region')"), e, ["nation", "region"])


@query("gr14_classify_references", """SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN 'p:' || l_partkey ELSE 's:' || l_suppkey END AS src,
  CASE WHEN l_returnflag = 'R' THEN 's:' || l_suppkey ELSE 'p:' || l_partkey END AS dst, CASE WHEN l_linestatus = 'O' THEN 'calls' WHEN l_returnflag = 'R' THEN 'inherits' ELSE 'uses' END AS relationship FROM lineitem""")
def gr14(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    open_, back = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    refs = line.select(
        F.when(open_ & back, "referencedby").when(open_, "references").when(back, "derivedcompoundref").otherwise("ref").alias("tag"),
        F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("src"),
        F.when(open_, "function").when(back, "class").otherwise("function").alias("src_kind"),
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("dst"),
        F.when(open_, "define").when(back, "struct").otherwise("variable").alias("dst_kind"),
    )
    return graph.classify_references(refs)


@query("ag1_fan_metrics", f"""WITH {CALLS_SQL}, {NODES_SQL} SELECT node, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM nodes
  LEFT JOIN (SELECT dst AS node, count(*) AS i FROM calls GROUP BY dst) USING (node) LEFT JOIN (SELECT src AS node, count(*) AS o FROM calls GROUP BY src) USING (node)""")
def ag1(spark, sf):
    return graph.fan_metrics(nodes(spark, sf), calls(spark, sf).withColumn("relationship", F.lit("calls")))


@query("ag2_bridge", f"""WITH {CALLS_SQL}, {NODES_SQL}, f AS (SELECT src, dst FROM calls JOIN nodes a ON src = a.node JOIN nodes b ON dst = b.node WHERE a.capability <> b.capability)
  SELECT node, node IN (SELECT src FROM f) AND node IN (SELECT dst FROM f) AS is_bridge FROM nodes""")
def ag2(spark, sf):
    return graph.bridges(nodes(spark, sf), calls(spark, sf).withColumn("relationship", F.lit("calls")))


@query("gr26_components", f"""WITH RECURSIVE sales AS (SELECT DISTINCT 'p:' || l_partkey AS src, 's:' || l_suppkey AS dst FROM lineitem),
  both_ways AS (SELECT src, dst FROM sales UNION SELECT dst, src FROM sales),
  walk AS (SELECT src AS node, src AS component FROM both_ways UNION SELECT dst, component FROM walk JOIN both_ways ON src = node)
  SELECT node, min(component) AS component FROM walk GROUP BY node""")
def gr26(spark, sf):
    e = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.concat(F.lit("p:"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string")).alias("dst"))
    return graph.components(e)


@query("gr26_isolated", f"""WITH {CALLS_SQL}, {NODES_SQL} SELECT node FROM nodes WHERE node NOT IN (SELECT src FROM calls UNION SELECT dst FROM calls)""")
def gr26b(spark, sf):
    return graph.isolated(nodes(spark, sf), calls(spark, sf))


@query("gr29_weighted_projection", f"""WITH {EDGES_SQL} SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(CASE relationship WHEN 'calls' THEN 1.0 WHEN 'uses' THEN 0.5 WHEN 'inherits' THEN 2.0 ELSE 0 END)::DOUBLE AS weight
  FROM edges WHERE src <> dst GROUP BY ALL HAVING weight > 0""")
def gr29(spark, sf):
    return graph.weighted_projection(edges(spark, sf), {"calls": 1.0, "uses": 0.5, "inherits": 2.0})


_BRANDS = """links AS (SELECT a.p_brand AS src, b.p_brand AS dst, count(*)::DOUBLE AS weight FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) x
  JOIN part a ON x.l_partkey = a.p_partkey JOIN part b ON b.p_partkey = x.l_suppkey WHERE a.p_brand <> b.p_brand GROUP BY ALL)"""


def brand_links(spark, sf):
    """src, dst, weight between brands: the part sold to the part numbered as its supplier."""
    part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand")
    pairs = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_partkey").distinct()
    return (
        pairs.join(part.toDF("l_partkey", "src"), "l_partkey").join(part.toDF("l_suppkey", "dst"), "l_suppkey")
        .where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight"))
    )


@query("gr21_cycle_break")
def gr21(spark, sf):
    return graph.break_cycles(brand_links(spark, sf))


@query("gr22_waves")
def gr22(spark, sf):
    acyclic = graph.break_cycles(brand_links(spark, sf))
    every = brand_links(spark, sf)
    return graph.longest_path_waves(every.select(F.col("src").alias("node")).union(every.select("dst")), acyclic)


@query("gr22_containment_waves", """SELECT 's:' || s_suppkey AS node, 2 AS wave FROM supplier UNION ALL SELECT 'n:' || n_nationkey, 1 FROM nation UNION ALL SELECT 'r:' || r_regionkey, 0 FROM region""")
def gr22b(spark, sf):
    e = edges(spark, sf).where("relationship = 'contained_by' and src not like 'c:%'")
    return graph.longest_path_waves(nodes(spark, sf).where("kind in ('supplier', 'nation', 'region')"), e)


@query("gr18_strong_components", f"""WITH RECURSIVE {_BRANDS},
  walk AS (SELECT src, dst FROM links UNION SELECT walk.src, links.dst FROM walk JOIN links ON walk.dst = links.src),
  both_ways AS (SELECT a.src AS node, a.dst AS other FROM walk a JOIN walk b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst)
  SELECT node, least(node, min(other)) AS component FROM both_ways GROUP BY node""")
def gr18(spark, sf):
    return graph.strong_components(brand_links(spark, sf))


@query("gr17_visit_schedule")
def gr17(spark, sf):
    links = brand_links(spark, sf)
    return graph.visit_schedule(graph.break_cycles(links), links.select(F.col("src").alias("node")).union(links.select("dst")))


@query("gr27_betweenness")
def gr27(spark, sf):
    return graph.betweenness(brand_links(spark, sf)).withColumn("betweenness", F.round("betweenness", 9))
