"""Graph operators over edge rows (src, dst, relationship).

Traversals are frontier loops: one join of the frontier with the edges for each hop, an anti join with what was seen, and a
table written in the shared folder, so a lost executor costs a hop and not the whole history. A hop's distinct frontier
is all that is shuffled; the loop ends with an empty frontier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import materialize, release


def traverse(
    edges: DataFrame, seeds: DataFrame, max_depth: int | None, reverse: bool = False, closed: DataFrame | None = None
) -> DataFrame:
    """(seed, node, depth) for every node reached, depth the least number of hops, seeds at depth 0.

    seeds: a column node, or seed and node. closed: nodes (column node) that are never entered.
    """
    a, b = ("dst", "src") if reverse else ("src", "dst")
    hops = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).where(F.col("node").isNotNull() & F.col("next").isNotNull()).distinct()
    if closed is not None:
        hops = hops.join(closed.select(F.col("node").alias("next")).distinct(), "next", "left_anti")
    hops = materialize(hops, "hops")
    start = seeds if "seed" in seeds.columns else seeds.withColumn("seed", F.col("node"))
    seen = materialize(start.select("seed", "node", F.lit(0).alias("depth")).distinct(), "seen")
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        frontier = seen.where(F.col("depth") == depth - 1)
        fresh = (
            frontier.join(hops, "node").select("seed", F.col("next").alias("node")).distinct()
            .join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth))
        )
        fresh = materialize(fresh, "frontier")
        if fresh.isEmpty():
            break
        seen = seen.unionByName(fresh)
    return seen


#: Longs of 64 seeds each in a row of reach_bits().
WORDS = 16


def reach_bits(edges: DataFrame, seeds: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """(seed, block, bit) and (node, block, depth, w0, w1, ...): traverse() with 1,024 seeds in a row.

    Seed and node are a pair at that depth if the bit of the seed is set, counted from w0's lowest. A hop joins each edge
    once for all seeds of a block, where pairs would join once for each seed.
    """
    names = [f"w{i}" for i in range(WORDS)]
    hops = edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).where("node is not null and next is not null").distinct()
    hops = materialize(hops, "hops")
    start = seeds if "seed" in seeds.columns else seeds.withColumn("seed", F.col("node"))
    start = start.select("seed", "node").distinct()
    # Seeds with neighbouring names share a block: their cones often share nodes.
    text = F.col("seed").cast("string")
    numbers = materialize(start.select("seed").distinct().orderBy(F.length(text), text).select("seed", F.monotonically_increasing_id().alias("id")), "seeds")
    numbers = numbers.select("seed", F.expr(f"id div {64 * WORDS}").alias("block"), F.expr(f"cast(id % {64 * WORDS} as int)").alias("bit"))
    bits = [F.expr(f"bit_or(if(bit div 64 = {i}, shiftleft(1L, bit % 64), 0L))").alias(w) for i, w in enumerate(names)]
    levels = frontier = materialize(start.join(numbers, "seed").groupBy("node", "block").agg(*bits).withColumn("depth", F.lit(0)), "bits")
    for depth in range(1, max_depth + 1):
        reached = frontier.join(hops, "node").groupBy(F.col("next").alias("node"), "block").agg(*[F.bit_or(w).alias(w) for w in names])
        seen = levels.groupBy("node", "block").agg(*[F.bit_or(w).alias(f"seen_{w}") for w in names])
        new = [F.col(w).bitwiseAND(F.bitwise_not(F.coalesce(f"seen_{w}", F.lit(0).cast("long")))).alias(w) for w in names]
        fresh = reached.join(seen, ["node", "block"], "left").select("node", "block", *new, F.lit(depth).alias("depth"))
        frontier = materialize(fresh.where(" or ".join(f"{w} <> 0" for w in names)), "bits")
        if frontier.isEmpty():
            break
        levels = levels.unionByName(frontier)
    return numbers, levels.select("node", "block", "depth", *names)


def call_cone(edges: DataFrame, seed: str, max_depth: int = 5, max_size: int = 200) -> DataFrame:
    """node, depth, part (direct or transitive), truncated (GR1).

    The transitive part is cut at max_size by (depth, node), which fixes what an unordered walk leaves open.
    """
    spark = edges.sparkSession
    calls = edges.where("relationship = 'calls'")
    reached = traverse(calls, spark.createDataFrame([(seed,)], "node string"), max_depth).where("depth > 0").select("node", "depth")
    order = Window.partitionBy("part").orderBy("depth", "node")
    ranked = reached.withColumn("part", F.when(F.col("depth") == 1, "direct").otherwise("transitive")).withColumn("rank", F.row_number().over(order))
    size = reached.where("depth > 1").limit(max_size).count()
    return ranked.where((F.col("part") == "direct") | (F.col("rank") <= max_size)).select(
        "node", "depth", "part", F.lit(size >= max_size).alias("truncated")
    )


def neighbours_by_depth(edges: DataFrame, seed: str, max_depth: int, limit: int | None = None, reverse: bool = False, relationship: str = "calls") -> DataFrame:
    """node, depth, level_size, truncated: callers (reverse) or callees; the limit cuts each level's output only (GR2, GR3, GR5)."""
    spark = edges.sparkSession
    rows = traverse(edges.where(F.col("relationship") == relationship), spark.createDataFrame([(seed,)], "node string"), max_depth, reverse)
    level = Window.partitionBy("depth")
    out = rows.where("depth > 0").select(
        "node", "depth", F.row_number().over(level.orderBy("node")).alias("rank"), F.count("*").over(level).alias("level_size")
    )
    if limit is None:
        return out.select("node", "depth", "level_size", F.lit(False).alias("truncated"))
    return out.where(F.col("rank") <= limit).select("node", "depth", "level_size", (F.col("level_size") >= limit).alias("truncated"))


def class_hierarchy(edges: DataFrame, node: str) -> DataFrame:
    """Bases and derived classes, one hop each (GR4)."""
    inherits = edges.where("relationship = 'inherits'")
    return (
        inherits.where(F.col("src") == node).select(F.lit("base").alias("direction"), F.col("dst").alias("node"))
        .unionByName(inherits.where(F.col("dst") == node).select(F.lit("derived").alias("direction"), F.col("src").alias("node")))
        .distinct()
    )


def dependencies(edges: DataFrame, node: str, relationship: str | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    """node, relationship, direction; outgoing first (GR6, GR8, J8)."""
    rows = edges.where(F.col("relationship") == relationship) if relationship else edges
    out = rows.where(F.col("src") == node).select(F.col("dst").alias("node"), "relationship", F.lit("outgoing").alias("direction"), F.lit(0).alias("o"))
    into = rows.where(F.col("dst") == node).select(F.col("src").alias("node"), "relationship", F.lit("incoming").alias("direction"), F.lit(1).alias("o"))
    both = {"outgoing": out, "incoming": into}.get(direction, out.unionByName(into)).distinct()
    if limit is None:
        return both.drop("o")
    return both.orderBy("o", "relationship", "node").limit(limit).drop("o")


def related_entities(edges: DataFrame, node: str, limit: int = 20) -> DataFrame:
    """group, node, total: distinct neighbours by type and direction, at most limit in a group, totals before it (GR7)."""
    groups = dependencies(edges, node).select(F.concat_ws("_", "relationship", "direction").alias("grp"), "node").distinct()
    w = Window.partitionBy("grp")
    return (
        groups.select("grp", "node", F.row_number().over(w.orderBy("node")).alias("rank"), F.count("*").over(w).alias("total"))
        .where(F.col("rank") <= limit).drop("rank")
    )


def behavior_slice(edges: DataFrame, entities: DataFrame, seed: str, max_depth: int = 5, max_size: int = 200) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cone, capabilities touched with up to ten members, globals with their nearest access) of a function (GR9, AG8)."""
    cone = materialize(call_cone(edges, seed, max_depth, max_size), "cone")
    members = cone.join(entities.select(F.col("entity_id").alias("node"), "capability"), "node").where("capability is not null")
    touched = members.groupBy("capability").agg(
        F.count_if(F.col("part") == "direct").alias("direct_count"),
        F.count_if(F.col("part") == "transitive").alias("transitive_count"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"]), 1, 10).alias("members"),
    )
    spark = edges.sparkSession
    users = cone.select("node", F.lit(1).alias("access")).unionByName(spark.createDataFrame([(seed, 0)], "node string, access int"))
    uses = edges.where("relationship = 'uses'").select(F.col("src").alias("node"), F.col("dst").alias("variable"))
    globals_ = (
        users.join(uses, "node").groupBy("variable").agg(F.min("access").alias("access"))
        .select("variable", F.when(F.col("access") == 0, "direct").otherwise("transitive").alias("access"))
    )
    return cone, touched, globals_


def state_touches(edges: DataFrame, seed: str) -> DataFrame:
    """node, access: what the function uses, and what its direct callees use besides (GR10)."""
    uses = edges.where("relationship = 'uses'")
    direct = uses.where(F.col("src") == seed).select(F.col("dst").alias("node")).distinct()
    callees = edges.where((F.col("relationship") == "calls") & (F.col("src") == seed)).select(F.col("dst").alias("src")).distinct()
    more = uses.join(callees, "src").select(F.col("dst").alias("node")).distinct().join(direct, "node", "left_anti")
    return direct.withColumn("access", F.lit("direct")).unionByName(more.withColumn("access", F.lit("transitive")))


def reachable_labels(edges: DataFrame, seeds: DataFrame, labels: DataFrame, max_depth: int | None = None) -> DataFrame:
    """seed, labels: sorted distinct labels of everything reachable, the seed's own included (GR11).

    Labels spread instead of nodes: a node's label set is the union of its successors', so pairs stay bounded by nodes x
    labels and no (seed, node) closure is built.
    """
    return (
        traverse_labels(edges, labels, max_depth)
        .join(seeds.select("node").distinct(), "node", "right")
        .groupBy(F.col("node").alias("seed"))
        .agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    )


def traverse_labels(edges: DataFrame, labels: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(node, label, depth) for each label within max_depth calls of a node."""
    found = traverse(edges, labels.where("label is not null").select(F.col("label").alias("seed"), "node"), max_depth, reverse=True)
    return found.select("node", F.col("seed").alias("label"), "depth")


def callee_map(edges: DataFrame, entry_points: DataFrame, max_depth: int | None = None) -> DataFrame:
    """node, depth: the least depth over all entry points, not passing through other entry points (GR12)."""
    found = traverse(edges.where("relationship = 'calls'"), entry_points, max_depth, closed=entry_points)
    return found.where("depth > 0").groupBy("node").agg(F.min("depth").alias("depth"))


def qualified_names(nodes: DataFrame, edges: DataFrame, keep: list[str], separator: str = "::", max_depth: int = 10) -> DataFrame:
    """node, qualified_name: names of the containers of the kept kinds from the outermost, then the own one (GR13)."""
    parent = edges.where("relationship = 'contained_by'").groupBy(F.col("src").alias("child")).agg(F.max("dst").alias("parent"))
    named = nodes.select("node", "name", "kind")
    out = named.select("node", F.array("name").alias("path"), F.col("node").alias("at"))
    for _ in range(max_depth):
        up = (
            out.join(parent, out["at"] == parent["child"], "left")
            .join(named.select(F.col("node").alias("parent"), F.col("name").alias("pname"), F.col("kind").alias("pkind")), "parent", "left")
            .select(
                "node",
                F.when(F.col("pkind").isin(*keep), F.concat(F.array("pname"), "path")).otherwise(F.col("path")).alias("path"),
                F.col("parent").alias("at"),
            )
        )
        out = materialize(up, "names")
        if out.where("at is not null").isEmpty():
            break
    return out.select("node", F.array_join("path", separator).alias("qualified_name"))


def fan_metrics(nodes: DataFrame, edges: DataFrame, relationship: str = "calls") -> DataFrame:
    """node, fan_in, fan_out over distinct edges, 0 where there are none (AG1, GR20)."""
    e = edges.where(F.col("relationship") == relationship).select("src", "dst").distinct()
    counts = (
        e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
        .unionByName(e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")))
        .groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))
    )
    return nodes.select("node").join(counts, "node", "left").select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")])


def bridges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, is_bridge: own capability, a caller and a callee of other capabilities (AG2); nodes: node, capability."""
    e = edges.where("relationship = 'calls'").select("src", "dst").distinct()
    cap = nodes.select("node", "capability")
    ends = e.join(cap.toDF("src", "src_cap"), "src", "left").join(cap.toDF("dst", "dst_cap"), "dst", "left")
    foreign = ends.where("src_cap <> dst_cap")
    sides = (
        foreign.select(F.col("dst").alias("node"), F.lit(1).alias("c"), F.lit(0).alias("d"))
        .unionByName(foreign.select(F.col("src").alias("node"), F.lit(0).alias("c"), F.lit(1).alias("d")))
        .groupBy("node").agg(F.max("c").alias("c"), F.max("d").alias("d"))
    )
    return cap.join(sides, "node", "left").select("node", (F.coalesce("c", F.lit(0)) + F.coalesce("d", F.lit(0)) == 2).alias("is_bridge"))


#: Tag -> (source kinds, target kinds, relationship, reversed); the first that fits wins.
REFERENCE_RULES = [
    ("basecompoundref", ("class", "struct"), ("class", "struct"), "inherits", False),
    ("derivedcompoundref", ("class", "struct"), ("class", "struct"), "inherits", True),
    ("reimplements", ("function",), ("function",), "inherits", False),
    ("reimplementedby", ("function",), ("function",), "inherits", True),
    ("includes", ("file",), ("file",), "includes", False),
    ("includes", ("class", "struct"), None, None, False),
    ("includedby", ("file",), ("file",), "includes", True),
    ("references", ("function", "define"), ("function", "define"), "calls", False),
    ("references", None, ("variable", "typedef", "class", "struct", "enum", "namespace", "function", "define"), "uses", False),
    ("references", None, ("file",), None, False),
    ("referencedby", ("function", "define"), ("function", "define"), "calls", True),
    ("referencedby", ("class", "struct", "variable"), None, "uses", True),
    ("innerclass", ("file", "namespace", "class", "struct"), ("class", "struct"), "contained_by", True),
    ("innernamespace", ("file",), ("namespace",), "contained_by", True),
    ("innerfile", ("dir",), ("file",), "contained_by", True),
    ("innerdir", ("dir",), ("dir",), "contained_by", True),
    ("member", ("file", "namespace"), ("variable", "define"), "contained_by", True),
    ("_in_compound", None, None, "contained_by", False),
]


def classify_references(refs: DataFrame) -> DataFrame:
    """src, dst, relationship from (tag, src, src_kind, dst, dst_kind); an unknown combination raises (GR14, GR15)."""
    tag = F.lower(F.trim("tag"))
    tag = F.when((tag == "ref") & (F.col("src") != F.col("dst")), F.lit("references")).otherwise(tag)
    kind: Column = F.when(tag == "ref", F.lit("none"))
    turned: Column = F.when(tag == "ref", F.lit(False))
    for name, sources, targets, relationship, reverse in REFERENCE_RULES:
        fits = tag == name
        if sources:
            fits = fits & F.col("src_kind").isin(*sources)
        if targets:
            fits = fits & F.col("dst_kind").isin(*targets)
        kind, turned = kind.when(fits, relationship or "none"), turned.when(fits, reverse)
    kind = F.coalesce(kind, F.raise_error(F.concat(F.lit("unknown reference: "), tag, F.lit(" from "), "src_kind", F.lit(" to "), "dst_kind")))
    rows = refs.select("src", "dst", kind.alias("relationship"), turned.alias("turned")).where("relationship <> 'none'")
    return rows.select(F.when(F.col("turned"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("turned"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "relationship").distinct()


def build_multigraph(entities: DataFrame, refs: DataFrame, locations: DataFrame, exclude: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(node, name, kind, type) and (src, dst, relationship): entities, their references and their locations (GR16).

    entities: node, name, kind, type (compound or member); friends among the members go, and a member listed under several
    compounds is one node, which must agree in name and kind. refs: src, dst, tag. locations: node, role (file, decl or body),
    location. A location that is a decl or a body for anything is no file; decl and body at one place raise. exclude: node.
    """
    kept = entities.where("not (type = 'member' and kind <=> 'friend')")
    if exclude is not None:
        kept = kept.join(exclude.select("node"), "node", "left_anti")
    same = F.count_distinct(F.struct("name", "kind")) == 1
    clash = F.raise_error(F.concat(F.lit("differing entries of "), F.col("node"))).cast("string")
    one = kept.groupBy("node").agg(F.when(same, F.first("name")).otherwise(clash).alias("name"), F.first("kind").alias("kind"), F.min("type").alias("type"))
    kinds = one.select("node", "kind")
    ends = refs.join(kinds.toDF("src", "src_kind"), "src").join(kinds.toDF("dst", "dst_kind"), "dst")
    at = locations.where("location is not null").join(one.select("node"), "node", "left_semi")
    roles = F.array_sort(F.collect_set(F.when(F.col("role") != "file", F.col("role"))))
    both = F.raise_error(F.concat(F.lit("decl and body at "), F.col("location"))).cast("string")
    places = at.groupBy(F.col("location")).agg(roles.alias("roles")).select(
        F.col("location").alias("node"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("kind"),
        F.when(F.size("roles") > 1, both).otherwise(F.coalesce(F.get("roles", F.lit(0)), F.lit("file"))).alias("type"),
    )
    held = at.select(F.col("location").alias("src"), F.col("node").alias("dst"), F.lit("represented_by").alias("relationship")).distinct()
    return one.unionByName(places), classify_references(ends).unionByName(held)


def code_bodies(entities: DataFrame, locations: DataFrame, edges: DataFrame, lines: DataFrame, near: int = 10) -> DataFrame:
    """node, loc, code: the source of each entity with a body; a group has its members' sources, file by file (GR19).

    entities: node, kind. locations: node, role, file, line, end_line. lines: file, line, text. Classes and structs start at
    their file location where that lies fewer than `near` lines after the body's own. Of several bodies the least (file, line)
    counts; a missing end is the start. Namespaces, files and directories have no source.
    """
    body = locations.where("role = 'body'").groupBy("node").agg(F.min(F.struct("file", "line", F.coalesce(F.when(F.col("end_line") > 0, F.col("end_line")), F.col("line")).alias("e"))).alias("b"))
    with_body = entities.where("kind not in ('namespace', 'file', 'dir', 'group')").select("node", "kind").join(body, "node").select("node", "kind", "b.*")
    listed = locations.where("role = 'file'").select("node", F.col("file").alias("f"), F.col("line").alias("at"))
    shifted = (
        with_body.where("kind in ('class', 'struct')").join(listed, "node").where((F.col("f") == F.col("file")) & (F.col("at") - F.col("line")).between(1, near - 1))
        .groupBy("node").agg(F.min("at").alias("at"))
    )
    spans = with_body.join(shifted, "node", "left").select("node", "file", F.coalesce("at", "line").alias("s"), "e")
    text = spans.join(lines.select("file", "line", "text"), "file").where("line between s and e").groupBy("node").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: F.concat(x["text"], F.lit("\n"))), "").alias("code")
    )
    place = F.concat("file", F.lit(":"), F.col("s").cast("string"), F.lit("-"), F.col("e").cast("string"))
    single = spans.join(text, "node", "left").select("node", "file", "s", "e", place.alias("loc"), F.coalesce("code", F.lit("")).alias("code"))
    inside = edges.where("relationship = 'contained_by'").select(F.col("src").alias("node"), F.col("dst").alias("grp")).distinct()
    groups = entities.where("kind = 'group'").select(F.col("node").alias("grp"))
    parts = single.join(inside, "node").join(groups, "grp", "left_semi").groupBy("grp", "file").agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "node", "code"))), lambda x: x["code"]), "").alias("code")
    )
    files = F.array_sort(F.collect_list(F.struct("file", place.alias("loc"), "code")))
    joined = parts.groupBy(F.col("grp").alias("node")).agg(files.alias("x")).select(
        "node", F.array_join(F.transform("x", lambda x: x["loc"]), "|").alias("loc"), F.array_join(F.transform("x", lambda x: x["code"]), "").alias("code")
    )
    return single.select("node", "loc", "code").unionByName(joined)


def seed_neighbours(edges: DataFrame, seeds: DataFrame, known: DataFrame, limit: int = 10) -> DataFrame:
    """seed, node, relation: callers and callees (at most `limit` each), containers and containees (GR28).

    A node stands once for a seed, under the first of the four relations. seeds: seed; known: node.
    """
    s = seeds.select("seed").distinct()
    rows = edges.where("relationship in ('calls', 'contained_by')").select("src", "dst", "relationship").distinct()
    near = lambda mine, other, kind, order: rows.where(F.col("relationship") == kind).join(s, F.col(mine) == F.col("seed")).select("seed", F.col(other).alias("node"), F.lit(order).alias("o"))
    called = near("dst", "src", "calls", 0).unionByName(near("src", "dst", "calls", 1))
    w = Window.partitionBy("seed", "o").orderBy("node")
    cut = called.withColumn("r", F.row_number().over(w)).where(F.col("r") <= limit).drop("r")
    held = near("src", "dst", "contained_by", 2).unionByName(near("dst", "src", "contained_by", 3))
    every = cut.unionByName(held).join(known.select("node"), "node", "left_semi")
    names = F.array(*[F.lit(x) for x in ("caller", "callee", "container", "containee")])
    return every.groupBy("seed", "node").agg(F.min("o").alias("o")).select("seed", "node", F.get(names, F.col("o")).alias("relation"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component of the undirected graph, named by its least node: least-label spreading with pointer jumps (GR26)."""
    pairs = edges.select("src", "dst").where("src <> dst")
    both = materialize(pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "both")
    label = materialize(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("m")).select("node", F.least("node", "m").alias("component")), "label")
    for _ in range(rounds):
        near = both.join(label.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("m"))
        step = label.join(near, "node").select("node", F.least("component", "m").alias("component"))
        jump = step.select(F.col("node").alias("at"), F.col("component").alias("further"))
        nxt = materialize(
            step.join(jump, F.col("component") == F.col("at"), "left").select("node", F.least("component", F.coalesce("further", "component")).alias("component")), "label"
        )
        moved = nxt.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count()
        release(label)
        label = nxt
        if not moved:
            return label
    raise RuntimeError("components did not converge")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge (GR26)."""
    ends = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node")))
    return nodes.select("node").join(ends, "node", "left_anti")


def weighted_projection(edges: DataFrame, weights: dict[str, float]) -> DataFrame:
    """a, b, weight: undirected pairs with their edges' weights added up (GR29)."""
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("relationship")], F.lit(0.0))
    return (
        edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w"))
        .groupBy("a", "b").agg(F.sum("w").alias("weight")).where("weight > 0")
    )


def strong_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """node, component for strongly connected components of more than one node (GR18).

    Forward and backward spreading of the least label splits the graph; nodes whose both labels agree form a component, and
    edges between different label pairs drop out until nothing is left.
    """
    left = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    found = None
    for _ in range(max_rounds):
        # Trim nodes without a way in or out: they are in no cycle.
        while True:
            n = left.count()
            left2 = materialize(
                left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "scc"
            )
            left = left2
            if left.count() == n:
                break
        if left.isEmpty():
            break
        marks = []
        for a, b in (("src", "dst"), ("dst", "src")):
            label = materialize(left.select(F.col("src").alias("node")).distinct().withColumn("m", F.col("node")), "mark")
            while True:
                spread = left.join(label.select(F.col("node").alias(a), "m"), a).groupBy(F.col(b).alias("node")).agg(F.min("m").alias("n"))
                nxt = materialize(label.join(spread, "node", "left").select("node", F.least("m", F.coalesce("n", "m")).alias("m")), "mark")
                moved = nxt.join(label.withColumnRenamed("m", "w"), "node").where("m <> w").limit(1).count()
                label = nxt
                if not moved:
                    break
            marks.append(label)
        both = materialize(marks[0].withColumnRenamed("m", "f").join(marks[1].withColumnRenamed("m", "g"), "node"), "mark")
        part = both.where("f = g").select("node", F.col("f").alias("component"))
        found = part if found is None else found.unionByName(part)
        ends = left.join(both.toDF("src", "sf", "sg"), "src").join(both.toDF("dst", "df", "dg"), "dst")
        left = materialize(ends.where("sf = df and sg = dg and sf <> sg").select("src", "dst"), "scc")
    if found is None:
        return edges.sparkSession.createDataFrame([], "node string, component string")
    w = Window.partitionBy("component")
    return found.withColumn("n", F.count("*").over(w)).where("n > 1").drop("n")


def visit_schedule(edges: DataFrame, nodes: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """node, step: all nodes of the least unvisited fan-in, or of a cycle the one with the largest fan-out (GR17, NB15)."""
    left, e, out, step = materialize(nodes.select("node").distinct(), "visit"), edges.select("src", "dst").where("src <> dst").distinct(), None, 0
    while step < max_steps and not left.isEmpty():
        step += 1
        live = e.join(left.toDF("src"), "src", "left_semi").join(left.toDF("dst"), "dst", "left_semi")
        fan = fan_metrics(left, live.withColumn("relationship", F.lit("calls")))
        least = fan.agg(F.min("fan_in")).first()[0]
        ready = fan.where(F.col("fan_in") == least)
        ready = ready if least == 0 else ready.orderBy(F.desc("fan_out"), "node").limit(1)
        ready = materialize(ready.select("node", F.lit(step).alias("step"), "fan_out"), "visit")
        out = ready if out is None else out.unionByName(ready)
        left = materialize(left.join(ready, "node", "left_anti"), "visit")
    return out


def longest_path_waves(nodes: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """node, wave: the longest path to a leaf of an acyclic graph; what cycles hold back gets -1 (GR22, GR24)."""
    e = materialize(edges.select("src", "dst").where("src <> dst").distinct(), "waves")
    done, wave = None, 0
    left = materialize(nodes.select("node").distinct(), "waves")
    while wave < max_rounds:
        held = e.join(left.toDF("dst"), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        ready = materialize(left.join(held, "node", "left_anti").withColumn("wave", F.lit(wave)), "waves")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        left = materialize(left.join(ready, "node", "left_anti"), "waves")
        wave += 1
    stuck = left.withColumn("wave", F.lit(-1))
    return stuck if done is None else done.unionByName(stuck)


def betweenness(edges: DataFrame, sources: DataFrame | None = None, most_edges: int = 2_000_000) -> DataFrame:
    """node, betweenness by Brandes (2001), one source at a time in each task (GR27).

    The adjacency is shared with the tasks, so the edges are counted first and must be at most most_edges.
    """
    import pandas as pd

    rows = edges.select("src", "dst").distinct()
    if rows.limit(most_edges + 1).count() > most_edges:
        raise ValueError(f"betweenness needs at most {most_edges} edges; give a subgraph")
    links: dict[str, list[str]] = {}
    for s, d in rows.toPandas().itertuples(index=False):
        links.setdefault(s, []).append(d)
        links.setdefault(d, [])
    spark = edges.sparkSession
    shared = spark.sparkContext.broadcast(links)
    starts = sources if sources is not None else spark.createDataFrame(pd.DataFrame({"node": sorted(links)}, dtype=str)) if links else spark.createDataFrame([], "node string")

    def brandes(batches):
        adjacent = shared.value
        for pdf in batches:
            total: dict[str, float] = {}
            for s in pdf["node"]:
                order, before, sigma, dist = [], {s: []}, {s: 1.0}, {s: 0}
                queue = [s]
                for v in queue:
                    order.append(v)
                    for w in adjacent.get(v, ()):
                        if w not in dist:
                            dist[w], sigma[w], before[w] = dist[v] + 1, 0.0, []
                            queue.append(w)
                        if dist[w] == dist[v] + 1:
                            sigma[w] += sigma[v]
                            before[w].append(v)
                delta = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before[w]:
                        delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + delta[w]
            yield pd.DataFrame({"node": list(total), "b": list(total.values())}).astype({"node": "object", "b": "float64"})

    n = len(links)
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = starts.select("node").mapInPandas(brandes, "node string, b double").groupBy("node").agg((F.sum("b") * scale).alias("betweenness"))
    every = spark.createDataFrame(pd.DataFrame({"node": sorted(links)}, dtype=str)) if links else starts
    return every.join(sums, "node", "left").select("node", F.coalesce("betweenness", F.lit(0.0)).alias("betweenness"))


def break_cycles(edges: DataFrame, most_edges: int = 100_000) -> DataFrame:
    """src, dst, weight without cycles: the lightest edge of a found cycle goes, by (weight, src, dst) (GR21).

    For capability graphs of at most most_edges edges, counted before they come to the driver.
    """
    rows = edges.select("src", "dst", "weight")
    if rows.limit(most_edges + 1).count() > most_edges:
        raise ValueError("too many edges for a cycle search on the driver")
    left = {(r["src"], r["dst"]): r["weight"] for r in rows.collect() if r["src"] != r["dst"]}
    while True:
        after: dict[str, list[str]] = {}
        for s, d in sorted(left):
            after.setdefault(s, []).append(d)
        cycle = _find_cycle(after)
        if not cycle:
            break
        del left[min(cycle, key=lambda e: (left[e], e))]
    spark = edges.sparkSession
    return spark.createDataFrame([(s, d, float(w)) for (s, d), w in sorted(left.items())], "src string, dst string, weight double")


def _find_cycle(after: dict[str, list[str]]) -> list[tuple[str, str]]:
    state: dict[str, int] = {}
    for root in sorted(after):
        if root in state:
            continue
        path, iters = [root], [iter(after.get(root, ()))]
        state[root] = 1
        while path:
            nxt = next(iters[-1], None)
            if nxt is None:
                state[path.pop()] = 2
                iters.pop()
            elif state.get(nxt) == 1:
                loop = path[path.index(nxt) :] + [nxt]
                return list(zip(loop, loop[1:], strict=False))
            elif nxt not in state:
                state[nxt] = 1
                path.append(nxt)
                iters.append(iter(after.get(nxt, ())))
    return []
