import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgraph.functions import scalars, text, vectors
from quillgraph.operators import capability, cluster, cones, etl, evaluate, graph, models, retrieval
from quillgraph.operators.tools import Tools
from tests.fixtures import call_graph, edges, entities


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def values(df, *columns):
    return {tuple(r) if len(columns) != 1 else r[0] for r in df.select(*columns).collect()}


# retrieval


def test_keyword_scores_tie_in_any_order_of_their_weights(spark):
    weights = {0: (1.0, 0.4, 0.4), 1: (0.4, 0.4, 1.0)}  # as doubles 1.7999999999999998 and 1.8
    rows = spark.createDataFrame([(k, f"t{i}", w) for k, ws in weights.items() for i, w in enumerate(ws)], "doc_id long, lexeme string, weight double").coalesce(1)
    assert [tuple(r) for r in retrieval.keyword_channel(rows, "doc_id", ["t0", "t1", "t2"], 1).collect()] == [(0, 1.8)]


# scalars


def test_scalars(spark):
    L = F.lit
    r = one(
        spark, scalars.is_symbol_like(L("damage")).alias("a"), scalars.is_symbol_like(L("apply damage")).alias("b"), scalars.is_symbol_like(L("f( x")).alias("c"), scalars.is_symbol_like(L("  ")).alias("d"),
        scalars.scope_split(L("A::B::c ")).alias("s"), scalars.scope_split(L("::c")).alias("t"), scalars.shape_rank(L(5.0), 0.0).alias("z"), scalars.shape_rank(L(9.0), 4.0).alias("o"),
        scalars.bare_name(L("static int A::f(int x)")).alias("bare"), scalars.entry_point_name(L("void do_kill(int)")).alias("ep"), scalars.name_terms(L("getPlayerHitPoints.cc")).alias("terms"),
        scalars.clean_text(L("Hi ```x = 1``` there, YOU")).alias("clean"), scalars.rationale_specificity(L("")).alias("r0"), scalars.rationale_specificity(L("damage " * 100)).alias("r1"),
        scalars.minimal_embed_text(L("function"), L("f"), L(""), L("a.cc")).alias("m"), scalars.minimal_embed_text(L(""), L(""), L(""), L("")).alias("m0"), vectors.cosine(F.array(L(0.0)), F.array(L(1.0))).alias("cos"),
    )
    assert (r.a, r.b, r.c, r.d) == (True, False, True, False)
    assert (r.s.scope, r.s.bare, r.t.scope, r.t.bare) == ("A::B", "c", None, "::c")
    assert r.z == 0 and r.o == 1 and r.bare == "A::f" and r.ep == "do_kill"
    assert r.terms == ["player", "hit", "points"] and r.clean == "hi there you" and (r.r0, r.r1) == (0.0, 1.0)
    assert r.m == "[function] f in a.cc" and r.m0 is None and r.cos is None


@pytest.mark.parametrize("pair", [("a", "b"), ("it's", "b"), ('q"x', "it's"), ("back\\slash", "l\nf"), ("both'\"", "é")])
def test_entity_id_is_the_hash_of_the_repr(spark, pair):
    import hashlib

    got = one(spark, scalars.entity_id(F.lit("class"), F.lit(pair[0]), F.lit(pair[1])).alias("x")).x
    assert got == "cls:" + hashlib.sha256(repr(pair).encode()).hexdigest()[:7]


def test_id_prefixes(spark):
    kinds = {"function": "fn", "define": "fn", "variable": "var", "class": "cls", "struct": "cls", "file": "file", "enum": "sym", "typedef": "sym", "?": "sym"}
    r = one(spark, *[scalars.entity_id(F.lit(k), F.lit("a"), F.lit("b")).alias(k) for k in kinds])
    assert {k: r[k].split(":")[0] for k in kinds} == kinds


def test_tokens_and_trigrams(spark):
    r = one(
        spark, text.tokens(F.lit("The Damage of the damage_2!")).alias("t"), text.token_jaccard(text.tokens(F.lit("")), text.tokens(F.lit("x"))).alias("z"),
        text.query_coverage(text.tokens(F.lit("armor hits")), text.tokens(F.lit("armor"))).alias("c"), text.trigrams(F.lit("ab c")).alias("g"),
    )
    assert r.t == ["damage", "damage_2"] and r.z == 0 and r.c == 0.5 and r.g == ["  a", " ab", "ab ", "  c", " c "]


def test_embed_texts(spark):
    e = entities(spark)
    cols = [F.col(c) for c in ("brief", "details", "params", "returns", "notes", "rationale", "name")]
    doc = {r[0]: r[1] for r in e.select("entity_id", scalars.doc_embed_text(*cols)).collect()}
    assert doc["var:d4e5f6a"] == "max_damage" and doc["fn:a1b2c3d"].startswith("BRIEF: Applies damage to a character\nDETAILS:") and "RATIONALE: central" in doc["fn:a1b2c3d"]
    sym = {r[0]: r[1] for r in e.select("entity_id", scalars.symbol_embed_text(*[F.col(c) for c in ("kind", "name", "qualified_name", "signature")])).collect()}
    assert sym["fn:a1b2c3d"] == "int Combat::damage(Character *ch, int amount)" and sym["cls:c3d4e5f"] == "Character"


# graph


def test_cone_and_levels(spark):
    g = call_graph(spark)
    cone = graph.call_cone(g, "do_kill")
    assert values(cone.where("part = 'direct'"), "node") == {"damage", "do_look"}
    assert values(cone.where("part = 'transitive'"), "node") == {"send_to_char", "affect_to_char", "show_room_to_char"}
    assert not cone.first().truncated and graph.call_cone(g, "do_kill", 1).count() == 2
    cut = graph.call_cone(g, "do_kill", 5, 1)
    assert cut.first().truncated and cut.where("part = 'transitive'").count() == 1
    assert graph.call_cone(g, "nobody").count() == 0
    assert values(graph.neighbours_by_depth(g, "send_to_char", 2, reverse=True), "node", "depth") == {("damage", 1), ("do_kill", 2)}
    assert values(graph.neighbours_by_depth(g, "do_kill", 1, 1), "level_size", "truncated") == {(2, True)}
    assert values(graph.class_hierarchy(g, "Character"), "direction", "node") == {("derived", "Player"), ("derived", "MobilePrototype")}


def test_slice_and_state(spark):
    e = edges(spark)
    cone, touched, globals_ = graph.behavior_slice(e, entities(spark), "fn:b2c3d4e")
    assert values(cone, "node", "part") == {("fn:a1b2c3d", "direct"), ("fn:e5f6a7b", "transitive")}
    assert values(touched, "capability", "direct_count", "transitive_count") == {("combat", 1, 1)}
    assert values(globals_, "variable", "access") == {("var:d4e5f6a", "transitive")}
    assert values(graph.state_touches(e, "fn:a1b2c3d"), "node", "access") == {("var:d4e5f6a", "direct")}
    assert values(graph.state_touches(e, "fn:b2c3d4e"), "node", "access") == {("var:d4e5f6a", "transitive")}


def test_cycles_waves_and_components(spark):
    rows = [("a", "b", 3.0), ("b", "c", 1.0), ("c", "a", 2.0), ("c", "d", 5.0), ("x", "y", 1.0), ("y", "x", 1.0)]
    e = spark.createDataFrame(rows, "src string, dst string, weight double")
    kept = values(graph.break_cycles(e), "src", "dst")
    assert kept == {("a", "b"), ("c", "a"), ("c", "d"), ("y", "x")}
    nodes = spark.createDataFrame([(x,) for x in "abcdxyz"], "node string")
    waves = dict(values(graph.longest_path_waves(nodes, graph.break_cycles(e)), "node", "wave"))
    assert waves == {"b": 0, "a": 1, "c": 2, "d": 0, "x": 0, "y": 1, "z": 0}
    assert {n for n, w in values(graph.longest_path_waves(nodes, e), "node", "wave") if w < 0} == {"a", "b", "c", "x", "y"}
    scc = values(graph.strong_components(e.select("src", "dst")), "node", "component")
    assert scc == {("a", "a"), ("b", "a"), ("c", "a"), ("x", "x"), ("y", "x")}
    assert dict(values(graph.components(e), "node", "component")) == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert values(graph.isolated(nodes, e), "node") == {"z"}
    steps = dict(values(graph.visit_schedule(graph.break_cycles(e), nodes), "node", "step"))
    assert steps["c"] < steps["a"] < steps["b"] and len(steps) == 7


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    got = dict(values(graph.betweenness(e), "node", "betweenness"))
    assert got == {"a": 0, "b": pytest.approx(2 / 6), "c": pytest.approx(2 / 6), "d": 0}


def test_reference_rules(spark):
    rows = [("basecompoundref", "c1", "class", "c2", "struct"), ("innerfile", "d", "dir", "f", "file"), ("ref", "f", "function", "f", "function"), ("referencedby", "f", "function", "g", "define")]
    cols = "tag string, src string, src_kind string, dst string, dst_kind string"
    assert values(graph.classify_references(spark.createDataFrame(rows, cols)), "src", "dst", "relationship") == {("c1", "c2", "inherits"), ("f", "d", "contained_by"), ("g", "f", "calls")}
    with pytest.raises(Exception, match="unknown reference"):
        graph.classify_references(spark.createDataFrame([("innerdir", "a", "file", "b", "dir")], cols)).collect()


# retrieval


def test_search_exact_scope_and_blank(spark):
    e = entities(spark)
    rows = retrieval.hybrid_search(e, "damage").collect()
    assert {rows[0].entity_id, rows[1].entity_id} == {"fn:a1b2c3d", "fn:h8i9j0k"} and rows[0].tier >= rows[-1].tier
    scoped = retrieval.hybrid_search(e, "Logging::damage").collect()
    assert scoped[0].entity_id == "fn:h8i9j0k" and scoped[0].tier == 1
    assert retrieval.hybrid_search(e, "   ").count() == 0
    assert retrieval.hybrid_search(e, "xyzzy plugh nothing").count() == 0
    assert values(retrieval.hybrid_search(e, "damage", kind="variable"), "kind") <= {"variable"}
    near = retrieval.hybrid_search(e, "being in the world", [0.0, 1.0], [0.0, 1.0], limit=1).collect()
    assert near[0].entity_id == "cls:c3d4e5f"


def test_arbitration_rules(spark):
    rows = spark.createDataFrame([(1, "b", 3.0, 2.0), (2, "b", 5.0, 2.0), (3, None, 5.0, 2.0), (4, "b", 2.0, 2.0)], "k int, brief string, ce_doc double, ce_symbol double")
    sym = {r.k: (r.winning_view, r.winning_score) for r in retrieval.arbitrate(rows, F.lit(True)).collect()}
    assert sym == {1: ("symbol", 2.0), 2: ("doc", 5.0), 3: ("symbol", 2.0), 4: ("symbol", 2.0)}
    doc = {r.k: r.winning_view for r in retrieval.arbitrate(rows, F.lit(False)).collect()}
    assert doc == {1: "doc", 2: "doc", 3: "doc", 4: "doc"}


def test_resolver_stages(spark):
    e = entities(spark)
    assert [(r.entity_id, r.match_type, r.status) for r in retrieval.resolve(e, "fn:a1b2c3d").collect()] == [("fn:a1b2c3d", "entity_id", "exact")]
    assert {r.status for r in retrieval.resolve(e, "damage").collect()} == {"ambiguous"}
    assert retrieval.resolve(e, "class Character").first().match_type == "signature"
    assert [r.name for r in retrieval.resolve(e, "arm").collect()] == ["armor_absorb"]
    assert retrieval.resolve(e, "zzz").count() == 0


# build


def test_declarations_and_documents(spark):
    rows = [("m1", 1, False, "doc"), ("m1", 2, True, None), ("m2", 1, True, "own"), ("m2", 2, True, "late")]
    got = values(etl.dedupe_declarations(spark.createDataFrame(rows, "m string, ord int, body boolean, doc string"), "m", "ord", "body", "doc"), "m", "ord", "doc")
    assert got == {("m1", 2, "doc"), ("m2", 1, "own")}
    with pytest.raises(Exception, match="no definition"):
        etl.dedupe_declarations(spark.createDataFrame([("m3", 1, False, None)], "m string, ord int, body boolean, doc string"), "m", "ord", "body", "doc").collect()
    with pytest.raises(Exception, match="duplicate id"):
        etl.check_unique(spark.createDataFrame([("a",), ("a",)], "k string"), "k").collect()


def test_usages_and_callers(spark):
    e = entities(spark)
    u = etl.explode_usages(e)
    assert values(u, "caller_compound", "caller_sig") == {("fight_8cc", "void hit()"), ("spell_8cc", "void bolt(int a, int b)"), ("odd", "")}
    assert etl.top_callers(u, e, 2).count() == 2 and etl.top_callers(u, e).first().caller_fan_in == 0


def test_cache_sync(spark):
    wanted = spark.createDataFrame([("a", "x"), ("b", "y")], "key string, text string")
    cached = spark.createDataFrame([("b", [1.0]), ("c", [2.0])], "key string, vector array<double>")
    assert values(etl.sync_plan(wanted, cached), "key", "action") == {("a", "embed"), ("b", "keep"), ("c", "prune")}
    made = etl.sync_cache(wanted, cached, lambda rows: rows.select("key", F.array(F.lit(9.0)).alias("vector")))
    assert {r.key: r.vector for r in made.collect()} == {"a": [9.0], "b": [1.0]}


def test_embedding_width_is_checked(spark):
    rows = spark.createDataFrame([("a", "some text"), ("b", None)], "key string, text string")
    got = {r.key: r.vector for r in models.embed_rows(rows, lambda: models.HashEmbedder(8), 8).collect()}
    assert len(got["a"]) == 8 and np.linalg.norm(got["a"]) == pytest.approx(1)
    with pytest.raises(Exception, match="are expected"):
        models.embed_rows(rows, lambda: models.HashEmbedder(8), 9).collect()


# capabilities, clusters, evaluation


def test_capability_rules(spark):
    r = one(spark, *[capability.tier(F.lit(k), F.lit(n)).alias(f"{k}{n}") for k, n in (("utility", 99), ("domain", 10), ("domain", 3), ("domain", 0), ("domain", 2))])
    assert list(r) == [0, 1, 2, 4, 3]
    r = one(spark, capability.edge_type(F.lit("policy"), F.lit("utility")).alias("a"), capability.edge_type(F.lit("?"), F.lit("domain")).alias("b"))
    assert list(r) == ["uses_utility", "requires"]
    waves = spark.createDataFrame([("a", 0), ("b", 2)], "capability string, wave int")
    need = spark.createDataFrame([("x", "b"), ("x", "a"), ("y", None), ("z", "gone"), ("w", "uncategorized")], "entry string, capability string")
    assert values(capability.enablement(need, waves), "entry", "wave") == {("x", 2), ("y", 0), ("z", 3), ("w", 0)}


def test_cohesion_equals_pairs(spark):
    r = np.random.default_rng(0)
    rows = [(i, int(i % 3), [float(x) for x in r.standard_normal(5)]) for i in range(40)] + [(99, 7, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "k long, g int, v array<double>")
    got = {x.grp: x for x in cluster.cohesion(df, "k", "g", "v").collect()}
    for g in range(3):
        u = np.array([v for _, h, v in rows if h == g])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        s = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert got[g].mean == pytest.approx(s.mean()) and got[g].least == pytest.approx(s.min(), abs=1e-4) and got[g].p75 == pytest.approx(np.percentile(s, 75), abs=1e-4)
    assert got[7].mean == 1.0
    small = {x.grp: x.times for x in cluster.pair_histogram(df, "k", "g", "v", block=4).groupBy("grp").agg(F.sum("times").alias("times")).collect()}
    assert small[0] == 14 * 13 // 2


def test_assignment_is_optimal():
    from itertools import permutations

    r = np.random.default_rng(1)
    for n in range(1, 7):
        c = r.integers(0, 20, (n, n)).astype(float)
        best = min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(n)))
        assert sum(c[i, j] for i, j in enumerate(cluster.assignment(c))) == best


def test_communities_of_two_cliques(spark):
    pairs = [(f"{s}{i}", f"{s}{j}", 1.0) for s in "ab" for i in range(5) for j in range(i)] + [("a0", "b0", 0.5)]
    got = dict(values(cluster.communities(spark.createDataFrame(pairs, "a string, b string, weight double")), "node", "community"))
    assert len({got[f"a{i}"] for i in range(5)}) == 1 and len({got[f"b{i}"] for i in range(5)}) == 1 and got["a1"] != got["b1"]


def test_cones_as_bits_equal_cones_as_pairs(spark):
    rng = np.random.default_rng(1)
    pairs = [(f"n{a}", f"n{b}") for a, b in rng.integers(0, 1500, (2500, 2)).tolist()]
    e = spark.createDataFrame(pairs, "src string, dst string").withColumn("relationship", F.lit("calls"))
    seeds = spark.createDataFrame([(f"n{i}",) for i in range(1100)], "node string")  # more than a block holds
    member = spark.createDataFrame([(f"n{i}", f"c{i % 3}" if i % 7 else None) for i in range(1500)], "node string, capability string")
    cone = graph.traverse(e, seeds, 3).where("depth > 0")
    wanted = cone.join(member.where("capability is not null"), "node").groupBy("seed", "capability").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    got = capability.exercise_counts(e, seeds, member, 3)
    assert values(got, "seed", "capability", "direct", "transitive") == values(wanted, "seed", "capability", "direct", "transitive")
    per = cone.groupBy("depth").agg(F.count("*").alias("pairs"), F.countDistinct("node").alias("nodes"))
    assert values(capability.depth_distribution(e, seeds, 3), "depth", "pairs", "nodes") == values(per, "depth", "pairs", "nodes")
    _, levels = graph.reach_bits(e, seeds, 3)
    assert levels.where("depth = 1").count() < cone.where("depth = 1").count()  # rows are for blocks of seeds, not for pairs


def test_consensus_and_stable_clusters(spark):
    a = spark.createDataFrame([(i, i // 3) for i in range(9)], "node long, cluster int")
    b = spark.createDataFrame([(i, i // 3 + 5) for i in range(9)], "node long, cluster int")
    c = {r.node: r.cluster for r in cluster.consensus([(a, 0.5), (b, 0.5)], 3).collect()}
    assert c[0] == c[1] == c[2] != c[3] and len(set(c.values())) == 3
    runs = a.withColumn("run", F.lit(0)).unionByName(b.withColumn("run", F.lit(1)))
    assert values(cluster.stable_clusters(runs, 0.9), "cluster") == {0, 3, 6}


def test_consensus_links_classes_as_single_nodes(spark):
    rng = np.random.default_rng(0)
    n, clusters = 40, 4
    a = (rng.random(n) ** 2 * 6).astype(int)
    b = np.where(rng.random(n) < 0.5, a, (rng.random(n) ** 2 * 5).astype(int))
    together = 0.5 * (a[:, None] == a) + 0.3 * (b[:, None] == b)
    s = together / together.sum(1)[:, None]
    number = {x: i for i, x in enumerate(dict.fromkeys(zip(a.tolist(), b.tolist(), strict=True)))}
    of = np.array([number[x] for x in zip(a.tolist(), b.tolist(), strict=True)])
    apart = rng.random((len(number), len(number))) * 1e-7  # no two pairs of classes are equally similar
    s = (s + s.T) / 2 + (apart + apart.T)[np.ix_(of, of)]
    groups = [[i] for i in range(n)]
    while len(groups) > clusters:
        x, y = max(((x, y) for y in range(len(groups)) for x in range(y)), key=lambda p: (round(s[np.ix_(groups[p[0]], groups[p[1]])].mean(), 12), -p[0], -p[1]))
        groups[x] = sorted(groups[x] + groups.pop(y))
    first = [int(np.flatnonzero(of == p)[0]) for p in range(len(number))]
    linked = cluster._linked(np.bincount(of), s[np.ix_(first, first)].copy(), clusters)
    assert sorted(sorted(int(np.flatnonzero(of == p)[k]) for p, start, stop in g for k in range(start, stop)) for g in linked) == sorted(groups)


def test_consensus_takes_many_nodes_of_few_classes(spark):
    one = spark.range(5000).select(F.col("id").alias("node"), (F.col("id") % 5).alias("cluster"))
    two = spark.range(5000).select(F.col("id").alias("node"), F.when(F.col("id") % 50 > 0, F.col("id") % 5).alias("cluster"))
    got = {r.node: r.cluster for r in cluster.consensus([(one, 0.5), (two, 0.3)], 5).collect()}
    assert got == {i: i % 5 for i in range(5000)}


def test_evaluation(spark):
    results = spark.createDataFrame([("q", i, float(10 - i)) for i in range(10)], "query string, id long, score double")
    expected = spark.createDataFrame([("q", 2), ("q", 50), ("none", 1)], "query string, id long")
    got = {r.query: r for r in evaluate.first_hits(evaluate.rank_results(results), expected).collect()}
    assert got["q"].first_rank == 3 and got["q"].recall_10 == 0.5 and got["none"].reciprocal_rank == 0
    pool = spark.createDataFrame([("q", 1, 1, 0.0, 5.0), ("q", 2, 2, 6.0, 1.0)], "query string, id long, ord int, doc_score double, symbol_score double")
    assert values(evaluate.rerank(pool), "id", "rank_before", "rank_after") == {(1, 1, 2), (2, 2, 1)}


# tools


def test_tools(spark):
    e = entities(spark)
    caps = spark.createDataFrame([("combat", "domain", "fights", 25, "stable"), ("commands", "policy", "input", 80, "evolving")], "name string, type string, description string, function_count int, stability string")
    cap_edges = spark.createDataFrame([("commands", "combat", "requires_core", 42, True)], "source_cap string, target_cap string, edge_type string, call_count int, in_dag boolean")
    points = spark.createDataFrame([("fn:b2c3d4e", "do_kill", ["commands", "combat"], "do_")], "entity_id string, name string, capabilities array<string>, entry_type string")
    t = Tools(e, etl.explode_usages(e), edges(spark), caps, cap_edges, points)
    assert t.get_entity("fn:a1b2c3d").first().source_text is None and t.get_entity("fn:a1b2c3d", True).first().source_text
    assert t.status(t.get_entity("nope"), "nope").first().status == "not_found"
    assert values(t.callers("fn:a1b2c3d"), "entity_id") == {"fn:b2c3d4e"} and values(t.callees("fn:b2c3d4e", 2), "entity_id") == {"fn:a1b2c3d", "fn:e5f6a7b"}
    assert t.neighbors("fn:a1b2c3d").count() == 3 and t.list_entry_points("do\\_%").count() == 1
    row, callers = t.explain_interface("fn:a1b2c3d")
    assert row.first().contract == "central contract of combat" and callers.count() == 3
    detail = t.capability_detail("combat")
    assert detail["functions"].first().entity_id == "fn:a1b2c3d" and detail["entry_points"].count() == 1 and detail["dependencies"].count() == 1
    assert t.search("damage", top_k=1).count() == 1 and t.search("spell", "usages").count() == 1
    with pytest.raises(ValueError):
        t.search("x", top_k=0)
    assert json.loads(t.stats().toJSON().collect()[0])["n"] >= 1


def test_cones_of_whole_numbers_cross_no_shuffle_by_edge(spark, monkeypatch):
    rng = np.random.default_rng(2)
    pairs = [(a - 700, b - 700) for a, b in rng.integers(0, 1500, (4000, 2)).tolist()]
    e = spark.createDataFrame(pairs + pairs[:9] + [(None, 1), (1, None)], "src long, dst long").withColumn("relationship", F.lit("calls"))
    seeds = spark.createDataFrame([(i - 700,) for i in [*range(1100), 5, 5000]] + [(None,)], "node long")
    member = spark.createDataFrame([(i - 700, f"c{i % 3}" if i % 7 else None) for i in [*range(1500), 8]], "node long, capability string")  # 8 has two
    cone = graph.traverse(e, seeds.where("node is not null"), 4).where("depth > 0").cache()
    wanted = cone.join(member.where("capability is not null"), "node").groupBy("seed", "capability").agg(F.count_if(F.col("depth") == 1).alias("direct"), F.count_if(F.col("depth") > 1).alias("transitive"))
    wanted = values(wanted, "seed", "capability", "direct", "transitive")
    depths = values(cone.groupBy("depth").agg(F.count("*").alias("pairs"), F.countDistinct("node").alias("nodes")), "depth", "pairs", "nodes")
    monkeypatch.setattr(graph, "reach_bits", None)  # whose hops shuffle a row of bits for each edge
    for most in (cones.BYTES, 1000):  # whole blocks, and blocks halved to 64 seeds
        monkeypatch.setattr(cones, "BYTES", most)
        assert values(capability.exercise_counts(e, seeds, member, 4), "seed", "capability", "direct", "transitive") == wanted
        assert values(capability.depth_distribution(e, seeds, 4), "depth", "pairs", "nodes") == depths
    assert capability.exercise_counts(e.limit(0), seeds, member, 4).count() == capability.depth_distribution(e, seeds.limit(0), 4).count() == 0
    assert capability.depth_distribution(e.limit(0), seeds, 4).count() == 0


def test_blocks_halve_where_they_take_much_memory_and_ones_count_bits(spark, monkeypatch):
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 4, 100, 257):
        bits = rng.integers(0, 1 << 63, (3, n), dtype=np.uint64)
        assert cones.ones(bits).tolist() == [sum(int(x) >> b & 1 for x in w) for w in bits for b in range(64)]
    e = spark.createDataFrame([(a, b) for a in range(300) for b in (a + 1, a + 300)], "node long, member long")
    table = cones.Lists(list(cones.lists(e).inputFiles()))
    for most, sizes in ((cones.BYTES, [300]), (1000, [64, 64, 64, 64, 44])):
        assert [len(part) for part, _ in cones._walk(table, np.arange(300), 3, most)] == sizes
    whole = cones._next(table, (np.arange(300), np.ones((2, 300), np.uint64)), np.inf)
    assert whole[0].tolist() == list(range(1, 600)) and cones._next(table, (np.arange(300), np.ones((2, 300), np.uint64)), 9000) is None  # 599 nodes of 16 bytes
    monkeypatch.setattr(cones, "READ", 7)
    parts = cones._next(table, (np.arange(300), np.ones((2, 300), np.uint64)), np.inf)
    assert all((x == y).all() for x, y in zip(whole, parts))
