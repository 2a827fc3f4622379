"""The multigraph build, code bodies, evaluation candidates and subsystem reports."""

import pytest

from quillgraph.operators import cluster, evaluate, graph, retrieval
from quillgraph.sources import artifacts
from tests.fixtures import entities


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


ENTITIES = "node string, name string, kind string, type string"
PLACES = "node string, role string, location string"


def test_multigraph_has_locations_and_one_node_a_member(spark):
    e = spark.createDataFrame(
        [("c", "C", "class", "compound"), ("m", "f()", "function", "member"), ("m", "f()", "function", "member"), ("x", "F", "friend", "member")], ENTITIES
    )
    places = spark.createDataFrame([("c", "file", "a.h:3"), ("m", "decl", "a.h:3"), ("m", "body", "a.cc:9"), ("x", "body", "z:1"), ("c", "file", "b.h:1")], PLACES)
    refs = spark.createDataFrame([("m", "m", "references"), ("m", "gone", "references")], "src string, dst string, tag string")
    nodes, links = graph.build_multigraph(e, refs, places)
    assert rows(nodes, "node", "type") == {("c", "compound"), ("m", "member"), ("a.h:3", "decl"), ("a.cc:9", "body"), ("b.h:1", "file")}
    assert rows(links, "src", "dst", "relationship") == {
        ("m", "m", "calls"), ("a.h:3", "c", "represented_by"), ("a.h:3", "m", "represented_by"), ("a.cc:9", "m", "represented_by"), ("b.h:1", "c", "represented_by")
    }
    with pytest.raises(Exception, match="decl and body"):
        graph.build_multigraph(e, refs, spark.createDataFrame([("m", "decl", "a:1"), ("m", "body", "a:1")], PLACES))[0].collect()
    with pytest.raises(Exception, match="differing"):
        graph.build_multigraph(e.union(spark.createDataFrame([("m", "g()", "function", "member")], ENTITIES)), refs, places)[0].collect()


def test_code_bodies(spark):
    lines = spark.createDataFrame([("a", i, f"l{i}") for i in range(1, 30)], "file string, line int, text string")
    e = spark.createDataFrame([("s", "struct"), ("f", "function"), ("g", "group"), ("n", "namespace"), ("h", "function")], "node string, kind string")
    at = spark.createDataFrame(
        [("s", "body", "a", 5, 8), ("s", "file", "a", 6, None), ("f", "body", "a", 20, None), ("n", "body", "a", 1, 2), ("f", "file", "a", 21, None)],
        "node string, role string, file string, line int, end_line int",
    )
    inside = spark.createDataFrame([("s", "g", "contained_by"), ("f", "g", "contained_by")], "src string, dst string, relationship string")
    assert rows(graph.code_bodies(e, at, inside, lines), "node", "loc", "code") == {
        ("s", "a:6-8", "l6\nl7\nl8\n"), ("f", "a:20-20", "l20\n"), ("g", "a:6-20", "l6\nl7\nl8\nl20\n")
    }


def test_neighbours_and_candidates(spark):
    links = spark.createDataFrame(
        [("a", "s", "calls"), ("s", "a", "calls"), ("s", "b", "calls"), ("s", "box", "contained_by"), ("in", "s", "contained_by"), ("s", "unknown", "calls")],
        "src string, dst string, relationship string",
    )
    known = spark.createDataFrame([(x,) for x in ("a", "b", "s", "box", "in")], "node string")
    near = graph.seed_neighbours(links, spark.createDataFrame([("s",)], "seed string"), known)
    assert rows(near, "node", "relation") == {("a", "caller"), ("b", "callee"), ("box", "container"), ("in", "containee")}
    hits = spark.createDataFrame([("q", "s", 0.9), ("q", "b", 0.5)], "query string, id string, score double")
    more = spark.createDataFrame([("q", "s", 1.0), ("q", "in", 0.2)], "query string, id string, score double")
    found = evaluate.channel_candidates([("doc", hits), ("symbol", more)], "text", per_channel=2)
    assert rows(found, "id", "channel", "ord") == {("s", "doc", 1), ("b", "doc", 2), ("in", "symbol", 3)}
    assert rows(evaluate.graph_candidates(links, found, known, seeds=2), "id", "seed", "relation") == {("a", "s", "caller"), ("box", "s", "container"), ("in", "s", "containee")}
    defined = spark.createDataFrame([("q",), ("r",)], "query string")
    assert [list(r.expected_ids) for r in evaluate.expected_ids(defined, spark.createDataFrame([("q", ["s"])], "query string, expected_ids array<string>")).orderBy("query").collect()] == [["s"], []]


def test_block_scores_equal_plain_cosines(spark):
    v = spark.createDataFrame([(i, [float(i % 3), 1.0, float(i % 5)]) for i in range(20)], "id long, embedding array<double>")
    q = v.where("id % 5 = 0").selectExpr("id as query", "embedding as q", "0 as category")
    one, many = (evaluate.score_blocks(v, q, block=b) for b in (100, 1))
    assert one.count() == 80 and rows(one, "id", "query", "score") == rows(many, "id", "query", "score")


def test_entity_texts_and_summaries(spark):
    docs = spark.createDataFrame([("a", "Hits.", None, "why", ""), ("b", None, "", None, None)], "node string, brief string, details string, rationale string, returns string")
    assert [r.node for r in cluster.entity_texts(docs).collect()] == ["a"] and "rationale" in cluster.entity_texts(docs).first().text.lower()
    e = spark.createDataFrame([("a", "function", "hit", "void hit()", "Hits.", ""), ("b", None, "x", "x", None, None)], "node string, kind string, name string, signature string, brief string, details string")
    calls = spark.createDataFrame([("a", "z"), ("a", "c")], "node string, caller string")
    assert rows(cluster.entity_summaries(e, calls), "node", "summary") == {
        ("a", "[function] hit | Signature: void hit() | Brief: Hits. | Called by: c | Called by: z"), ("b", "[unknown] x")
    }


def test_cluster_analysis_and_documents(spark):
    member = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, cluster int")
    names = spark.createDataFrame([("a", "socket_parser", "function"), ("b", "socket_parser", "function"), ("c", "x", "class")], "node string, name string, kind string")
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string")
    got = {r.cluster: r for r in cluster.analyse_clusters(member, names, links).collect()}
    assert (got[1].name, got[1].classification, got[1].dominant_type, got[1].entity_count, got[1].internal_connectivity) == ("Parser", "Interface", "function", 2, 0.5)
    assert (got[2].name, got[2].classification) == ("Core class", "Core")
    counts = cluster.class_counts(cluster.analyse_clusters(member, names, links))
    assert rows(counts, "classification", "subsystems", "entities") == {("Interface", 1, 2), ("Core", 1, 1)}
    picked = cluster.document_entities(member, spark.createDataFrame([(1, "b")], "cluster int, node string"), most=2)
    assert rows(picked, "node", "role") == {("b", "key"), ("a", "sample"), ("c", "sample")}
    dist = cluster.group_distribution(spark.createDataFrame([("g", 1.0), ("g", 3.0)], "grp string, x double"), "grp", ["x"])
    assert rows(dist, "statistic", "value") == {("mean", 2.0), ("p25", 1.5), ("p50", 2.0), ("p75", 2.5)}


def test_resolver_ends_with_vectors(spark):
    e = entities(spark).selectExpr("*", "array(1.0D, case when name like 'a%' then 1.0D else 0.0D end) as v")
    got = retrieval.resolve(e, "zzz", vector="v", embedded=[1.0, 1.0], limit=2).collect()
    assert {r.match_type for r in got} == {"semantic"} and {r.status for r in got} == {"ambiguous"}


def test_comment_blocks(spark):
    source = ["int a; /* tail", "of it */", "int b;", "/* one", " two */", "// three", "int c;", "int d; /* x */", "int e;"]
    lines = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(source)], "file string, line int, text string")
    wanted = lines.where("line in (3, 7, 9)").select("file", "line")
    assert rows(artifacts.preceding_comments(lines, wanted), "line", "comment") == {(7, "/* one\n two */\n// three")}
