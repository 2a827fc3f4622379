import json

import pytest
from pyspark.sql import functions as F

from quillgraph.operators.models import HashEmbedder, embed_rows
from quillgraph.sources import artifacts, sinks
from quillgraph.streaming.embedding_sync import stream_sync

XML = """<doxygen><compounddef id="classA" kind="class"><compoundname>A</compoundname><basecompoundref refid="classB">B</basecompoundref>
<sectiondef><memberdef kind="function" id="classA_1a0123456789abcdef0123456789abcdef0"><name>run</name><definition>void A::run</definition><argsstring>(int x)</argsstring>
<briefdescription><para>Runs <ref refid="classC" kindref="compound">C</ref> now.</para></briefdescription>
<detaileddescription><para>More.<parameterlist kind="param"><parameteritem><parameternamelist><parametername>x</parametername></parameternamelist><parameterdescription><para>steps</para></parameterdescription></parameteritem></parameterlist>
<simplesect kind="return"><para>nothing</para></simplesect></para></detaileddescription><references refid="f_1b">f</references>
<location file="a.cc" line="3" bodyfile="a.cc" bodystart="3" bodyend="-1"/></memberdef><memberdef kind="friend" id="classA_1aff"><name>x</name></memberdef></sectiondef>
<briefdescription/><detaileddescription/><location file="a.hh" line="1"/>
<programlisting><codeline lineno="1"/><codeline lineno="2" refid="own"><ref refid="r1">x</ref></codeline><codeline lineno="3"><ref refid="r2">y</ref></codeline></programlisting></compounddef></doxygen>"""


def test_xml(spark, tmp_path):
    (tmp_path / "classA.xml").write_text(XML)
    (tmp_path / "index.xml").write_text("<doxygenindex/>")
    rows = {r.name: r for r in artifacts.read_xml_entities(spark, str(tmp_path)).collect()}
    assert set(rows) == {"A", "run"}
    run = rows["run"]
    assert run.member == "a0123456789abcdef0123456789abcdef0" and run.brief == "Runs C now." and run.params == {"x": "steps"} and run.returns == "nothing"
    assert (run.body_start, run.body_end) == (3, 3) and {(x.tag, x.refid) for x in run.refs} == {("ref", "classC"), ("references", "f_1b")}
    assert rows["A"].body_start is None and [x.tag for x in rows["A"].refs] == ["basecompoundref"]
    lines = {r.line: r.owner for r in artifacts.read_code_lines(spark, str(tmp_path)).collect()}
    assert lines == {1: None, 2: "own", 3: "own"}
    assert {r.path: r.n for r in artifacts.structure_profile(spark, str(tmp_path)).collect()}["/doxygen/compounddef/programlisting/codeline"] == 3


def test_documents_and_capabilities(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "classA.json").write_text(json.dumps({"run(int)": {"brief": "b", "params": {"x": "y"}, "state": None}, "stop()": {"brief": "c", "state": "refined_summary"}}))
    (docs / "bad.json").write_text("not json")
    rows = {r.signature: r for r in artifacts.read_documents(spark, str(docs)).collect()}
    assert rows["run(int)"].state == "extracted_summary" and rows["stop()"].state == "refined_summary" and rows["run(int)"].compound == "classA"
    (tmp_path / "caps.json").write_text(json.dumps({"combat": {"type": "domain", "desc": "d", "functions": ["f"]}}))
    assert artifacts.read_capability_definitions(spark, f"{tmp_path}/caps.json").first().description == "d"
    (tmp_path / "g.json").write_text(json.dumps({"dependencies": {"a": {"b": {"call_count": 3, "edge_type": "requires_core", "in_dag": True}}}, "entry_points": {"do_x": {"type": "command", "capabilities": ["a"], "earliest_wave": 1}}}))
    deps, points = artifacts.read_capability_graph(spark, f"{tmp_path}/g.json")
    assert deps.first().call_count == 3 and points.first().capabilities == ["a"]


def test_text_artifacts(spark, tmp_path):
    (tmp_path / "g.gml").write_text('graph [\n node [\n id 0\n label "a"\n name "A [x]"\n kind "class"\n ]\n node [\n id 1\n label "b"\n ]\n edge [\n source 0\n target 1\n key "calls"\n ]\n]\n')
    nodes, edges = artifacts.read_gml(spark, f"{tmp_path}/g.gml")
    assert [(r.label, r.name) for r in nodes.orderBy("id").collect()] == [("a", "A [x]"), ("b", None)] and tuple(edges.first()) == ("a", "b", "calls")
    (tmp_path / "c.md").write_text("---\nid: combat\nname: 'Combat'\ndepends_on: [a, b]\ndepended_on_by:\n  - x\n  - y\n---\n# Text\n")
    (tmp_path / "n.md").write_text("no front matter")
    (c,) = artifacts.read_components(spark, str(tmp_path)).collect()
    assert (c.id, c.name, c.depends_on, c.depended_on_by, c.text) == ("combat", "Combat", ["a", "b"], ["x", "y"], "# Text\n")
    (tmp_path / "help.json").write_text(json.dumps([{"keywords": "KILL", "category": "c", "level": 1, "text": "{RFight{x on"}]))
    h = artifacts.read_help_entries(spark, f"{tmp_path}/help.json").first()
    assert h.text == "Fight on" and h.length == 12
    (tmp_path / "a.cc").write_text("// one\n\n/* two */\nint f()\n{\n}\n")
    lines = artifacts.source_lines(spark, f"{tmp_path}/a.cc")
    ents = spark.createDataFrame([("e", "a.cc", 4, 6)], "entity_id string, body_file string, body_start int, body_end int")
    assert artifacts.slice_source(ents, lines).first().source_text == "int f()\n{\n}"
    assert artifacts.slice_source(ents, lines, before=9, after=9).first().source_text.startswith("// one")
    with pytest.raises(Exception, match="bad range"):
        artifacts.slice_source(ents.withColumn("body_start", F.lit(9)), lines).collect()
    assert artifacts.preceding_comments(lines, spark.createDataFrame([("a.cc", 4)], "file string, line int")).first().comment == "// one\n/* two */"
    artifacts.check_files(spark, str(tmp_path), ["a.cc"])
    with pytest.raises(FileNotFoundError):
        artifacts.check_files(spark, str(tmp_path), ["none.json"])


def test_ids_and_replies(spark):
    L = F.lit
    r = spark.range(1).select(
        artifacts.split_entity_id(L("classA_a0123456789abcdef0123456789abcdef0")).alias("m"), artifacts.split_entity_id(L("file_8cc")).alias("c"), artifacts.split_location(L("a.cc:3:7")).alias("l"),
        artifacts.reply_object(L('Sure:\n```json\n{"a": 1}\n```'), "a int").alias("j"), artifacts.reply_lines(L("f: does x: y\nnone")).alias("t"),
    ).first()
    assert r.m.compound == "classA" and r.m.member.startswith("a01") and r.c.member is None and (r.l.file, r.l.line, r.l.column) == ("a.cc", 3, 7)
    assert r.j.a == 1 and r.t == {"f": "does x: y"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "compound string, n int, note string")
    sinks.upsert_documents(df, f"{tmp_path}/docs")
    sinks.upsert_documents(df.where("compound = 'a'").withColumn("n", F.lit(9)), f"{tmp_path}/docs")
    assert {r.compound: r.n for r in spark.read.parquet(f"{tmp_path}/docs").collect()} == {"a": 9, "b": 2}
    vec = spark.createDataFrame([("k", [1.0])], "key string, vector array<double>")
    sinks.write_embedding_cache(vec, f"{tmp_path}/cache", "m-1", 1, "doc")
    sinks.write_embedding_cache(vec, f"{tmp_path}/cache", "m-1", 1, "symbol")
    assert spark.read.parquet(f"{tmp_path}/cache").count() == 2
    with pytest.raises(ValueError):
        sinks.write_embedding_cache(vec, f"{tmp_path}/cache", "m 1", 1, "doc")
    assert json.loads(sinks.json_lines(df).first().value) == {"compound": "a", "n": 1, "note": None}
    assert sinks.markdown_list(df, "compound", F.col("n").cast("string"), ["n"]).orderBy("compound").first().text == "## a\n\n- 1"
    L = F.lit
    block = spark.range(1).select(sinks.comment_block(L("f()"), L("does"), L(""), F.create_map(L("x"), L("in")), L("r"), L(None).cast("string")).alias("b")).first().b
    assert block.startswith("/**\n * @fn f()\n * @brief does\n") and block.endswith(" */") and "@param x in" in block


def test_stream_embeds_each_text_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    cache = f"{tmp_path}/cache"

    def put(n, rows):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(json.dumps({"key": k, "text": t}) for k, t in rows))

    def run():
        texts = spark.readStream.schema("key string, text string").json(f"{tmp_path}/in")
        stream_sync(texts, cache, lambda rows: embed_rows(rows, lambda: HashEmbedder(4), 4), f"{tmp_path}/ck", availableNow=True).awaitTermination(120)

    put(1, [("a", "x"), ("b", "y"), ("a", "x")])
    run()
    put(2, [("a", "x"), ("b", "changed"), ("c", "z")])
    run()
    got = spark.read.parquet(cache).groupBy("key").count().collect()
    assert {r.key: r["count"] for r in got} == {"a": 1, "b": 2, "c": 1}
