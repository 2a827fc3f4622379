import glob
import os
import random

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quillgraph.llm import linededup, mixing, queries

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def _run(con, sql):
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    order = sorted(cols)
    return order, sorted([tuple(repr(r[cols.index(c)]) for c in order) for r in rel.fetchall()])


@needs_data
@pytest.mark.parametrize("name", ["op4_mix_sources", "op8_line_dedup"])
def test_native_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    order, want = _run(con, queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == order
    assert sorted(tuple(repr(r[c]) for c in order) for r in df.collect()) == want


LICENSE = "Released under the terms of licence number {} today."


def _line_docs():
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    prose = ["\n".join(" ".join(word() for _ in range(r.randint(6, 14))) for _ in range(2)) for _ in range(36)]
    docs = [(i, f"{t}\n{LICENSE.format(i)}" if i % 2 else t) for i, t in enumerate(prose)]
    copy = "an opening line that copies share\na middle line that copies share\na closing line that copies share"
    return docs + [(100 + i, copy) for i in range(8)] + [(200, None), (201, ""), (202, "\n\n"), (203, "x" * 50_000)] + [(300 + i, f"{copy}\nchanged {chr(97 + i)} word") for i in range(8)]


def test_lines_with_variable_fields_go_and_clean_and_copied_lines_stay(spark):
    docs = _line_docs()
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in docs], "doc_id long, text string, kept string, n_lines_ int")
    out = linededup.drop_recurring_lines(df)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    for r in out.collect():
        t = dict(docs)[r.doc_id]
        want = None if t is None else "\n".join(x for x in t.split("\n") if not x.startswith("Released"))
        assert r.text == want and r.n_dropped == (0 if t is None else t.count("Released")) and r.n_lines == (0 if t is None else t.count("\n") + 1)


def test_leaf_generalises_fields_without_digits(spark):
    docs = [(i, f"{'xyzuvw'[i % 6] * (i + 2)} own words {'abcdefghij'[i]} go on for {'long ' * (i + 3)}{'pqrst'[i % 5] * (i + 1)}\nWelcome to the page of user {'abcdefghij'[i]} who wrote all of this text here") for i in range(10)]
    out = linededup.op8(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r.n_dropped == 1 and "Welcome" not in r.text for r in out)


def test_long_passages_recur_in_different_texts_and_not_in_near_copies(spark):
    r = random.Random(4)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))
    passage, pair, copied = prose(60), prose(55), [prose(60) for _ in range(3)]
    docs = [(i, f"{prose(20)}\n{passage}\n{prose(20)}") for i in range(10)]
    docs += [(20 + i, f"{prose(90)}\n{pair}") for i in range(2)]
    docs += [(30 + i, "\n".join([*copied, f"{copied[0][:150]} {prose(2)}"])) for i in range(7)]
    want = {i: "\n".join(x for x in t.split("\n") if x not in (passage, pair)) for i, t in docs}
    out = linededup.op8(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in out} == want


def test_line_dedup_empty(spark):
    assert linededup.op8(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_raking_reaches_the_margins_and_the_weights_keep_them(spark):
    docs = [(i, "word " * (1 + i % 7) + "." * (i % 3), f"s{i % 3 if i % 5 else 0}", ["en", "de"][i % 7 == 0]) for i in range(900)] + [(5000, None, None, None), (5001, "a b", None, "en")]
    df = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, source string, lang string, weight double")
    rows = mixing.mix(df.withColumnRenamed("weight", "w"), rounds=30).collect()
    assert len(rows) == len(docs)
    share, total = {}, sum(r.n_tokens for r in rows)
    for r in rows:
        share.setdefault(r.source or "", [0, 0.0])
        share[r.source or ""][0] += r.n_tokens
        share[r.source or ""][1] += r.n_tokens * r.prob * r.weight
    norm = sum((t / total) ** 0.7 for t, _ in share.values())
    for t, w in share.values():
        assert w == pytest.approx((t / total) ** 0.7 / norm * total * 0.5, rel=0.02)
    assert all(0 < r.prob <= 1 and r.weight >= 1 for r in rows)
    assert next(r for r in rows if r.doc_id == 5000).sampled
    drawn = sum(r.n_tokens * r.weight for r in rows if r.sampled)
    assert drawn == pytest.approx(total * 0.5, rel=0.2)
    assert mixing.mix(df.withColumnRenamed("weight", "w").limit(0)).collect() == []


def test_names_may_clash(spark):
    df = spark.createDataFrame([(1, "a b c.", "s", "en", 3, 0.1, "t")], "doc_id long, text string, source string, lang string, n_tokens int, rate double, topic string")
    assert mixing.mix(df).count() == 1
    assert linededup.drop_recurring_lines(df.withColumnRenamed("topic", "h")).count() == 1


@needs_data
def test_pipeline_stages_keep_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, frame = [docs.count()], docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert frame.columns == docs.columns
        sizes.append(frame.count())
    assert len(corpus_pipeline.STAGES) == 5 and sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect()) == sorted(r.doc_id for r in frame.collect())


@needs_data
def test_pipeline_on_empty_documents(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0 if t == "documents" else 40).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_queries_are_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_a_leaf_holds_several_templates_and_one_text_makes_none(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 8)))
    first = lambda: f"Posted by user {word()} in the forum about old ships"
    second = lambda: f"Posted by user {word()} and shared with all good friends"
    prose = lambda: " ".join(word() for _ in range(30))
    docs = [(i, f"{prose()}\n{[first, second][i % 2]()}\n{prose()}") for i in range(12)]
    alone = "\n".join(f"Item of list {word()} has a price of many coins" for _ in range(9))
    docs.append((50, f"{prose()}\n{alone}"))
    out = {x.doc_id: x for x in linededup.op8(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i].n_dropped == 1 and "Posted" not in out[i].text for i in range(12))
    assert out[50].text == docs[-1][1] and out[50].n_dropped == 0


def test_boilerplate_in_short_texts_goes_though_most_of_their_words_are_in_it(spark):
    r = random.Random(8)
    prose = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(3, 7))) for _ in range(n))
    line = prose(60)
    own = [prose(40) for _ in range(10)]
    out = linededup.op8(spark.createDataFrame([(i, f"{t}\n{line}") for i, t in enumerate(own)], "doc_id long, text string")).collect()
    assert {x.doc_id: x.text for x in out} == dict(enumerate(own))


def test_stage_names_may_clash(spark):
    line = "this line recurs in every text of the table"
    rows = [(i, f"own words of {'abcdefgh'[i] * 6} here\n{line}", "s", "en", 1, 2, 3, 0.5, "t", 0.1, True, 7) for i in range(8)]
    names = "doc_id long, text string, source string, lang string, n_lines int, n_dropped int, n_tokens int, weight double, topic string, prob double, sampled boolean, h int"
    df = spark.createDataFrame(rows, names)
    lines = corpus_pipeline.line_dedup(spark, df, SF)
    assert lines.columns == df.columns and all(line not in x.text and x.n_lines == 1 for x in lines.collect())
    mixed = corpus_pipeline.mixing_sources(spark, df, SF)
    assert mixed.columns == [*df.columns, "n_tokens", "weight"] and {x[6] for x in mixed.collect()} <= {3}
    kept = corpus_pipeline.ngram_join(spark, df, SF)
    assert kept.columns == df.columns and kept.count() == 8


def test_scratch_tables_have_no_marker_file(spark):
    import os

    from quillgraph.session import materialize

    df = materialize(spark.range(3), "marker")
    assert df.count() == 3 and not [x for x in os.listdir(df._quill_path.removeprefix("file:")) if "SUCCESS" in x]
