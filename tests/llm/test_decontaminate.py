import re

from quillgraph.llm import decontaminate as d

LOW = {c: c + 32 for c in range(65, 91)}
RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return RULE.findall((t or "").translate(LOW))


def brute(docs, items, width=10):
    out = {}
    for i, t in docs:
        w, hit, names = words(t), set(), set()
        for k, it in items:
            q = words(it)
            for s in range(max(1, len(q) - width + 1)) if q else ():
                win = q[s : s + width]
                for p in range(len(w) - len(win) + 1):
                    if w[p : p + len(win)] == win:
                        hit.update(range(p, p + len(win)))
                        names.add(str(k))
        out[i] = (len(w), len(hit), sorted(names))
    return out


BASE = "Zero one, TWO three-four five six seven eight nine ten eleven twelve"
ITEMS = [(1, BASE), (2, "short É item"), (3, None), (4, "..."), (10, BASE), (5, "word")]
DOCS = [
    (0, "xx " + BASE.upper() + " yy short; É ITEM"), (1, None), (2, ""), (3, "zero one two three four five six seven eight"),
    (4, "one two three four five six seven eight nine ten"), (5, "a word, a sword, a word"), (6, "short É item short É item"), (7, "x" * 50_000 + " word " * 2000),
]


def test_equals_brute_force(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    want = brute(DOCS, ITEMS)
    for block in (8 << 20, 40):  # one automaton, and one for each item
        got = {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids)) for r in d.find_contamination(docs, items, block_bytes=block).collect()}
        assert got == want


def test_spans_lie_in_the_original(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    spans = {r.doc_id: [DOCS[r.doc_id][1][s.start : s.end] for s in r.hit_spans] for r in d.find_contamination(docs, items).collect()}
    assert spans[0] == [BASE.upper(), "short; É ITEM"]
    assert spans[6] == ["short É item short É item"]


def test_drop_keeps_clean_rows_and_their_columns(spark):
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in DOCS], "doc_id long, text string, spans string, items int")
    items = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    kept = d.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 5, 7]


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(DOCS[:2], "doc_id long, text string")
    assert [r.contaminated for r in d.op10(docs, none).collect()] == [False, False]
    assert d.op10(docs.limit(0), none).collect() == []


def test_the_last_scan_returns_no_texts_and_the_reader_keeps_to_the_batches(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("x", "a b")], "item_id string, text string")
    found = d.find_contamination(docs, items)
    scan = next(x for x in found._jdf.queryExecution().analyzed().toString().splitlines() if "MapInArrow" in x)
    assert "text#" not in scan[scan.rindex("[") :]
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000
    assert [tuple(r)[:3] for r in found.collect()] == [(1, 3, 2)]
