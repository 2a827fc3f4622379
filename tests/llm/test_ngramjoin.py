import random
import re

import pytest

from quillgraph.llm import ngramjoin

LOW = {c: c + 32 for c in range(65, 91)}


def sets(docs, size):
    out = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    return out


def brute(docs, size, num, den):
    s = sets(docs, size)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(s)
    for a in ids:
        for b in ids:
            if a < b and s[a] and s[b] and den * len(s[a] & s[b]) >= num * len(s[a] | s[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s[i]), find(i)) for i in ids}


def corpus(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(60)]
    passage = [r.choice(vocab) for _ in range(60)]
    docs, n = [], 0
    for _ in range(12):  # chains of edits, copies and shared passages
        base = [r.choice(vocab) for _ in range(r.randint(5, 90))]
        for _ in range(r.randint(1, 9)):
            if r.random() < 0.8 and base:
                base[r.randrange(len(base))] = r.choice(vocab)
            docs.append((n, " ".join(base + (passage if r.random() < 0.3 else []))))
            n += 1
    docs += [(n, None), (n + 1, ""), (n + 2, "one two"), (n + 3, "One TWO"), (n + 4, " \t\n"), (n + 5, docs[0][1]), (n + 6, docs[0][1])]
    return docs


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force(spark, seed):
    docs = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.op7(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs, 4, 85, 100)


def test_small_parts_and_a_short_order_lose_no_link(spark):
    docs = corpus(9)
    rows = ngramjoin.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), size=5, num=80, den=100, part=2, hot_from=3, max_hot=5, k=1)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == brute(docs, 5, 80, 100)


def test_bitmaps_never_underrate():
    import numpy as np

    r = np.random.default_rng(0)
    for _ in range(300):
        a = np.unique(r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))
        b = np.unique(np.concatenate((r.choice(a, len(a) // 2), r.integers(0, 2**63, r.integers(1, 400)).astype(np.uint64))))
        bits = lambda x: np.frombuffer(ngramjoin._bitmap(x), np.uint8)
        assert ngramjoin._most_shared(len(a), bits(a), bits(b)) >= len(np.intersect1d(a, b))


def test_empty_null_ids_and_repeated_rows(spark):
    assert ngramjoin.op7(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = ngramjoin.op7(spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in rows) == [(False, 5, 5), (False, 5, 5), (False, 7, 5), (True, 0, None)]


def test_representatives_keep_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus(3)], "doc_id long, text string, sh string, n int")
    kept = ngramjoin.keep_representatives(docs)
    want = brute(corpus(3), 5, 80, 100)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if c == i)


def test_small_sets_link_by_fewer_tokens_than_the_usual_number(spark):
    docs = [(0, "a b c d e f g"), (1, "a b c d e f"), (2, "b c d e f g"), (3, "x y z u v w q r"), (4, "x y z u v w q"), (5, "a x b y")]
    rows = ngramjoin.link_documents(spark.createDataFrame(docs, "doc_id long, text string"), size=4, num=60, den=100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == brute(docs, 4, 60, 100)


def test_hot_keys_join_like_others(spark):
    rows = spark.createDataFrame([(i, i % 3 if i < 60 else i) for i in range(100)], "id long, key long")
    small = rows.groupBy("key").count().selectExpr("key", "count as copies", "key * 10 as x").where("copies > 1 or key = 77")
    for least, most in ((1000, 10), (5, 10), (1, 2)):
        got = sorted((r.id, r.key, r.x) for r in ngramjoin._split_join(rows, small, ["key"], "copies", least, most).collect())
        assert got == sorted((i, k, 10 * k) for i, k in [(i, i % 3 if i < 60 else i) for i in range(100)] if k < 3 or k == 77)


def test_repeated_rows_and_long_texts_at_the_stage(spark):
    long_text = " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000))
    docs = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "quite another text of more words"), (2, long_text), (3, long_text + " end"), (None, "q"), (None, "q"), (4, None)]
    kept = ngramjoin.keep_representatives(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, (r.text or "")[:5]) for r in kept) == [(-1, "q"), (-1, "q"), (1, "one t"), (1, "quite"), (2, "w0x0 "), (4, "")]
