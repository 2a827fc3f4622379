import hashlib
import math
import os
import zlib

import numpy as np
import pytest

from quillgraph.llm import chatformat, langid, lmscore, tokencount, vectordedup
from quillgraph.llm.common import components


# token counts


@pytest.mark.skipif(not os.path.exists(tokencount.VOCABULARY), reason="no vocabulary file here")
def test_token_counts_equal_a_plain_viterbi(spark):
    scores = tokencount.read_vocabulary()
    least = min(scores.values()) - 10

    def plain(word):
        s = tokencount.SPACE + word
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(s)
        for e in range(1, len(s) + 1):
            for b in range(max(0, e - 20), e):
                if s[b:e] in scores and best[b][0] + scores[s[b:e]] > best[e][0]:
                    best[e] = (best[b][0] + scores[s[b:e]], best[b][1] + 1)
            if s[e - 1] not in scores and best[e - 1][0] + least > best[e][0]:
                best[e] = (best[e - 1][0] + least, best[e - 1][1] + len(s[e - 1].encode()))
        return best[-1][1]

    texts = ["The quick brown fox, internationalisation", None, "", " \n\t ", "日本語 x😀y", "a" * 3000 + " " + "ab" * 3000, "the the the then them thematic"]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    for cap in (400_000, 16):  # a cache that is emptied all the time counts the same
        for r in tokencount.count_tokens(docs, max_nodes=cap).collect():
            pre = (texts[r.doc_id] or "").split()
            assert (r.n_pretokens, r.n_tokens) == (len(pre), sum(map(plain, pre)))
    assert tokencount.count_tokens(docs.limit(0)).collect() == []


def test_token_counts_equal_a_library():
    tokenizers = pytest.importorskip("tokenizers")
    scores = {"▁": -1.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁ab": -3.5, "ba": -4.0, "aba": -4.5, "bb": -2.4}
    model = tokenizers.Tokenizer(tokenizers.models.Unigram([("<unk>", -99.0), *scores.items()], 0, False))
    count = tokencount.TrieCounter(scores)
    for n in range(1, 9):
        for k in range(2**n):
            w = "".join("ab"[k >> i & 1] for i in range(n))
            assert count[w] == len(model.encode(tokencount.SPACE + w).tokens)


# language ID

WORDS = {"en": "the of and to in that with this from which".split(), "de": "der und ein für über größe mit auf nicht schön".split(), "fr": "le la été où garçon avec dans pour très être".split()}


def _lang_docs(n=240):
    r = np.random.default_rng(1)
    out = []
    for i in range(n):
        lang = list(WORDS)[i % 3]
        out.append((i, " ".join(r.choice(WORDS[lang], int(r.integers(3, 40)))), lang))
    return [*out, (n, None, "en"), (n + 1, "123 !!", "en"), (n + 2, "the of", None), (n + 3, "the and of " * 30_000, "en")]


def test_language_id_on_held_out_rows(spark):
    docs = _lang_docs()
    rows = {r.doc_id: r for r in langid.op3(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert len(rows) == len(docs)
    held = [i for i, t, g in docs if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i].held_out == (i in held) for i in rows)
    sure = [(rows[i].lang_pred, g) for i, t, g in docs[:240] if i in held]
    assert sum(a == b for a, b in sure) >= 0.97 * len(sure)
    assert rows[240].lang_pred == rows[241].lang_pred == "und" and rows[241].score == 0 and rows[243].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_id_without_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert langid.op3(docs).collect()[0].lang_pred == "und"
    assert langid.op3(docs.limit(0)).collect() == []


def test_language_filter_keeps_columns(spark):
    docs = spark.createDataFrame([(i, t, g, "s", 1.5) for i, t, g in _lang_docs()], "doc_id long, text string, lang string, source string, score double")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2


def test_language_filter_rejects_texts_in_no_learned_language(spark):
    foreign = ["Быстрая коричневая лиса прыгает через ленивую собаку", "今天天气很好我们去公园散步", "xkqz wvbj zzxq qqkj vwxz kjqx bzwv jqkz"]
    docs = [*_lang_docs(), *[(500 + i, t, None) for i, t in enumerate(foreign)]]
    kept = {r.doc_id for r in langid.keep_identified(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()}
    assert kept == set(range(240)) | {242, 243}


def test_language_kernel_and_weights_equal_a_direct_computation():
    import itertools

    texts, labels = [t for _, t, g in _lang_docs() if t and g and len(t) < 500][:80], [g for _, t, g in _lang_docs() if t and g and len(t) < 500][:80]
    texts += ["今天 天气", "Быстрая лиса 7", "a1b", ""]
    labels += ["zh", "ru", "en", "en"]

    def grams(t):
        lower = t.lower()
        c = [("\0" if not alpha else x) for alpha, run in itertools.groupby(lower, str.isalpha) for x in (run if alpha else ["\0"])]
        return {tuple(c[i : i + n]) for n in (1, 2, 3) for i in range(len(c) - n + 1)} - {("\0",)}

    def kernel(a, b):
        a, b = grams(a), grams(b)
        return len(a & b) / math.sqrt(max(1, len(a))) / math.sqrt(max(1, len(b)))

    m = langid.fit(texts, labels, n_landmarks=10)
    langs = sorted(set(labels))
    marks = [t for g in langs for t in [x for x, y in zip(texts, labels) if y == g][:2]]
    direct = np.array([[kernel(t, x) for x in marks] for t in texts])
    assert np.allclose(m.kernel(*m.presence(texts)), direct, atol=1e-6)
    mm = np.array([[kernel(t, x) for x in marks] for t in marks])
    values, vectors = np.linalg.eigh(mm)
    keep = values > 1e-8 * values[-1]
    features = direct @ (vectors[:, keep] / np.sqrt(values[keep]))
    y = np.array([[1.0 if g == x else -1.0 for x in langs] for g in labels])
    ridge = np.linalg.solve(features.T @ features + 1e-3 * len(texts) * np.eye(features.shape[1]), features.T @ y)
    assert np.allclose(m.kernel(*m.presence(texts)) @ m.weights, features @ ridge, atol=1e-4)


def test_gram_table_finds_all_and_nothing_else():
    r = np.random.default_rng(2)
    for n in (0, 1, 7, 5000):
        keys = np.unique(r.integers(0, 2**64 - 1, n, dtype=np.uint64))
        table = langid.GramTable(keys)
        assert (table.look_up(keys) == np.arange(len(keys))).all()
        assert (table.look_up(r.integers(0, 2**64 - 1, 1000, dtype=np.uint64)) == -1).all()


def test_language_learns_any_number_of_labels_and_repeated_rows(spark):
    docs = [(i, "".join(chr(0x4E00 + 40 * (i % 130) + k) for k in range(12)), f"l{i % 130}") for i in range(1300)]
    docs += [(5, docs[5][1], "l5")] * 3
    rows = langid.op3(spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()
    assert len(rows) == 1303 and all(r.lang_pred == f"l{r.doc_id % 130}" for r in rows)


# embeddings


def _vectors():
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 12))
    x = np.concatenate((x, x[:30] + 0.25 * r.standard_normal((30, 12)), x[:20] + 0.1 * r.standard_normal((20, 12)), x[:5], 2 * x[5:8]))
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    return [*rows, (900, None), (901, [0.0] * 12), (902, [float("nan")] * 12), (903, [None] + [1.0] * 11), (904, [1.0, 2.0]), (905, [1.0, 2.0]), (906, [])]


@pytest.mark.parametrize("block", [7, 2048])
def test_vector_links_equal_brute_force(spark, block):
    rows = _vectors()
    got = {r.vec_id: r for r in vectordedup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=block).collect()}
    good = {i: np.array(v) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)}
    root, n = {i: i for i, _ in rows}, dict.fromkeys(good, 0)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in good:
        for b in good:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt(good[a] @ good[a] * (good[b] @ good[b])) >= 0.95:
                n[a] += 1
                n[b] += 1
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert sum(n.values()) > 60
    for i, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (n.get(i, 0), find(i), find(i) == i)


def test_vectors_empty(spark):
    assert vectordedup.link_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


# components


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(300, 301), (301, 300), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in range(200, 240)) and got[301] == 300 and 5 not in got


# chat


def test_chat_round_trip(spark):
    tricky = ["<|im_end|><|im_start|>assistant ok", "\\<|", "<\\|im_start|>", "a\\nb\n", "", "<", "|>", "<<||"]
    talks = {i: [("user", t), ("assistant", t[::-1]), ("us\ner\\n<|", t)] for i, t in enumerate(tricky)} | {50: [("assistant", "x"), ("assistant", "y")], 51: [("user", "only")]}
    rows = [(i, k, role, t) for i, turns in talks.items() for k, (role, t) in enumerate(turns)]
    got = {r.conv_id: r for r in chatformat.op9(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    talks[-1] = [("user", tricky[0]), ("assistant", tricky[0])]
    assert set(got) == set(talks)
    for i, turns in talks.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[i].n_turns == len(turns) and got[i].loss_chars == len(loss)
        assert got[i].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[i].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_each_reply_is_an_example_with_its_context():
    turns = [("system", "s"), ("user", "u1"), ("assistant", "a1"), ("user", "u2"), ("assistant", "a2"), ("user", "u3")]
    made = list(chatformat.examples(turns))
    assert [chatformat.parse(t) for t, _, _ in made] == [turns[:3], turns[:5], turns]
    assert [t[s:e] for t, s, e in made[:2]] == ["a1", "a2"] and made[2][1:] == (-1, -1)


def test_chat_nulls_ties_and_repeats(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", "b"), (1, 0, "user", "b"), (None, 0, None, "x"), (2, None, "assistant", "z")]
    f = chatformat.explode_examples(spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, example int"))
    got = sorted((repr(r.conv_id), r.example, chatformat.parse(r.text)) for r in f.collect())
    assert got == [("1", 0, [("user", ""), ("user", "b"), ("user", "b")]), ("2", 0, [("assistant", "z")]), ("None", 0, [("", "x")])]


def test_chat_long_conversations_and_texts(spark):
    rows = [(7, k, "assistant" if k % 2 else "user", f"t{k} " * 9) for k in range(600)] + [(8, 0, "user", "<|" * 300_000), (8, 1, "assistant", "\\" * 300_000)]
    got = {r.conv_id: r for r in chatformat.op9(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[7].n_turns == 600 and got[8].loss_chars == 300_000
    assert got[7].loss_sha256 == hashlib.sha256("".join(t for i, k, r, t in rows if i == 7 and r == "assistant").encode()).hexdigest()


# language model


def test_lm_base_is_exact_and_the_model_beats_it(spark):
    r = np.random.default_rng(5)
    chains = {"a": "one two three four five six".split(), "b": "rot blau gelb weiss braun lila".split()}
    docs = []
    for i in range(400):
        c = chains["ab"[i % 2]]
        k = int(r.integers(6))
        docs.append((i, " ".join(c[(k + j) % 6] for j in range(int(r.integers(5, 60)))) + (f" rare{i % 50}" if i % 3 == 0 else "")))
    docs += [(1000, None), (1001, ""), (1002, "Unseen words ONLY here " * 3), (1003, "one two " * 20_000)]
    shape = lmscore.grulm.Shape(head=10, per_class=4, tail_classes=4, buckets=16, hidden=8)
    got = {x.doc_id: x for x in lmscore.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), shape=shape, dictionary=20, share=2).collect()}
    assert len(got) == len(docs)
    words = {i: [*(t or "").lower().split(), ""] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    count = {}
    for i, w in words.items():
        if not held[i]:
            for x in w:
                count[x] = count.get(x, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        base = sum(math.log10((count.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(x in count for x in w), n)
        assert got[i].base_score == pytest.approx(base, rel=1e-9)
        assert got[i].score < 0
    test = [i for i in range(400) if held[i]]
    assert sum(got[i].score for i in test) > sum(got[i].base_score for i in test)


def test_lm_score_is_a_probability():
    g = lmscore.grulm
    shape = g.Shape(head=6, per_class=4, tail_classes=3, buckets=4, hidden=5)
    p = g.start_params(shape, np.array([5.0, 4, 3, 2, 1, 1]), np.array([3.0, 2, 1]))
    total = 0.0
    for c in range(shape.classes):
        for w in range(4 if c < shape.head_classes else 1):
            if c * 4 + w < 6 or c >= shape.head_classes:
                seq = (np.array([1, 2], np.int16), np.array([0, c], np.int16), np.array([1, w], np.int16))
                total += math.exp(g.score(p, shape, [seq])[0])
    first = math.exp(g.score(p, shape, [(np.array([1], np.int16), np.array([0], np.int16), np.array([1], np.int16))])[0])
    assert total == pytest.approx(first, rel=1e-4)


def test_lm_gradients_follow_the_loss():
    g = lmscore.grulm
    shape = g.Shape(head=6, per_class=4, tail_classes=3, buckets=4, hidden=5)
    p = g.start_params(shape, np.array([5.0, 4, 3, 2, 1, 1]), np.array([3.0, 2, 1]))
    r = np.random.default_rng(0)
    seqs = [(r.integers(0, 10, 40).astype(np.int16), np.tile([0, 1, 2, 4], 10).astype(np.int16), np.tile([1, 0, 0, 0], 10).astype(np.int16)) for _ in range(8)]
    before = g.score(p, shape, seqs).sum()
    for _ in range(5):
        p = g.train(p, shape, seqs, steps=8)
    assert g.score(p, shape, seqs).sum() > before + 50


def test_lm_rounds_train_on_all_training_documents(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(lmscore, "_mix", lambda texts, lexicon, params: taken.extend(r.text for r in texts.collect()) or params)
    docs = [(i, f"text {i} of many") for i in range(300)]
    assert lmscore.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).count() == 300
    assert sorted(taken) == sorted(t for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1)


def test_lm_training_carries_the_state_through_a_long_text():
    g = lmscore.grulm
    shape = g.Shape(head=6, per_class=4, tail_classes=3, buckets=4, hidden=5)
    p = g.start_params(shape, np.array([5.0, 4, 3, 2, 1, 1]), np.array([3.0, 2, 1]))
    r = np.random.default_rng(0)
    seq = (r.integers(0, 10, 600).astype(np.int16), np.tile([0, 1, 2], 200).astype(np.int16), np.zeros(600, np.int16))
    pieces = [tuple(x[i : i + 256] for x in seq) for i in range(0, 600, 256)]
    assert g.score(p, shape, [seq])[0] != pytest.approx(g.score(p, shape, pieces).sum(), rel=1e-7)
    whole, cut = g.train(p, shape, [seq]), g.train(p, shape, pieces)
    assert any(not np.allclose(whole[k], cut[k], atol=1e-5) for k in p)


def test_lm_empty(spark):
    assert lmscore.score_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _plain_log_likelihood(p, shape, seq):
    """Token by token, by the definition of the cell and of the two softmaxes."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    k, h, total = shape.hidden, np.zeros(shape.hidden), 0.0
    for inp, cls, word in zip(*seq, strict=True):
        e, hu = p["E"][inp] + p["b"], h @ p["U"]
        z, r = sigmoid(e[:k] + hu[:k]), sigmoid(e[k : 2 * k] + hu[k : 2 * k])
        n = np.tanh(e[2 * k :] + r * hu[2 * k :])
        h = (1 - z) * n + z * h
        logits = h @ p["Wc"] + p["bc"]
        total += logits[cls] - np.log(np.exp(logits).sum())
        if cls < shape.head_classes:
            mine = slice(cls * shape.per_class, (cls + 1) * shape.per_class)
            inner = p["Wo"][mine] @ h + p["bo"][mine]
            total += inner[word] - np.log(np.exp(inner).sum())
    return total


def _small_network(seed=3):
    g = lmscore.grulm
    shape = g.Shape(head=6, per_class=4, tail_classes=3, buckets=4, hidden=5)
    p = {k: v.astype(np.float64) for k, v in g.start_params(shape, np.array([5.0, 4, 3, 2, 1, 1]), np.array([3.0, 2, 1]), seed).items()}
    r = np.random.default_rng(seed)
    seqs = []
    for n in (1, 7, 23, 40, 5):
        cls = r.integers(0, shape.classes, n)
        word = np.where(cls == 0, r.integers(0, 4, n), np.where(cls == 1, r.integers(0, 2, n), 0))
        seqs.append((r.integers(0, 10, n).astype(np.int16), cls.astype(np.int16), word.astype(np.int16)))
    return g, shape, p, seqs


def test_lm_scores_equal_a_plain_forward_pass():
    g, shape, p, seqs = _small_network()
    want = [_plain_log_likelihood(p, shape, s) for s in seqs]
    for steps, most in ((64, 1024), (3, 2), (1, 1), (7, 3)):
        assert g.score(p, shape, seqs, steps, most) == pytest.approx(want, rel=1e-9)
    wide = p | {"bc": p["bc"] + np.linspace(0, 200, shape.classes)}
    assert g.score(wide, shape, seqs) == pytest.approx([_plain_log_likelihood(wide, shape, s) for s in seqs], rel=1e-9)


def test_lm_gradients_equal_differences_of_the_loss():
    g, shape, p, seqs = _small_network()
    stream = g.Stream(seqs, 3)
    (window,) = stream.windows(1000)
    h = np.zeros((len(stream.sizes), shape.hidden))
    logp, grads, (rows, e_grads), _ = g.window_grads(p, shape, stream, window, h)
    full = grads | {"E": np.zeros_like(p["E"])}
    full["E"][rows] = e_grads
    assert logp.sum() == pytest.approx(sum(_plain_log_likelihood(p, shape, s) for s in seqs), rel=1e-9)
    r = np.random.default_rng(1)
    for name, grad in full.items():
        for _ in range(12):
            at = tuple(r.integers(0, n) for n in p[name].shape)
            loss = []
            for d in (1e-6, -1e-6):
                moved = p | {name: p[name].copy()}
                moved[name][at] += d
                loss.append(-g.score(moved, shape, seqs).sum())
            assert grad[at] == pytest.approx((loss[0] - loss[1]) / 2e-6, rel=1e-4, abs=1e-6), (name, at)


def test_lm_repeated_rows_null_ids_and_clashing_names(spark):
    docs = [(7, "same text", "x", 1), (7, "same text", "y", 2), (None, "other text", "z", 3), (8, None, None, None)]
    got = lmscore.score_documents(spark.createDataFrame(docs, "doc_id long, text string, held_out string, n_tokens int")).collect()
    assert sorted((x.doc_id is None, x.doc_id or 0, x.n_tokens) for x in got) == [(False, 7, 3), (False, 7, 3), (False, 8, 1), (True, 0, 3)]
    assert len({x.score for x in got if x.doc_id == 7}) == 1


def test_lm_sums_are_a_tree_of_bounded_groups(spark):
    docs = [(i, f"w{i % 9} w{i % 4} w{i % 3}") for i in range(200)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    shape = lmscore.grulm.Shape(head=10, per_class=4, tail_classes=4, buckets=16, hidden=8)
    seen = []

    def mix(texts, lexicon, params):
        one, tree = (lmscore_mix(texts, lexicon, params, together=t) for t in (64, 2))
        seen.append(all(np.allclose(one[k], tree[k], atol=1e-4) for k in one))
        return one

    lmscore_mix = lmscore._mix
    lmscore._mix = mix
    try:
        assert lmscore.score_documents(frame, shape=shape).count() == 200
    finally:
        lmscore._mix = lmscore_mix
    assert seen == [True, True]


def test_lm_words_are_those_of_a_plain_split():
    import pyarrow as pa

    r = np.random.default_rng(1)
    letters = list(" \t\n\x0b\x0c\rAZaz\x1c\x1d\x1e\x1f\x85\xa0　é\x00")
    texts = ["".join(r.choice(letters, int(r.integers(30)))) for _ in range(2000)] + [None, "", " ", " a ", "a"]
    flat, lengths = lmscore._words(pa.array(texts, pa.string()))
    want = [(t or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split() for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert flat.to_pylist() == [x for w in want for x in w]


def test_lm_without_training_documents(spark):
    docs = [(i, f"word{i} again again") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    got = lmscore.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    for x in got:
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (True, 4, 0, 0)
        assert x.base_score == pytest.approx(0.0) and x.score < 0


def test_lm_keeps_the_end_whatever_the_dictionary(spark):
    docs = [(i, "one two three " * 50) for i in range(60)]
    for x in lmscore.score_documents(spark.createDataFrame(docs, "doc_id long, text string"), dictionary=1).collect():
        n = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in docs)
        total = 151 * n
        want = 150 * math.log10((50 * n + 0.5) / (total + 2.5)) + math.log10((n + 0.5) / (total + 2.5))
        assert (x.n_tokens, x.n_known) == (151, 151)
        assert x.base_score == pytest.approx(want, rel=1e-9)
