import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quillgraph.llm import pii

RULES = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain(text):
    out = []
    for kind, rule in enumerate(RULES):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m.group())
            ok = (
                kind == 0
                or (kind == 1 and all(int(p) <= 255 for p in m.group().split(".")))
                or (kind == 2 and 14 <= len(d) <= 19 and luhn(d))
                or (kind == 3 and 10 <= len(d) <= 15)
            )
            if ok:
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-1258 +()é\n_%", max_size=60))
def test_base_equals_the_rules(text):
    assert pii.base_spans(text) == plain(text)


def test_base_on_examples():
    for t in ["a@b.c@d.e", "1.2.3.4.5.6.7.8", "300.1.1.1.1", "4111 1111 1111 1111x", "+1 (212) 555-0100", "+1 2", "x@y", "@a.b", "a@-.-", "1.2.3.0000000255"]:
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans(None) == pii.base_spans("") == []


def test_long_runs_take_linear_time():
    for t in ["1" * 200_000, "a" * 200_000, "a@" * 50_000, "1." * 50_000, "+" * 100_000, "a" * 100_000 + "@"]:
        pii.base_spans(t)


def test_query_counts_and_digest(spark):
    texts = ["mail bob@x.org or 10.0.0.1", None, "", "card 4111111111111111 call +1 (212) 555-0100", "none"]
    rows = pii.op2(spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "doc_id long, text string, base string")).collect()
    assert len(rows) == 5
    for r in rows:
        spans = plain(texts[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for k, _, _ in spans) for j in range(4)]
        joined = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans == joined


def test_trusted_context_finds_an_unseen_identifier(spark):
    seeds = [(i, f"text that goes on. please contact me user{i}@mail.org thanks a lot") for i in range(8)]
    texts = [*seeds, (100, "words. please contact me user77(at)mail.org thanks a lot"), (101, "the code is x99y99z99 and nothing more")]
    rows = {r.doc_id: r for r in pii.op2(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert rows[100].n_email == 0 and rows[100].spans.startswith("email:")
    s, e = map(int, rows[100].spans.split(":")[1:])
    assert texts[8][1][s:e] == "user77(at)mail.org"
    assert rows[101].spans == ""


def test_empty_table_and_repeated_rows(spark):
    assert pii.op2(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert pii.op2(spark.createDataFrame([(1, "a@b.c")] * 3, "doc_id long, text string")).count() == 3


def bootstrap(texts, rounds=3, least=3, score=0.8, doubt=0.1):
    """The same in plain loops: {(text, start, end): kind}."""
    edges = []  # text, start, end, instance, pattern, kind, failed
    for i, t in enumerate(texts):
        base = pii.base_spans(t)
        for k, s, e in [*base, *[(None, *c) for c in (pii.candidates(t, base) if t else [])]]:
            for p in pii._patterns(t, s, e):
                edges.append((i, s, e, t[s:e].lower(), p, k, pii._failed(t[s:e]) if k is None else None))
    seeds = {(x[3], x[5]): 1.0 for x in edges if x[5] is not None}
    believed = dict(seeds)
    for _ in range(rounds):
        trusted = {}
        for p in {x[4] for x in edges}:
            mine = [x for x in edges if x[4] == p]
            good = {k: sum(believed.get((x[3], k), 0.0) for x in mine) for k in range(4)}
            for k in range(4):
                # As in the grouped sums: an instance counts once for each way in which it occurs as a seed or candidate.
                support = sum(believed.get((inst, k), 0.0) for inst, *_ in {(x[3], x[5], x[6]) for x in mine})
                fails = sum(x[6] == k for x in mine)
                wrong = sum(good.values()) - good[k] + fails
                unknown = max(0.0, len(mine) - sum(good.values()) - fails)
                if good[k] and support >= least and good[k] / (good[k] + wrong + doubt * unknown) >= score:
                    trusted[p, k] = good[k] / (good[k] + wrong + doubt * unknown)
        believed = dict(seeds)
        for inst in {x[3] for x in edges if x[5] is None} - {i for i, _ in seeds}:
            for k in range(4):
                said = {(x[4], x[6]) for x in edges if x[3] == inst and x[5] is None and (x[4], k) in trusted and x[6] != k}
                if said:
                    doubtful = 1.0
                    for p, _ in said:
                        doubtful *= max(1e-9, 1 - trusted[p, k])
                    believed[inst, k] = 1 - doubtful
    best = {}
    for i, s, e, _, p, k0, failed in edges:
        for k in range(4):
            if k0 is None and failed != k and (p, k) in trusted:
                best[i, s, e] = max(best.get((i, s, e), (0.0, -9)), (trusted[p, k], -k))
    return {at: -k for at, (_, k) in best.items()}


def test_discovery_equals_a_plain_bootstrapping_loop(spark):
    import random

    r = random.Random(1)
    digits = lambda n: "".join(r.choice("123456789") for _ in range(n))
    texts = []
    for i in range(60):
        phone = f"({digits(3)}) {digits(3)}-{digits(4)}"
        texts.append(
            r.choice(
                [
                    f"please ring my phone +1 {phone} before noon",
                    f"please ring my phone {phone} before noon",
                    f"write to address u{i}@mail{i % 3}.org for more",
                    f"write to address u{i} for more or u{digits(5)} now",
                    f"the host at 10.0.{i}.{i} is up, the host at 900.1.{i}.3 is not",
                    f"order number {digits(16)} was sent, call +1 {phone} 10.1.2.{i} then",
                    None,
                ]
            )
        )
    rows = pii.find_pii(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    got = {(x.doc_id, d.start, d.end): d.kind for x in rows for d in x.discovered}
    assert got == bootstrap(texts)
    # Whole phones without their country code, and those that the fixed pattern swallows with a neighbour.
    plain_phones = {(i, t.index("("), t.index(" before")) for i, t in enumerate(texts) if t and "my phone (" in t}
    assert plain_phones and all(got.get(x) == 3 for x in plain_phones)
    for x in rows:
        assert [(s.kind, s.start, s.end) for s in x.base] == plain(texts[x.doc_id] or "")


def test_candidates_are_whole_runs_outside_base_spans():
    t = "ring +1 (826) 555-4081 190.137.223.204 or 0168 555 5254, id a1b2c3d4 at 12:30"
    base = pii.base_spans(t)
    assert [t[s:e] for s, e in pii.candidates(t, base)] == ["+1 (826) 555-4081", "0168 555 5254", "a1b2c3d4"]
    pii.candidates("1 " * 100_000, []), pii.candidates("1" + " " * 100_000 + "x" * 100_000, [])
