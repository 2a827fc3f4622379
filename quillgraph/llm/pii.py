"""Personal data by bootstrapped contextual extraction.

Seeds are the matches of four fixed patterns. Candidates are the other identifier-like places: runs of neighbouring digit
groups with their separators, and tokens with a digit or an @. Patterns come from a place's context, with its kind of
characters (a number, or something with letters): the two words before it, the word on each side; and, for numbers, from its
own shape. Digits in context words count as one digit.

Spark scores the graph of patterns and instances over a few rounds. A pattern's score for a kind is its believed instances of
the kind over those, the contradictions (believed instances of other kinds, and candidates that have the kind's form but fail
its check) and `doubt` times the instances of which nothing is known. An instance is as good as its patterns say together
(noisy-or); what rounds believe is a seed of the next. Patterns above the threshold add the candidates they surround.

Everything runs on one scan of the texts whose result (spans and contexts, no text) is kept as a table; rounds are
joins and grouped sums on pattern and instance keys. Nothing is collected.

Context words are whole words of at most `REACH` characters; of the text before a place, the nearest 3 * REACH are looked at.

Defined results: a null or empty text has no spans; rows with equal ids stay separate rows; other columns are not
read. Ties between kinds for one discovered span go to the better pattern, then to the kind listed first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.session import bound_batches, materialize

#: The kinds in their order.
KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CLUE = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'<>,;!?]+")
_WORD = re.compile(r"\w+")
_RUN = re.compile(r"\+?\(?[0-9][0-9().\x20-]*[0-9]")
_DIGIT = re.compile(r"[0-9]")
REACH = 64

SPAN = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
CONTEXT = pa.struct(
    [
        ("kind", pa.int32()),
        ("failed", pa.int32()),
        ("start", pa.int32()),
        ("end", pa.int32()),
        ("instance", pa.string()),
        ("patterns", pa.list_(pa.string())),
    ]
)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every local part ends at an @, so it is enough to look around each @."""
    free, at = 0, text.find("@")
    while at >= 0:
        part = text[free:at]
        k = len(part) - len(part.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if k else None
        if m:
            yield at - k, m.end()
        free = m.end() if m else at + 1
        at = text.find("@", free)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    """A maximal dotted chain falls into groups of four parts from its left."""
    for m in _CHAIN.finditer(text):
        if m.group().count(".") < 3:
            continue
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def _luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m.group())
            if 14 <= len(d) <= 19 and _luhn(d):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m.group())) <= 15:
            yield m.span()


def base_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(kind, start, end) by start, then kind."""
    if not text or not _CLUE.search(text):
        return []
    out = []
    for kind, find in enumerate((_emails, _ips, _cards, _phones)):
        out += [(kind, s, e) for s, e in find(text)]
    return sorted(out, key=lambda x: (x[1], x[0]))


def _patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place, as in the module's docstring."""
    form = text[start:end]
    number = not any(c.isalpha() or c == "@" for c in form)
    kind = "number" if number else "name"
    before = text[max(0, start - 3 * REACH) : start]
    left = [w.group() for w in _WORD.finditer(before)]
    if left and start > 3 * REACH and before[0] in left[0][:1] and _WORD.match(text[start - 3 * REACH - 1]):
        left = left[1:]  # the first word may lack its start
    after = _WORD.search(text, end)
    left = [_DIGIT.sub("0", w.lower()) for w in left[-2:] if len(w) <= REACH]
    right = _DIGIT.sub("0", after.group().lower()) if after and len(after.group()) <= REACH else None
    out = []
    if len(left) == 2:
        out.append(f"{left[0]} {left[1]} _ {kind}")
    if left and right:
        out.append(f"{left[-1]} _ {right} {kind}")
    if number and len(form) <= REACH:
        out.append("= " + _DIGIT.sub("0", form))
    return out


def _failed(form: str) -> int | None:
    """The kind whose form a candidate has though it fails its check."""
    if form.startswith("+"):
        return 3 if _PHONE.fullmatch(form) and not 10 <= len(_digits(form)) <= 15 else None
    if form.count(".") == 3 and _CHAIN.fullmatch(form):
        return None if list(_ips(form)) else 1
    return 2 if _CARD.fullmatch(form) and not list(_cards(form)) else None


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the identifier-like places that no base span touches."""
    out: list[tuple[int, int]] = []
    edges, at = [], 0
    for _, s, e in base:
        if s > at:
            edges.append((at, s))
        at = max(at, e)
    edges.append((at, len(text)))
    for lo, hi in edges:
        taken, free = [], lo
        for m in _RUN.finditer(text, lo, hi):
            if len(_digits(m.group())) >= 7 and not (m.end() < len(text) and text[m.end()].isalnum()) and not (m.start() and text[m.start() - 1].isalnum()):
                taken.append((m.start(), m.end()))
        out += taken
        for s, e in [*taken, (hi, hi)]:
            for m in _TOKEN.finditer(text, free, s):
                form = m.group().rstrip(".")
                if len(form) >= 6 and _CLUE.search(form):
                    out.append((m.start(), m.start() + len(form)))
            free = e
    return sorted(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, contexts = [], []
        for x in batch.column(1):
            text = x.as_py()
            base = base_spans(text)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            found = []
            if text and _CLUE.search(text):
                for k, s, e in [*base, *[(None, *c) for c in candidates(text, base)]]:
                    failed = _failed(text[s:e]) if k is None else None
                    found.append({"kind": k, "failed": failed, "start": s, "end": e, "instance": text[s:e].lower(), "patterns": _patterns(text, s, e)})
            contexts.append(found)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(spans, pa.list_(SPAN)), pa.array(contexts, pa.list_(CONTEXT))],
            names=["id", "base", "contexts"],
        )


def find_pii(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    rounds: int = 3,
    pattern_score: float = 0.8,
    min_support: int = 3,
    doubt: float = 0.1,
) -> DataFrame:
    """Per document: id, base and discovered, each array<struct<kind,start,end>> (kind an index into KINDS).

    A pattern is trusted for a kind from min_support distinct believed instances and pattern_score on.
    """
    bound_batches(docs.sparkSession)
    scan = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = materialize(
        scan.select(F.struct("row", "id").alias("k"), "text").mapInArrow(
            _scan,
            f"k struct<row:long,id:{dict(scan.dtypes)['id']}>, base array<struct<kind:int,start:int,end:int>>, "
            "contexts array<struct<kind:int,failed:int,start:int,end:int,instance:string,patterns:array<string>>>",
        ),
        "pii",
    )
    places = kept.where(F.size("contexts") > 0).select("k.row", F.explode("contexts").alias("c")).select("row", "c.*")
    graph = materialize(
        places.select(F.explode("patterns").alias("pattern"), "instance", "kind", "failed")
        .groupBy("pattern", "instance", "kind", "failed")
        .agg(F.count("*").alias("n")),
        "pii",
        shrink=4,
    )
    seeds = graph.where("kind is not null").groupBy("instance", "kind").agg(F.lit(1.0).alias("belief"))
    fails = graph.where("failed is not null").groupBy("pattern", F.col("failed").alias("kind")).agg(F.sum("n").alias("fails"))
    whole = graph.groupBy("pattern").agg(F.sum("n").alias("n"))
    # Belief in (instance, kind): seeds are certain, candidates start unknown.
    believed, trusted = seeds, None
    for _ in range(rounds):
        sums = (
            graph.select("pattern", "instance", "n")
            .join(believed, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum(F.col("n") * F.col("belief")).alias("good"), F.sum("belief").alias("support"))
        )
        every = sums.groupBy("pattern").agg(F.sum("good").alias("every"))
        wrong = F.col("every") - F.col("good") + F.coalesce("fails", F.lit(0))
        unknown = F.greatest(F.lit(0.0), F.col("n") - F.col("every") - F.coalesce("fails", F.lit(0)))
        trusted = materialize(
            sums.join(every, "pattern")
            .join(whole, "pattern")
            .join(fails, ["pattern", "kind"], "left")
            .withColumn("score", F.col("good") / (F.col("good") + wrong + F.lit(doubt) * unknown))
            .where((F.col("support") >= min_support) & (F.col("score") >= pattern_score))
            .select("pattern", "kind", "score"),
            "pii",
            shrink=16,
        )
        fresh = (
            graph.where("kind is null")
            .select("pattern", "instance", "failed")
            .join(trusted, "pattern")
            .where(~F.col("failed").eqNullSafe(F.col("kind")))
            .groupBy("instance", "kind")
            .agg((1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("score")))))).alias("belief"))
        )
        believed = seeds.unionByName(fresh.join(seeds.select("instance").distinct(), "instance", "left_anti"))
    best = (
        places.where("kind is null")
        .select("row", "start", "end", "failed", F.explode("patterns").alias("pattern"))
        .join(trusted, "pattern")
        .where(~F.col("failed").eqNullSafe(F.col("kind")))
        .groupBy("row", "start", "end")
        .agg(F.max(F.struct("score", (-F.col("kind")).alias("rank"))).alias("best"))
    )
    found = best.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("best.rank")).alias("kind"), "start", "end"))).alias("discovered")
    )
    return kept.select("k.row", "k.id", "base").join(found, "row", "left").select(
        F.col("id").alias(id_col),
        "base",
        F.coalesce("discovered", F.array().cast("array<struct<kind:int,start:int,end:int>>")).alias("discovered"),
    )


def _joined(spans):
    """kind:start:end by start, then kind, comma-joined."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op2(docs: DataFrame) -> DataFrame:
    """The contract's digest of find_pii."""
    found = find_pii(docs)

    def count(kind: int):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.concat("base", "discovered")).alias("spans"),
        F.size("discovered").cast("long").alias("n_discovered"),
    )
