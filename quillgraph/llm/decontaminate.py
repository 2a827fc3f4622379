"""Benchmark decontamination with one Aho-Corasick automaton over the normalised items.

Each item gives windows of ten consecutive words (a shorter item is one window). Windows are normalised byte
strings ` w1 w2 ... w10 `, so an occurrence always falls on word boundaries. Every text is normalised once,
scanned once, and the words hit are mapped back to code point offsets of the original.

Defined results: null or word-less texts have no words and no hits; null or word-less items have no windows;
a null item id counts as the empty string; items with equal windows are all reported; rows with equal ids stay separate rows; columns other than the
two named ones are not read, so their names may clash with anything.

The items are read in blocks of at most `block_bytes` of window text and one window, whatever the size of an item. Each
block is one automaton, built once per Python worker, and a scan of its own with a written table before the next, so a
worker holds one automaton at a time (one block at the size of any usual benchmark).
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import forget_shuffles
from quillgraph.session import bound_batches, materialize

#: Words are 0-9, a-z (after lower-casing A-Z) and everything outside ASCII; other ASCII separates.
NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
STATE = "id long, text string, spans array<struct<start:int,end:int>>, items array<string>, hit array<int>, n_words long"
#: What the last scan gives: the texts don't come back from Python, as nothing reads them there.
FOUND = "id long, n_words long, n_hit long, spans array<struct<start:int,end:int>>, items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_built: dict[str, ahocorasick.Automaton] = {}


def normal_words(text: bytes | None) -> list[bytes]:
    return text.translate(NORMAL).split() if text else []


def windows(text: bytes | None, width: int) -> set[bytes]:
    w = normal_words(text)
    if not w:
        return set()
    return {b" " + b" ".join(w[i : i + width]) + b" " for i in range(max(1, len(w) - width + 1))}


def _blocks(items: DataFrame, id_col: str, text_col: str, width: int, block_bytes: int) -> Iterator[dict[bytes, list[str]]]:
    block: dict[bytes, list[str]] = {}
    size, empty = 0, True
    rows = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for row in rows.toLocalIterator():
        for w in windows(bytes(row.t) if row.t is not None else None, width):
            block.setdefault(w, []).append(row.i or "")
            size += len(w)
            if size >= block_bytes:
                yield block
                block, size = {}, 0
                empty = False
    if block or empty:
        yield block


def _scan(patterns, key: str, last: bool = False):
    def automaton() -> ahocorasick.Automaton:
        if key not in _built:
            _built.clear()
            a = ahocorasick.Automaton()
            for w, ids in patterns.value.items():
                a.add_word(w.decode("latin-1"), (w.count(b" ") - 1, len(w), ids))
            if len(a):
                a.make_automaton()
            _built[key] = a
        return _built[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for batch in batches:
            ids, texts, hits, items, n_words = batch.column(0), batch.column(1), [], [], []
            before = zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)
            spans = []
            raw = texts.cast(pa.binary())
            for i, (hit0, items0) in enumerate(before):
                text = raw[i].as_py()
                w = normal_words(text)
                n_words.append(len(w))
                found, names = set(hit0 or ()), set(items0 or ())
                if w and len(a):
                    joined = b" " + b" ".join(w) + b" "
                    got = list(a.iter(joined.decode("latin-1")))
                    if got:
                        at = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
                        mark = np.zeros(len(w) + 1, np.int32)
                        ends = np.fromiter((e for e, _ in got), np.int64, len(got))
                        sizes = np.fromiter((v[1] for _, v in got), np.int64, len(got))
                        counts = np.fromiter((v[0] for _, v in got), np.int64, len(got))
                        first = np.searchsorted(at, ends - sizes + 1)
                        np.add.at(mark, first, 1)
                        np.add.at(mark, first + counts, -1)
                        found.update(np.flatnonzero(np.cumsum(mark)[:-1] > 0).tolist())
                        for v in {id(v): v for _, v in got}.values():
                            names.update(v[2])
                spans.append(_spans(text.decode("utf-8"), found) if found else [])
                hits.append(sorted(found))
                items.append(sorted(names))
            spans, items, n_words = pa.array(spans, SPANS), pa.array(items, pa.list_(pa.string())), pa.array(n_words, pa.int64())
            if last:
                n_hit = pa.array(map(len, hits), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, n_words, n_hit, spans, items], names=["id", "n_words", "n_hit", "spans", "items"])
            else:
                hits = pa.array(hits, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, texts, spans, items, hits, n_words], names=["id", "text", "spans", "items", "hit", "n_words"])

    return run


def _spans(text: str, hit: set[int]) -> list[dict]:
    """Runs of hit words as offsets in the original text."""
    out: list[dict] = []
    last = -2
    for k, m in enumerate(WORD.finditer(text)):
        if k in hit:
            if last == k - 1:
                out[-1]["end"] = m.end()
            else:
                out.append({"start": m.start(), "end": m.end()})
            last = k
    return out


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = 8 << 20,
) -> DataFrame:
    """Per document: id, n_words, n_hit, hit_spans (code points of the original, end exclusive), item_ids."""
    spark = docs.sparkSession
    bound_batches(spark)
    frame = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(text_col).alias("text"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
        F.lit(None).cast("array<string>").alias("items"),
        F.lit(None).cast("array<int>").alias("hit"),
        F.lit(None).cast("long").alias("n_words"),
    )
    blocks = _blocks(items, item_id, item_text, width, block_bytes)
    block = next(blocks)
    while block is not None:
        after = next(blocks, None)
        patterns = spark.sparkContext.broadcast(block)  # bounded by block_bytes
        frame = frame.mapInArrow(_scan(patterns, uuid.uuid4().hex, after is None), FOUND if after is None else STATE)
        if after is not None:
            frame = materialize(frame, "scan")
        block = after
    return frame.select(F.col("id").alias(id_col), "n_words", "n_hit", F.col("spans").alias("hit_spans"), F.col("items").alias("item_ids"))


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents in which no window of any item occurs, with all their columns.

    The scan carries the rows' own columns through, so nothing is shuffled.
    """
    width = options.get("width", 10)
    spark = docs.sparkSession
    bound_batches(spark)
    forget_shuffles(spark)
    names = docs.columns
    out = docs
    for block in _blocks(items, options.get("item_id", "item_id"), options.get("item_text", "text"), width, options.get("block_bytes", 8 << 20)):
        patterns = spark.sparkContext.broadcast(block)
        if out is not docs:
            out = materialize(out, "scan")
        out = out.mapInArrow(_keep(patterns, uuid.uuid4().hex, names.index(options.get("text_col", "text"))), docs.schema)
    return out


def _keep(patterns, key: str, at: int):
    scan = _scan(patterns, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(at).cast(pa.string())
            none = pa.nulls(len(text), pa.list_(pa.int32()))
            fed = pa.RecordBatch.from_arrays(
                [pa.nulls(len(text), pa.int64()), text, none, pa.nulls(len(text), pa.list_(pa.string())), none],
                names=["id", "text", "spans", "items", "hit"],
            )
            hits = next(scan(iter([fed]))).column(4).to_pylist()
            yield batch.filter(pa.array([not h for h in hits]))

    return run


def op10(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest of find_contamination."""
    found = find_contamination(docs, items)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
