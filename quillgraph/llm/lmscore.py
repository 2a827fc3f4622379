"""Scoring of whole documents by a gated recurrent language model and by a smoothed unigram model.

All counts come from every training document (crc32 of the id modulo 5 is not 1): word counts are summed by Spark and
kept as a table. Words whose count reaches a threshold that leaves at most `dictionary` of them (the broadcast bound;
the threshold doubles until they fit) are looked up in the workers; the others, "far" words, are joined to the
counts by a shuffle, so every word of every text gets its own count.

The network (grulm) is trained in numpy in every task on whole texts, starting from one model, and the tasks' parameters
are averaged, weighted by their tokens, in each round (parameter mixing, McDonald et al. 2010). Each round takes another
fold of the training documents; the rounds together take them all. The averages are sums over slices of the parameters in a
tree whose depth follows the number of tasks, so no task or driver gets all models at once. A score is the sum over all
tokens of the whole text, states carried across windows.

Defined results: a null text is empty (one end token); a null id counts as training (crc32 of the empty text is 0);
repeated rows are separate documents; an empty training fold gives scores from the smoothing alone; other columns
are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm import grulm
from quillgraph.llm.common import fold_of, forget_shuffles
from quillgraph.session import bound_batches, materialize

END = b""
LN10 = math.log(10)
SHAPE = grulm.Shape(head=4096, per_class=64, tail_classes=32, buckets=1024, hidden=16)


#: Bytes of text that a worker takes at a time; a longer text is taken whole.
POOL = 16 << 20


def _pools(batches: Iterator[pa.RecordBatch], most: int = POOL) -> Iterator[pa.RecordBatch]:
    """The batches, put together until they hold so many bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has; nothing is made a Python object."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    flat, lengths = lists.flatten().cast(pa.binary()), pc.list_value_length(lists).to_numpy().astype(np.int64)
    some = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # space at either end leaves an empty word
    if not some.all():
        row = np.repeat(np.arange(len(lengths)), lengths)
        flat, lengths = flat.filter(pa.array(some)), np.bincount(row[some], minlength=len(lengths))
    return flat, lengths


def _classes(words: pa.Array, n: int) -> np.ndarray:
    """grulm.tail_classes of many words: once for each distinct ending."""
    ends = pc.binary_slice(words, -3).dictionary_encode()
    return np.array(grulm.tail_classes(ends.dictionary.to_pylist(), n), np.int32)[ends.indices.to_numpy()]


def _count(n_classes: int):
    """(word, class, n) of the tasks' texts, summed in each pool; an end for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pool in _pools(batches):
            seen = pc.value_counts(_words(pool.column(0))[0])
            word = pa.concat_arrays([seen.field("values"), pa.array([END], pa.binary())])
            n = pa.concat_arrays([seen.field("counts"), pa.array([pool.num_rows], pa.int64())])
            yield pa.RecordBatch.from_arrays([word, pa.array(_classes(word, n_classes)), n], names=["word", "k", "n"])

    return run


class Lexicon:
    """The dictionary words with their counts, and what a token needs for the network; built once per worker.

    A token's key is its rank for head words, else head + bucket * tail_classes + class; tables by key give its input, class and word.
    """

    _built: dict[str, "Lexicon"] = {}

    def __init__(self, table: dict):
        self.shape: grulm.Shape = table["shape"]
        s = self.shape
        self.n_head = table["head"]
        self.listed = pa.array(table["words"], pa.binary())
        self.known = table["counts"] > 0
        self.log_count = np.log10(table["counts"] + 0.5)
        self.keys = np.concatenate((np.arange(self.n_head), self._tail_keys(self.listed[self.n_head :]))).astype(np.int32)
        tail = np.arange(s.buckets * s.tail_classes)
        head = np.arange(s.head)
        self.inp = np.concatenate((head, s.head + tail // s.tail_classes)).astype(np.int16)
        self.cls = np.concatenate((head // s.per_class, s.head_classes + tail % s.tail_classes)).astype(np.int16)
        self.word = np.concatenate((head % s.per_class, np.zeros(len(tail)))).astype(np.int16)
        #: What a tail word's class takes from its log probability, by key; 0 for head words.
        tail_log = np.log10(table["tail_tokens"] + 0.5 * (table["tail_words"] + 1))
        self.class_log = np.concatenate((np.zeros(s.head), tail_log[tail % s.tail_classes]))
        self.all_log = math.log10(table["tokens"] + 0.5 * (table["distinct"] + 1))
        self.end = table["words"].index(END)

    def _tail_keys(self, words: pa.Array) -> np.ndarray:
        s = self.shape
        return s.head + np.array(grulm.input_buckets(words.to_pylist(), s.buckets), np.int64) * s.tail_classes + _classes(words, s.tail_classes)

    @classmethod
    def of(cls, shared) -> "Lexicon":
        key = shared.value["key"]
        if key not in cls._built:
            cls._built.clear()
            cls._built[key] = cls(shared.value)
        return cls._built[key]

    def tokens(self, texts: pa.Array):
        """Of the words of all texts with their ends: tokens of each text, dictionary index or -1, key; and (word, row) of far words."""
        flat, lengths = _words(texts)
        found = pc.index_in(flat, value_set=self.listed).fill_null(-1).to_numpy()
        is_far = found < 0
        far = flat.filter(pa.array(is_far)).dictionary_encode()
        far_row = np.repeat(np.arange(len(lengths)), lengths)[is_far]
        found_keys = self.keys[found]
        if len(far):
            found_keys[is_far] = self._tail_keys(far.dictionary)[far.indices.to_numpy()]
        sizes = lengths + 1
        ends = np.cumsum(sizes) - 1
        inside = np.ones(int(sizes.sum()), bool)
        inside[ends] = False
        ids, keys = np.full(len(inside), self.end, np.int32), np.full(len(inside), self.keys[self.end], np.int32)
        ids[inside], keys[inside] = found, found_keys
        del flat, found, found_keys, inside
        pa.default_memory_pool().release_unused()
        return sizes, ids, keys, far, far_row

    def sequences(self, sizes: np.ndarray, keys: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(inp, cls, word) of each text: a text starts from an end, which is what stands before it here."""
        inp = self.inp[np.concatenate((self.keys[self.end : self.end + 1], keys[:-1]))]
        cls, word = self.cls[keys], self.word[keys]
        cuts = np.cumsum(sizes).tolist()
        return [(inp[i:j], cls[i:j], word[i:j]) for i, j in zip([0, *cuts], cuts)]  # noqa: B905


def _train(lexicon, params, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.of(lexicon)
        p, tokens = params.value, 0
        for pool in _pools(batches):
            sizes, _, keys = lex.tokens(pool.column(0))[:3]
            p = grulm.train(p, lex.shape, lex.sequences(sizes, keys))
            tokens += len(keys)
        if tokens:
            flat = np.concatenate([p[k].ravel() for k in sorted(p)]).astype(np.float64) * tokens
            cut = np.array_split(flat, slices)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(slices), pa.int32()), pa.array([int(tokens)] * slices, pa.int64()), pa.array([c.astype(np.float32).tobytes() for c in cut], pa.binary())],
                names=["slice", "tokens", "sum"],
            )

    return run


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in pdf["sum"])
    return pd.DataFrame({"at": [pdf["at"].iloc[0]], "slice": [pdf["slice"].iloc[0]], "tokens": [int(pdf["tokens"].sum())], "sum": [total.astype(np.float32).tobytes()]})


def _mix(texts: DataFrame, lexicon, params: grulm.Params, slices: int = 32, together: int = 64) -> grulm.Params:
    """One round: trains in each task and averages the parameters.

    Slices of the parameters are summed in a tree: at most `together` tasks or sums in one group, whatever their number.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(params)  # its size is fixed by the shape
    schema = "slice int, tokens long, sum binary"
    tasks = texts.rdd.getNumPartitions()  # of the plan; nothing runs
    sums = texts.mapInArrow(_train(lexicon, shared, slices), schema).withColumn("at", F.spark_partition_id())
    while tasks > 1:
        # `at` goes along as the group's key, not through the function.
        sums = sums.withColumn("at", F.expr(f"at div {together}").cast("int")).groupBy("slice", "at").applyInPandas(_add_up, "at int, " + schema)
        tasks = -(-tasks // together)
    rows = sums.orderBy("slice").collect()  # `slices` rows, one model in all
    if not rows:
        return params
    flat = np.concatenate([np.frombuffer(r["sum"], np.float32) / np.float32(r["tokens"]) for r in rows])
    out, at = {}, 0
    for k in sorted(params):
        out[k] = flat[at : at + params[k].size].reshape(params[k].shape).astype(np.float32)
        at += params[k].size
    shared.unpersist()
    return out


def _counted(far: pa.DictionaryArray, row: np.ndarray, rows: int) -> pa.ListArray:
    """The distinct far words of each row with their numbers."""
    width = max(1, len(far.dictionary))
    pair, n = np.unique(row * width + far.indices.to_numpy(), return_counts=True)
    entries = pa.StructArray.from_arrays([far.dictionary.take(pa.array(pair % width)), pa.array(n.astype(np.int32))], names=["word", "n"])
    offsets = np.searchsorted(pair, np.arange(rows + 1) * width)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), entries)


def _score(lexicon, params):
    """(row, id, held, n_tokens, known, base, score, far words with their numbers): what the dictionary can say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon.of(lexicon)
        for pool in _pools(batches):
            sizes, ids, keys, far, far_row = lex.tokens(pool.column(3))
            starts = np.cumsum(sizes) - sizes
            sums = lambda x: np.add.reduceat(x, starts)
            near = ids >= 0
            logs = np.where(near, lex.log_count[ids], 0.0)
            # A tail word's part inside its class: log (c + 0.5) - log (T + 0.5 (V + 1)).
            tails = sums(np.where(ids >= lex.n_head, logs, 0.0) - lex.class_log[keys])
            known = sums((near & lex.known[ids]).astype(np.int64))
            base = sums(logs) - sizes * lex.all_log
            fars, seqs = _counted(far, far_row, len(sizes)), lex.sequences(sizes, keys)
            del ids, keys, near, logs, far, far_row
            network = grulm.score(params.value, lex.shape, seqs) / LN10
            yield pa.RecordBatch.from_arrays(
                [*pool.columns[:3], pa.array(sizes), pa.array(known), pa.array(base), pa.array(tails + network), fars],
                names=["row", "id", "held", "n_tokens", "known", "base", "score", "far"],
            )

    return run


def _tail_sums(counts: DataFrame, n: int, head: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each tail class, without the head words."""
    tokens, distinct = np.zeros(n), np.zeros(n)
    for r in counts.groupBy("k").agg(F.sum("n").alias("t"), F.count("*").alias("v")).collect():
        tokens[r["k"]], distinct[r["k"]] = r["t"], r["v"]
    for w, c in head:
        k = grulm.tail_classes([w], n)[0]
        tokens[k] -= c
        distinct[k] -= 1
    return tokens, distinct


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shape: grulm.Shape = SHAPE,
    dictionary: int = 200_000,
    rounds: int | None = None,
    share: int = 2,
) -> DataFrame:
    """Per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    share: each round trains on the training documents of one of `share` further folds of the id's hash. rounds: `share`, so
    that every training document is learned from once.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), (fold_of(id_col) == 1).alias("held"), F.col(text_col).alias("text"),
        F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(share)).alias("fold"),
    )
    training = rows.where(~F.col("held"))
    counts = materialize(
        training.select("text")
        .mapInArrow(_count(shape.tail_classes), "word binary, k int, n long")
        .groupBy("word", "k")
        .agg(F.sum("n").alias("n")),
        "counts",
    )
    forget_shuffles(spark)
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = 1
    while counts.where(F.col("n") >= floor).count() > dictionary:
        floor *= 2
    # The end is always listed.
    listed = counts.where((F.col("n") >= floor) | (F.col("word") == F.lit(END))).select("word", "n").toPandas()
    listed["word"] = listed["word"].map(bytes)
    listed = listed.sort_values(["n", "word"], ascending=[False, True])
    n_head = min(shape.head, len(listed))
    names, numbers = listed["word"].tolist(), listed["n"].to_numpy(np.float64)
    tail_tokens, tail_words = _tail_sums(counts, shape.tail_classes, list(zip(names[:n_head], numbers[:n_head], strict=True)))
    if not names:  # nothing to learn from: the end alone, unseen
        names, numbers, n_head = [END], np.zeros(1), 1
    lexicon = spark.sparkContext.broadcast(  # at most `dictionary` words and the end
        {
            "key": getattr(counts, "_quill_path", ""), "shape": shape, "words": names, "counts": numbers, "head": n_head,
            "tail_tokens": tail_tokens, "tail_words": tail_words, "tokens": total, "distinct": distinct,
        }
    )
    params = grulm.start_params(shape, numbers[:n_head], tail_tokens)
    for r in range(share if rounds is None else rounds):
        params = _mix(training.where(F.col("fold") == r % share).select("text"), lexicon, params)
    shared = spark.sparkContext.broadcast(params)
    local = materialize(
        rows.select(F.monotonically_increasing_id().alias("row"), "id", "held", "text").mapInArrow(
            _score(lexicon, shared),
            "row long, id long, held boolean, n_tokens long, known long, base double, score double, far array<struct<word:binary,n:int>>",
        ),
        "scores",
    )
    far = (
        local.select("row", F.explode("far").alias("x"))
        .select("row", "x.word", F.col("x.n").alias("times"))
        .join(counts.where((F.col("n") < floor) & (F.col("word") != F.lit(END))).select("word", "n"), "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("logs"),
            F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        )
    )
    return local.drop("far").join(far, "row", "left").select(
        F.col("id").alias(id_col),
        F.col("held").alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("logs", F.lit(0.0))).alias("score"),
    )
