"""Token counts by dynamic programming shared over a trie of pre-tokens.

The unigram model segments a pre-token (a word with a leading U+2581) into the vocabulary pieces of largest summed
log-probability. Distinct pre-tokens are inserted in a trie; a node's forward score (the best score of the prefix
that ends there, with its number of tokens) is computed once, when the node is made, and shared by every
pre-token that passes it. A terminal's count is the pre-token's token count, stored under its text.

The vocabulary is a public file, read on the driver and broadcast (its size is fixed by the file). It holds
ranks, not probabilities, so a piece's log-probability is Zipf's: -ln(rank + 1). Characters without a piece of
their own fall back to one token for each byte of UTF-8 and score ten below the rarest piece.

Defined results: null and blank texts have 0 pre-tokens and 0 tokens; rows with equal ids stay separate rows; other
columns are not read. The trie and the counts are caches of a worker, emptied at max_nodes and max_words: that
bounds memory and changes no count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import bound_batches

SPACE = "▁"
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> log-probability, in the file's order of rank; control, byte and unknown pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))]
    pieces += [] if SPACE in pieces else [SPACE]
    return {p: -math.log(rank + 1) for rank, p in enumerate(dict.fromkeys(pieces), 1)}


class TrieCounter(dict):
    """pre-token -> token count; missing ones are inserted in the trie."""

    def __init__(self, scores: dict[str, float], max_nodes: int = 400_000, max_words: int = 400_000):
        super().__init__()
        self.scores = scores
        # Every suffix of a piece, with its score if it is a piece itself: the search for last pieces stops
        # at the first string that ends no piece.
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(1, len(p))} | scores
        self.unknown = min(scores.values(), default=0.0) - 10.0
        self.max_nodes, self.max_words = max_nodes, max_words
        self._empty()

    def _empty(self) -> None:
        self.kids: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def __missing__(self, word: str) -> int:
        if len(self.best) + len(word) > self.max_nodes and len(self.best) > 1:
            self._empty()
        if len(self) >= self.max_words:
            self.clear()
        text, node, path = SPACE + word, 0, [0]
        kids, best, count, ends = self.kids, self.best, self.count, self.ends
        for at, ch in enumerate(text):
            nxt = kids.get((node, ch))
            if nxt is None:
                top, n = -math.inf, 0
                if ends.get(ch) is None:
                    top, n = best[node] + self.unknown, count[node] + len(ch.encode())
                start = at
                # From short last pieces to long ones; ties go to the longest.
                while start >= 0 and (s := ends.get(text[start : at + 1], self)) is not self:
                    if s is not None and best[path[start]] + s >= top:
                        top, n = best[path[start]] + s, count[path[start]] + 1
                    start -= 1
                nxt = kids[node, ch] = len(best)
                best.append(top)
                count.append(n)
            node = nxt
            path.append(node)
        if len(text) > 4096:  # a giant word isn't worth keeping
            n = count[node]
            self._empty()
            return n
        self[word] = count[node]
        return count[node]


def _counter(shared, max_nodes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TrieCounter(shared.value, max_nodes, max_nodes)
        for batch in batches:
            n_pre, n_tok = [], []
            for x in batch.column(1):
                pre = (x.as_py() or "").split()
                n_pre.append(len(pre))
                n_tok.append(sum(map(known.__getitem__, pre)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_pre, pa.int64()), pa.array(n_tok, pa.int64())], names=["id", "p", "t"]
            )

    return run


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, max_nodes: int = 400_000
) -> DataFrame:
    """Per document: id, n_pretokens (runs without Unicode white space), n_tokens."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = dict(docs.dtypes)[id_col]
    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_counter(shared, max_nodes), f"id {kind}, n_pretokens long, n_tokens long")
        .withColumnRenamed("id", id_col)
    )
