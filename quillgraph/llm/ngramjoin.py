"""N-gram Jaccard join by a token-group matrix.

1. One pass over the texts gives the size of each document's shingle set (64-bit hashes), a digest of the set and four
   min-hashes, kept as a small table. Sets are made anew from the texts where they are needed, in the workers: whole
   sets are twice as large as the compressed texts, so keeping them costs more disk than making them costs time.
2. Documents with equal sets form a class; only the class's smallest id goes on.
3. Similar documents are partitioned into groups. Representatives with the same min-hash are compared with the smallest
   id among them (the hub), linear in the rows, and the components of these links are groups. Of the rest, documents
   that mostly consist of frequent shingles are grouped by their most frequent one; any other is a group of its own. A
   group of many documents is cut into parts of at most `part` documents.
4. The token-group matrix holds (token, group) for the tokens in the groups' prefixes. In one order of all tokens
   (frequent ones last), two sets that link share at least k tokens among the first n - ceil(t n) + k of each, so only
   pairs of groups with k shared matrix tokens and fitting sizes can hold a link (Xiao et al. 2008).
5. Each part of such a group is stored with its token union. A query document whose overlap with the union is under
   ceil(t n) is skipped (the bound of Li et al. 2021), by bitmaps first, which cannot underrate an overlap, then on the
   union itself; only qualifying parts are opened, and links are decided there on the whole sets. A task returns links
   between different components only, at most one for each that it joins.

Nothing is dropped: the order of tokens only decides the amount of work, and all bounds are necessary conditions.
Shingles are compared by 64-bit hashes.

Defined results: null or word-less texts have the empty set and link with nothing; a text of fewer words than the shingle
has one shingle; equal sets link; repeated rows with one id are one node and stay separate rows; a null id has a null
component; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import components, forget_shuffles, words
from quillgraph.session import bound_batches, materialize, release

_MIX = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
#: Ids up to this many are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: Rows with sets that go to Python at a time.
ROWS = 500


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def _final(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _SEEDS[0]
    h = (h ^ (h >> np.uint64(29))) * _SEEDS[1]
    return h ^ (h >> np.uint64(32))


def shingle_set(text: bytes | None, size: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = words(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, w), np.uint64, len(w))
    k = min(size, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX + h[i : len(h) - k + 1 + i]
    out = np.unique(_final(out))
    return out


def _each_set(batches: Iterator[pa.RecordBatch], size: int, text_at: int = -1) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in pieces of bounded rows, with the shingle sets of their text column."""
    known = _WordHash()
    for whole in batches:
        for start in range(0, whole.num_rows, 250):
            batch = whole.slice(start, 250)
            yield batch, [shingle_set(x.as_py(), size, known) for x in batch.column(text_at).cast(pa.binary())]


def _digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, size):
            mins = [[int((s * seed).min().astype(np.int64)) if len(s) else None for s in sets] for seed in _SEEDS]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, sets), pa.int32()), pa.array(keys, pa.binary()), *[pa.array(m, pa.int64()) for m in mins]],
                names=["id", "n", "key", "m0", "m1", "m2", "m3"],
            )

    return run


def _with_sets(size: int):
    """The other columns, and sh in the place of the text, which comes last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, size):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([s.tobytes() for s in sets], pa.binary())], names=[*batch.schema.names[:-1], "sh"]
            )

    return run


def _needed(n, num: int, den: int):
    """ceil(n * num / den)"""
    return -(-n * num // den)


def _repeated(size: int, chunk: int = 1 << 20, least: int = 3):
    """Tokens that occur in several of the sets a task holds at a time, with their counts."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        t, c = np.unique(np.concatenate(parts), return_counts=True)
        keep = c >= least
        return pa.RecordBatch.from_arrays([pa.array(t[keep].view(np.int64)), pa.array(c[keep])], names=["token", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for _, sets in _each_set(batches, size):
            for s in sets:
                parts.append(s)
                held += len(s)
                if held >= chunk:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _matrix(size: int, hot, num: int, den: int, k: int, least: int, chunk: int = 1 << 18):
    """Two kinds of rows: (token, group, least n, most n) of the prefixes, where rows of one group that a task sees
    together are merged; and (null, group, n, n, id) for a document that gets its group here."""

    def flush(rows: list[np.ndarray], joined: list[tuple[int, int, int]]) -> pa.RecordBatch:
        t, g, n = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.lexsort((g, t))
        t, g, n = t[order], g[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (g[1:] != g[:-1]))))
        lo, hi = np.minimum.reduceat(n, first), np.maximum.reduceat(n, first)
        more = np.array(joined, np.int64).reshape(-1, 3)
        none = np.arange(len(first) + len(more)) >= len(first)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate((t[first].view(np.int64), more[:, 0])), mask=none),
                pa.array(np.concatenate((g[first], more[:, 0]))),
                pa.array(np.concatenate((lo, more[:, 2])).astype(np.int32)),
                pa.array(np.concatenate((hi, more[:, 2])).astype(np.int32)),
                pa.array(np.concatenate((g[first], more[:, 1])), mask=~none),
            ],
            names=["token", "g", "lo", "hi", "id"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = hot.value
        rows, joined, held = [], [], 0
        for batch, sets in _each_set(batches, size):
            for i, g, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sets, strict=True):
                if len(s) < least:
                    continue
                p = min(len(s), len(s) - _needed(len(s), num, den) + k)
                first = s[:p]
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                    rank = np.where(tokens[at] == s, ranks[at], -1)
                    if (rank >= 0).any():
                        order = np.lexsort((s, rank))
                        first = s[order[:p]]
                        if g is None and rank[order[p - 1]] >= 0:
                            g = int(s[order[-1]].astype(np.int64))
                            joined.append((g, i, len(s)))
                rows.append((first.copy(), np.full(p, i if g is None else g, np.int64), np.full(p, len(s), np.int32)))
                held += p
                if held >= chunk:
                    yield flush(rows, joined)
                    rows, joined, held = [], [], 0
        if rows:
            yield flush(rows, joined)

    return run


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    """|a & b| of sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum())


def _links(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    both = _overlap(a, b)
    return den * both >= num * (len(a) + len(b) - both)


def _verify_pairs(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [
                _links(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den)
                for x, y in zip(batch.column(2), batch.column(3), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _bitmap(tokens: np.ndarray) -> bytes:
    """A bit for each token's hash modulo the number of bits, a power of two of about four bits a token."""
    bits = min(1 << 16, max(64, 1 << (4 * len(tokens) - 1).bit_length()))
    mark = np.zeros(bits, np.uint8)
    mark[(tokens & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(mark).tobytes()


def _most_shared(n: int, a: np.ndarray, b: np.ndarray) -> int:
    """At most so many of n tokens with bitmap a are among those of bitmap b: each bit of a alone is a token not shared."""
    while len(a) > len(b):
        half = len(a) // 2
        a = a[:half] | a[half:]
    while len(b) > len(a):
        half = len(b) // 2
        b = b[:half] | b[half:]
    return n - int(np.bitwise_count(a & ~b).sum())


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group parts with their members' sizes and bitmaps, their token unions and those's bitmaps; a single set is its own union."""
    for batch in batches:
        sizes, maps, unions, union_maps = [], [], [], []
        for x in batch.column(3):
            sets = [np.frombuffer(v.as_buffer(), np.uint64) for v in x.values]
            sizes.append([len(v) for v in sets])
            maps.append([_bitmap(v) for v in sets])
            union = np.unique(np.concatenate(sets)) if len(sets) > 1 else sets[0]
            unions.append(union.tobytes() if len(sets) > 1 else None)
            union_maps.append(_bitmap(union))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(unions, pa.binary()), pa.array(sizes, pa.list_(pa.int32())), pa.array(maps, pa.list_(pa.binary())), pa.array(union_maps, pa.binary())],
            names=["g", "part", "labels", "sets", "tokens", "sizes", "maps", "tokens_map"],
        )


def _singles(size: int):
    """(one, then _store()'s columns) of single documents; where one is false, bitmaps are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _each_set(batches, size):
            ones = batch.column(3).to_pylist()
            maps = [_bitmap(s) if one else None for one, s in zip(ones, sets, strict=True)]
            single = lambda xs, kind: pa.array([[x] if x is not None else None for x in xs], pa.list_(kind))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(3), batch.column(0), batch.column(1), single(batch.column(2).to_pylist(), pa.int64()), single([s.tobytes() for s in sets], pa.binary()),
                    pa.nulls(len(sets), pa.binary()), single(map(len, sets), pa.int32()), single(maps, pa.binary()), pa.array(maps, pa.binary()),
                ],
                names=["one", "g", "part", "labels", "sets", "tokens", "sizes", "maps", "tokens_map"],
            )

    return run


def _bound(num: int, den: int):
    """Keeps the pairs of parts in which some query document may share ceil(t n) tokens with the other part's union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for sizes, maps, other in zip(batch.column(4), batch.column(5), batch.column(6), strict=True):
                union = np.frombuffer(other.as_buffer(), np.uint8)
                ok.append(
                    any(
                        _most_shared(n, np.frombuffer(m.as_buffer(), np.uint8), union) >= _needed(n, num, den)
                        for n, m in zip(sizes.as_py(), maps.values, strict=True)
                    )
                )
            yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "pa", "b", "pb"]).filter(pa.array(ok, pa.bool_()))

    return run


def _open(num: int, den: int):
    """Links between different labels of two parts (labels, sets, maps of each, and the second's token union)."""

    def read(labels, sets, maps) -> list[tuple[int, np.ndarray, np.ndarray]]:
        array = lambda v, kind: np.frombuffer(v.as_buffer(), kind)
        return [(x, array(v, np.uint64), array(m, np.uint8)) for x, v, m in zip(labels.as_py(), sets.values, maps.values, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*batch.columns, strict=True):
                root: dict[int, int] = {}

                def find(x: int, root=root) -> int:
                    while root.setdefault(x, x) != x:
                        x = root[x]
                    return x

                queries, members = read(*row[:3]), read(*row[3:6])
                union = np.frombuffer(row[6].as_buffer(), np.uint64) if row[6].is_valid else members[0][1]
                for x, q, q_map in queries:
                    n = len(q)
                    if all(find(x) == find(y) for y, _, _ in members) or _overlap(q, union) < _needed(n, num, den):
                        continue
                    for y, m, m_map in members:
                        if find(x) == find(y) or len(m) * den < n * num or n * den < len(m) * num:
                            continue
                        most = min(_most_shared(n, q_map, m_map), _most_shared(len(m), m_map, q_map))
                        if den * most >= num * (n + len(m) - most) and _links(q, m, num, den):
                            found.append((x, y))
                            root[find(x)] = find(y)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return run


def _with_ids(rows: DataFrame, on: str, ids: DataFrame, how: str) -> DataFrame:
    """Semi or anti join; the ids are broadcast only if they were counted to be few."""
    if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return rows.join(ids, on, how)


def _split_join(rows: DataFrame, small: DataFrame, on: list[str], size: str, least: int = 1000, most: int = 200_000) -> DataFrame:
    """Inner join with a table of one row for each key that says in `size` how many rows the key has.

    The keys of many rows are broadcast, `most` at most: the bar doubles until they fit. Only the others are shuffled, so no task
    gets more rows of one key than the bar.
    """
    while small.where(F.col(size) > least).limit(most + 1).count() > most:
        least *= 2
    hot = small.where(F.col(size) > least).drop(size)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(small.where(F.col(size) <= least).drop(size), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)


def by_token_groups(member: DataFrame, groups: DataFrame, parts: DataFrame) -> DataFrame:
    """g of the groups of several documents that links don't hold together."""
    return parts.where("docs > 1").select("g").join(member.join(groups.select("id"), "id", "left_anti").select("g").distinct(), "g", "left_semi")


def link_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    num: int = 80,
    den: int = 100,
    k: int = 4,
    part: int = 128,
    hot_from: int = 8,
    max_hot: int = 200_000,
) -> DataFrame:
    """Per row: id, n_shingles, component (smallest id reachable by links of Jaccard >= num / den).

    hot_from: tokens counted at least so often go last in the order; doubled until at most max_hot are left (the
    broadcast bound). part: documents in a stored part of a group, which has at most 512 times as many tokens on average.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    s = materialize(base.mapInArrow(_digests(size), "id long, n int, key binary, m0 long, m1 long, m2 long, m3 long"), "sets", ROWS)
    real = s.where("key is not null and id is not null")
    classes = materialize(
        real.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).where("copies > 1"), "classes", shrink=16
    )
    copies = materialize(
        _split_join(real.select("id", "key"), classes, ["key"], "copies").where("id <> rep").select("id", "rep").distinct(), "copies", shrink=16
    )
    release(classes)
    reps = materialize(_with_ids(real, "id", copies.select("id"), "left_anti").select("id", "n", "m0", "m1", "m2", "m3"), "reps", shrink=4)
    texts = _with_ids(base.where("id is not null"), "id", copies.select("id"), "left_anti")

    # Groups of similar documents: each is compared with the hubs of its min-hashes if the sizes fit and a second
    # min-hash agrees. A pair missed here is found by the matrix.
    mins = [f"m{i}" for i in range(4)]
    keyed = reps.select("id", "n", *mins, F.posexplode(F.array(*mins)).alias("i", "m"))
    hubs = materialize(
        keyed.groupBy("i", "m")
        .agg(F.min(F.struct("id", "n", *mins)).alias("hub"), F.max("id").alias("last"), F.count("*").alias("docs"))
        .where("hub.id < last")
        .drop("last"),
        "hubs", shrink=16,
    )
    same = sum(((F.col(f"hub.{c}") == F.col(c)).cast("int") for c in mins), F.lit(0))
    near = materialize(
        _split_join(keyed, hubs, ["i", "m"], "docs")
        .where((F.col("id") != F.col("hub.id")) & (same >= 2))
        .where((F.col("n") * den >= F.col("hub.n") * num) & (F.col("hub.n") * den >= F.col("n") * num))
        .select(F.col("hub.id").alias("a"), F.col("id").alias("b"))
        .distinct(),
        "near", shrink=16,
    )
    ids = materialize(near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct(), "ids", shrink=16)
    cand = materialize(_with_ids(texts, "id", ids, "left_semi").mapInArrow(_with_sets(size), "id long, sh binary"), "cand", ROWS)
    hub_links = (
        near.join(cand.select(F.col("id").alias("b"), F.col("sh").alias("sb")), "b")
        .join(cand.select(F.col("id").alias("a"), F.col("sh").alias("sa")), "a")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_verify_pairs(num, den), "a long, b long")
    )
    hub_links = materialize(hub_links, "links", ROWS, 4)
    groups = materialize(components(hub_links).withColumnRenamed("node", "id").withColumnRenamed("component", "g"), "groups", shrink=16)
    for t in (near, ids, cand, hubs):
        release(t)
    del keyed, hub_links
    forget_shuffles(spark)

    # One order of all tokens: the frequent ones last.
    repeated = materialize(
        texts.select("text").mapInArrow(_repeated(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= hot_from), "hot", ROWS, 16
    )
    floor = hot_from
    while repeated.where(F.col("n") >= floor).count() > max_hot:
        floor *= 2
    rows = repeated.where(F.col("n") >= floor).select("token", "n").toPandas()
    release(repeated)
    tokens, counts = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    tokens, counts = tokens[order], counts[order]
    hot = spark.sparkContext.broadcast((tokens, counts))

    # Sets of under `least` shingles link with equal ones only, which are classes already.
    least = next(n for n in range(1, 10_000) if num * (n + 1) <= den * n)
    few = groups.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    labelled = texts.join(F.broadcast(groups) if few else groups, "id", "left")
    matrix = materialize(
        labelled.select("id", "g", "text").mapInArrow(_matrix(size, hot, num, den, k, least), "token long, g long, lo int, hi int, id long"), "matrix", ROWS
    )
    # A group may have several rows of a token, from different tasks: counts are then too high, never too low.
    cells = matrix.where("token is not null")
    left = cells.select("token", F.col("g").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"))
    right = cells.select("token", F.col("g").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"))
    both = left.join(right, "token").where("a < b").where((F.col("hi_a") * den >= F.col("lo_b") * num) & (F.col("hi_b") * den >= F.col("lo_a") * num))
    if _needed(least, num, den) >= k:
        shared = both.groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    else:  # small sets may link by fewer than k tokens: then all that they need
        need = F.ceil(F.greatest(F.min("lo_a"), F.min("lo_b")) * num / den)
        shared = both.groupBy("a", "b").agg(F.count("*").alias("n"), need.alias("need")).where(F.col("n") >= F.least(F.lit(k), "need"))
    pairs = materialize(
        shared.select("a", "b"),
        "pairs",
        shrink=4,
    )
    del left, right
    forget_shuffles(spark)

    # Where each document of a group is: its part goes by the group's documents and tokens.
    by_token = matrix.where("token is null").select("id", "g", F.col("lo").alias("n"))
    member = materialize(groups.join(reps.select("id", "n"), "id").select("id", "g", "n").unionByName(by_token), "member", shrink=16)
    parts = materialize(member.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / part, F.sum("n") / (part * 512))).alias("parts"), F.count("*").alias("docs")), "parts", shrink=16)
    release(matrix)
    # A group by token may hold links inside; the members of the others are linked already.
    inner = by_token_groups(member, groups, parts)
    ids = materialize(
        pairs.select(F.col("a").alias("g")).union(pairs.select(F.col("b").alias("g"))).union(inner.select("g")).distinct(), "ids", shrink=16
    )
    few = member.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    where = member.join(parts, "g").select("id", "g", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), (F.col("docs") == 1).alias("one"))
    placed = labelled.select("id", F.coalesce("g", "id").alias("label"), "text").join(F.broadcast(where) if few else where, "id", "left")
    placed = placed.select(
        F.coalesce("g", "id").alias("g"), F.coalesce("part", F.lit(0)).alias("part"), "label", F.coalesce("one", F.lit(True)).alias("one"), "text"
    )
    placed = _with_ids(placed, "g", ids, "left_semi")
    schema = "g long, part long, labels array<long>, sets array<binary>, tokens binary, sizes array<int>, maps array<binary>, tokens_map binary"
    # One scan: a document that is its own group is stored at once, those of one part meet by a shuffle.
    made = materialize(placed.mapInArrow(_singles(size), f"one boolean, {schema}"), "made", ROWS)
    together = (
        made.where("not one")
        .groupBy("g", "part")
        .agg(F.collect_list(F.struct(F.col("labels")[0].alias("label"), F.col("sets")[0].alias("sh"))).alias("x"))
        .select("g", "part", "x.label", "x.sh")
    )
    parted = materialize(together.mapInArrow(_store, schema), "stored", 20)
    stored = made.where("one").drop("one").unionByName(parted)
    forget_shuffles(spark)
    # The bound first, on bitmaps; whole sets are fetched only for the parts that it leaves.
    side = lambda s, *cs: stored.select(F.col("g").alias(s), F.col("part").alias(f"p{s}"), *[F.col(c).alias(f"{c}_{s}") for c in cs])
    todo = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "pa", "b", "pb").unionByName(
        inner.select("g").distinct().join(side("a").withColumnRenamed("a", "g"), "g").join(side("b").withColumnRenamed("b", "g"), "g").where("pa <= pb")
        .select(F.col("g").alias("a"), "pa", F.col("g").alias("b"), "pb")
    )
    qualified = materialize(
        todo.join(side("a", "sizes", "maps"), ["a", "pa"])
        .join(side("b", "tokens_map"), ["b", "pb"])
        .select("a", "pa", "b", "pb", "sizes_a", "maps_a", "tokens_map_b")
        .mapInArrow(_bound(num, den), "a long, pa long, b long, pb long"),
        "qualified",
        ROWS,
        4,
    )
    ids = materialize(qualified.select(F.col("a").alias("g")).union(qualified.select(F.col("b").alias("g"))).distinct(), "ids", shrink=16)
    stored = _with_ids(stored, "g", ids, "left_semi")
    opened = (
        qualified.join(side("a", "labels", "sets", "maps"), ["a", "pa"])
        .join(side("b", "labels", "sets", "maps", "tokens"), ["b", "pb"])
        .select("labels_a", "sets_a", "maps_a", "labels_b", "sets_b", "maps_b", "tokens_b")
        .mapInArrow(_open(num, den), "a long, b long")
    )
    opened = materialize(opened, "links", 20, 4)
    joined = materialize(components(opened).withColumnRenamed("node", "g"), "joined", shrink=16)
    for t in (pairs, ids, qualified, parts, made, parted, member, opened):
        release(t)

    of_rep = groups.join(joined, "g", "full_outer").select(
        F.coalesce("id", "g").alias("id"), F.coalesce("component", "g").alias("component")
    )
    of_copy = copies.join(of_rep.withColumnRenamed("id", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    known = of_rep.unionByName(of_copy).groupBy("id").agg(F.min("component").alias("component"))
    return s.select("id", "n").join(known, "id", "left").select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_representatives(docs: DataFrame, **options) -> DataFrame:
    """One document of each component (the smallest id), with all columns; a null id is kept.

    Of several rows with one id, those with one text become one row; an id whose rows differ in their text keeps each text once.
    """
    n = len(docs.columns)
    at, text = (f"c{docs.columns.index(c)}" for c in ("doc_id", "text"))
    plain = docs.toDF(*[f"c{i}" for i in range(n)])
    found = materialize(link_documents(plain, id_col=at, text_col=text, **options).toDF("id", "n", "component"), "found", shrink=4)
    gone = materialize(found.where("id <> component").select(F.col("id").alias(at)).distinct(), "gone", shrink=16)
    again = materialize(found.where("id is not null").groupBy("id").count().where("count > 1").select(F.col("id").alias(at)), "again", shrink=16)
    release(found)
    forget_shuffles(docs.sparkSession)
    kept = _with_ids(plain, at, gone, "left_anti")
    if again.limit(1).count():
        once = _with_ids(kept, at, again, "left_semi").dropDuplicates([at, text])
        kept = _with_ids(kept, at, again, "left_anti").unionByName(once)
    return kept.toDF(*docs.columns)


def op7(docs: DataFrame) -> DataFrame:
    """The contract's query: four-word shingles, 85 of 100."""
    return link_documents(docs, size=4, num=85, den=100)
