"""Embedding near-duplicates by PCA-ordered tiled comparison.

1. Vectors are checked and keyed by a digest of their components; equal vectors form a class with its count, and only
   the class's smallest id goes on.
2. The second moments of the unit vectors (d x d sums, added up by Spark) give the principal axes; a rotation onto them
   keeps every dot product.
3. Two unit vectors of cosine >= t differ by at most w = sqrt(2 - 2t) on every axis, so a grid of cell width w over the
   three leading axes leaves only neighbouring cells to compare (at most 11^3 cells, so their counts are small). A cell
   of many vectors is cut into blocks of at most `block` rows; a task compares two blocks.
4. Inside a task, blocks lie in the order of the first axis and are compared tile by tile: products are accumulated
   over the leading axes, the rest is bounded by the product of suffix norms, and a tile or pair ends as soon as
   the bound cannot reach t. Survivors' products are complete sums in double precision, and those within
   1e-9 of t are taken again from the vectors as given.
5. A task returns per vector the number of linked vectors and one parent inside the task, never pairs; grouped sums give
   n_links, and the components of the parent links give the classes.

Defined results: null or empty vectors, zero vectors and vectors with null or non-finite components link with nothing (as
does a null id); vectors of different lengths don't link; each of several rows with one id counts as a vector; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import components
from quillgraph.session import bound_batches, materialize

LEAD, TILE = 3, 256


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, key, dim, raw): key and raw are null for vectors that link with nothing."""
    for batch in batches:
        keys, dims, raws = [], [], []
        for x in batch.column(1):
            v = None
            if x.is_valid and len(x.values) and not x.values.null_count:
                v = np.asarray(x.values.to_numpy(zero_copy_only=False), np.float64) + 0.0
            if v is None or not np.isfinite(v).all() or not v.any():
                keys.append(None), dims.append(0), raws.append(None)
            else:
                raw = v.tobytes()
                keys.append(hashlib.blake2b(raw, digest_size=16).digest()), dims.append(len(v)), raws.append(raw)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())],
            names=["id", "key", "dim", "raw"],
        )


def _rows(column, dim: int) -> np.ndarray:
    """The vectors of a binary column as a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, dim)


def _moments(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                u = _unit(_rows(batch.column(0), dim))
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["m"])

    return run


def _place(axes, dim: int, width: float):
    """Adds the grid cell on the leading axes: (id, copies, raw, x, y, z)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = axes.value[:, :LEAD]
        for batch in batches:
            if batch.num_rows:
                at = np.floor(_unit(_rows(batch.column(2), dim)) @ lead / width).astype(np.int32)
                at = np.pad(at, ((0, 0), (0, LEAD - at.shape[1])))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c) for c in at.T]], names=["id", "copies", "raw", "x", "y", "z"])

    return run


def _tile_pairs(a: np.ndarray, b: np.ndarray, sa: np.ndarray, sb: np.ndarray, steps: list[int], t: float):
    """Indices of pairs whose product reaches t - 1e-9, and the products; sa, sb: suffix norms at each step."""
    low = t - 1e-9
    part = a[:, : steps[0]] @ b[:, : steps[0]].T
    i, j = np.nonzero(part + np.outer(sa[:, 0], sb[:, 0]) >= low)
    if not len(i):
        return i, j, part[i, j]
    if len(i) * 8 > part.size:  # most survive: whole products are cheaper than single ones
        full = a @ b.T
        i, j = np.nonzero(full >= low)
        return i, j, full[i, j]
    have = part[i, j]
    for k in range(1, len(steps)):
        have = have + np.einsum("ij,ij->i", a[i, steps[k - 1] : steps[k]], b[j, steps[k - 1] : steps[k]])
        keep = have + sa[i, k] * sb[j, k] >= low
        i, j, have = i[keep], j[keep], have[keep]
    return i, j, have


def _compare(axes, dim: int, t: float):
    width = math.sqrt(2 - 2 * t) + 1e-9
    steps = [s for s in (8, 16, 32) if s < dim] + [dim]

    def prepare(raw) -> tuple:
        x = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, dim)
        r = _unit(x) @ axes.value
        order = np.argsort(r[:, 0], kind="stable")
        r = r[order]
        tails = np.stack([np.sqrt((r[:, s:] ** 2).sum(axis=1)) for s in steps], axis=1)
        return x, r, order, tails

    def exact(x: np.ndarray, y: np.ndarray) -> float:
        return float(x @ y / math.sqrt(x @ x) / math.sqrt(y @ y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same = batch.column(0)[row].as_py()
                ids = [np.asarray(batch.column(c)[row].values) for c in (1, 4)]
                copies = [np.asarray(batch.column(c)[row].values) for c in (2, 5)]
                a = prepare(batch.column(3)[row])
                b = a if same else prepare(batch.column(6)[row])
                degree = [np.zeros(len(ids[0]), np.int64), np.zeros(len(ids[1]), np.int64)]
                found = []
                for p in range(0, len(a[1]), TILE):
                    ra, ta = a[1][p : p + TILE], a[3][p : p + TILE]
                    for q in range(p if same else 0, len(b[1]), TILE):
                        rb, tb = b[1][q : q + TILE], b[3][q : q + TILE]
                        if rb[0, 0] - ra[-1, 0] > width:
                            break
                        if ra[0, 0] - rb[-1, 0] > width:
                            continue
                        i, j, c = _tile_pairs(ra, rb, ta, tb, steps, t)
                        ok = c >= t
                        at = i < j
                        if same and p == q:
                            ok &= at
                        i, j = a[2][p + i], b[2][q + j]
                        for e in np.flatnonzero(np.abs(c - t) <= 1e-9):
                            ok[e] = (not (same and p == q) or at[e]) and exact(a[0][i[e]], b[0][j[e]]) >= t
                        i, j = i[ok], j[ok]
                        np.add.at(degree[0], i, copies[1][j])
                        np.add.at(degree[0] if same else degree[1], j, copies[0][i])
                        found.append((i, j))
                yield _stars(ids, degree, found, same)

    return run


def _stars(ids: list[np.ndarray], degree: list[np.ndarray], found: list, same: bool) -> pa.RecordBatch:
    """(id, links, parent): the smallest id of the vector's component inside the task."""
    na = len(ids[0])
    node = ids[0] if same else np.concatenate(ids)
    i = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
    j = np.concatenate([y for _, y in found]) if found else np.zeros(0, np.int64)
    j = j if same else j + na
    label = node.copy()
    while len(i):
        least = np.minimum(label[i], label[j])
        if (label[i] == least).all() and (label[j] == least).all():
            break
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
    links = degree[0] if same else np.concatenate(degree)
    some = links > 0
    return pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(links[some]), pa.array(label[some])], names=["id", "links", "parent"])


def _link_dim(reps: DataFrame, dim: int, t: float, block: int) -> DataFrame:
    """(id, links, parent) rows of the representatives of one vector length."""
    spark = reps.sparkSession
    mine = reps.where(F.col("dim") == dim)
    sums = (
        mine.select("raw")
        .mapInArrow(_moments(dim), "m array<double>")
        .select(F.posexplode("m").alias("k", "v"))
        .groupBy("k")
        .agg(F.sum("v").alias("v"))
        .orderBy("k")
        .toPandas()
    )
    moments = sums["v"].to_numpy().reshape(dim, dim)
    axes = spark.sparkContext.broadcast(np.ascontiguousarray(np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]))
    width = math.sqrt(2 - 2 * t) + 1e-9
    placed = materialize(
        mine.select("id", "copies", "raw").mapInArrow(_place(axes, dim, width), "id long, copies long, raw binary, x int, y int, z int"), "placed"
    )
    cells = placed.groupBy("x", "y", "z").agg(F.ceil(F.count("*") / block).alias("parts"))
    stored = materialize(
        placed.join(F.broadcast(cells), ["x", "y", "z"])  # at most 11^3 rows
        .withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
        .groupBy("x", "y", "z", "part")
        .agg(F.collect_list("id").alias("ids"), F.collect_list("copies").alias("copies"), F.collect_list("raw").alias("raws"))
        .select(
            "x", "y", "z", "part", "ids", "copies",
            F.unhex(F.array_join(F.transform("raws", F.hex), "")).alias("raw"),
        ),
        "stored",
    )
    around = F.array(
        *[
            F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy"), F.lit(k).alias("dz"))
            for i in (-1, 0, 1)
            for j in (-1, 0, 1)
            for k in (-1, 0, 1)
            if (i, j, k) >= (0, 0, 0)
        ]
    )
    names = ["x", "y", "z", "part"]
    left = stored.select(*[F.col(c).alias(f"a{c}") for c in names], F.explode(around).alias("d")).select(
        *[f"a{c}" for c in names], *[(F.col(f"a{c}") + F.col(f"d.d{c}")).alias(f"b{c}") for c in "xyz"]
    )
    right = stored.select(*[F.col(c).alias(f"b{c}") for c in names])
    same_cell = (F.col("ax") == F.col("bx")) & (F.col("ay") == F.col("by")) & (F.col("az") == F.col("bz"))
    todo = left.join(right, ["bx", "by", "bz"]).where(~same_cell | (F.col("apart") <= F.col("bpart")))
    blobs = lambda s: stored.select(*[F.col(c).alias(s + c) for c in names], *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "copies", "raw")])
    tasks = (
        todo.join(blobs("a"), [f"a{c}" for c in names])
        .join(blobs("b"), [f"b{c}" for c in names])
        .select((same_cell & (F.col("apart") == F.col("bpart"))).alias("same"), "a_ids", "a_copies", "a_raw", "b_ids", "b_copies", "b_raw")
    )
    return tasks.mapInArrow(_compare(axes, dim, t), "id long, links long, parent long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95, block: int = 2048) -> DataFrame:
    """Per row: id, n_links, component_id (smallest id reachable by links), kept (it is its component's smallest)."""
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = materialize(
        vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(
            _check, "id long, key binary, dim int, raw binary"
        ),
        "vectors",
    )
    real = rows.where("key is not null and id is not null")
    reps = materialize(real.groupBy("key", "dim").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("raw").alias("raw")), "reps")
    links = None
    for r in reps.groupBy("dim").count().orderBy("dim").collect():  # lengths of vectors: a property of the table
        one = _link_dim(reps, r["dim"], threshold, block)
        links = one if links is None else links.unionByName(one)
    if links is None:
        links = spark.createDataFrame([], "id long, links long, parent long")
    links = materialize(links, "links", shrink=4)
    comps = components(links.select(F.col("parent").alias("a"), F.col("id").alias("b"))).withColumnRenamed("node", "id")
    sums = links.groupBy("id").agg(F.sum("links").alias("links"))
    of_rep = (
        reps.select("key", "id", "copies")
        .join(sums, "id", "left")
        .join(comps, "id", "left")
        .select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    )
    return rows.select("id", "key").join(of_rep, "key", "left").select(
        F.col("id").alias(id_col),
        F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
