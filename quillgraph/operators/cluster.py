"""Clusters: similarity inside and between groups, communities, comparisons and consensus.

Mean similarities never build pairs: with unit vectors, a vector's mean similarity to a group is its product with the group's
sum. Where the distribution over pairs is asked for, groups are cut into blocks and each task returns a histogram of its
block pair's values.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import scalars, vectors
from quillgraph.functions.wordlists import CLASS_KEYWORDS
from quillgraph.session import materialize

OUTLIER_BELOW, MOVE_ABOVE, CENTROID_ABOVE = 0.5, 0.7, 0.55


def _units(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    return rows.where(F.col(vector).isNotNull() & F.col(group).isNotNull()).select(
        F.col(key).alias("key"), F.col(group).alias("grp"), vectors.l2_normalise(F.col(vector)).alias("u")
    )


def group_sums(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """grp, n, total: the sum of each group's unit vectors, by dimension and put together again."""
    parts = _units(rows, key, group, vector).select("grp", F.posexplode("u").alias("d", "x")).groupBy("grp", "d").agg(F.sum("x").alias("x"), F.count("*").alias("n"))
    return parts.groupBy("grp").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("total"))


def mean_cohesion(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """grp, n, mean similarity of different members; 1 for a single one (AG18, NB7)."""
    s = group_sums(rows, key, group, vector)
    return s.select("grp", "n", F.when(F.col("n") > 1, (vectors.dot("total", "total") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(1.0).alias("mean"))


def pair_histogram(rows: DataFrame, key: str, group: str, vector: str, block: int = 512) -> DataFrame:
    """grp, value, times: similarities of different members to four places, and how often (AG18)."""
    u = _units(rows, key, group, vector)
    blocks = u.groupBy("grp").agg(F.ceil(F.count("*") / block).alias("blocks"))
    dealt = (
        u.join(blocks, "grp").withColumn("b", F.pmod(F.xxhash64("key"), F.col("blocks")))
        .withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("grp", "u", "b", F.least("b", "p").alias("lo"), F.greatest("b", "p").alias("hi"))
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        a = np.stack(pdf.loc[pdf["b"] == lo, "u"].to_list()) if (pdf["b"] == lo).any() else np.zeros((0, 1))
        if lo == hi:
            s = (a @ a.T)[np.triu_indices(len(a), 1)]
        elif (pdf["b"] == hi).any() and len(a):
            s = (a @ np.stack(pdf.loc[pdf["b"] == hi, "u"].to_list()).T).ravel()
        else:
            s = np.zeros(0)
        value, times = np.unique(np.round(s, 4) + 0.0, return_counts=True)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(value), "value": value, "times": times})

    kind = dict(u.dtypes)["grp"]
    found = dealt.groupBy("grp", "lo", "hi").applyInPandas(compare, f"grp {kind}, value double, times long")
    return found.groupBy("grp", "value").agg(F.sum("times").alias("times"))


def cohesion(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """grp, n, mean, least, most, p25, p75 of the similarities of different members (AG18)."""
    h = pair_histogram(rows, key, group, vector)
    spread = h.groupBy("grp").agg(
        F.min("value").alias("least"), F.max("value").alias("most"),
        F.expr("percentile(value, 0.25, times)").alias("p25"), F.expr("percentile(value, 0.75, times)").alias("p75"),
    )
    return mean_cohesion(rows, key, group, vector).join(spread, "grp", "left")


def centroid_pairs(rows: DataFrame, key: str, group: str, vector: str, floor: float = CENTROID_ABOVE, most: int = 5000) -> DataFrame:
    """a, b, similarity of group centroids above the floor (AG19); at most `most` groups, counted first."""
    s = materialize(group_sums(rows, key, group, vector).select("grp", "total"), "sums")
    if s.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    other = s.select(F.col("grp").alias("b"), F.col("total").alias("tb"))
    return s.join(F.broadcast(other), F.col("grp") < F.col("b")).select(
        F.col("grp").alias("a"), "b", vectors.cosine("total", "tb").alias("similarity")
    ).where(F.col("similarity") > floor)


def peer_similarity(rows: DataFrame, key: str, group: str, vector: str) -> DataFrame:
    """key, grp, mean similarity to the other members; 1 for a single one (CL16, NB6)."""
    u = _units(rows, key, group, vector)
    return u.join(group_sums(rows, key, group, vector), "grp").select(
        "key", "grp", F.when(F.col("n") > 1, (vectors.dot("u", "total") - 1) / (F.col("n") - 1)).otherwise(1.0).alias("mean")
    )


def outliers(rows: DataFrame, key: str, group: str, vector: str, below: float = OUTLIER_BELOW) -> DataFrame:
    """key, grp, mean, outlierness (1 - mean), the strongest first (CL16)."""
    return peer_similarity(rows, key, group, vector).where(F.col("mean") < below).withColumn("outlierness", 1 - F.col("mean")).orderBy(F.desc("outlierness"), "key")


def regroup(rows: DataFrame, key: str, group: str, vector: str, most: int = 5000) -> DataFrame:
    """key, grp, best, delta, confidence for members whose mean similarity to another group is better (CL17)."""
    u = _units(rows, key, group, vector)
    sums = materialize(group_sums(rows, key, group, vector), "sums")
    if sums.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} groups")
    other = sums.select(F.col("grp").alias("other"), (F.col("n")).alias("m"), F.col("total").alias("t"))
    scored = u.join(F.broadcast(other)).select(
        "key", "grp", "other",
        F.when(F.col("grp") == F.col("other"), F.when(F.col("m") > 1, (vectors.dot("u", "t") - 1) / (F.col("m") - 1)).otherwise(1.0)).otherwise(vectors.dot("u", "t") / F.col("m")).alias("s"),
    )
    own = F.max(F.when(F.col("grp") == F.col("other"), F.col("s"))).alias("own")
    best = F.max(F.when(F.col("grp") != F.col("other"), F.struct("s", (-F.hash("other")).alias("_"), "other"))).alias("b")
    picked = scored.groupBy("key", "grp").agg(own, best).where("b.s > own").select("key", "grp", F.col("b.other").alias("best"), (F.col("b.s") - F.col("own")).alias("delta"))
    picked = materialize(picked, "moves")
    top = picked.agg(F.max("delta").alias("top"))
    return picked.join(F.broadcast(top)).select("key", "grp", "best", "delta", (F.col("delta") / F.col("top")).alias("confidence"))


def apply_moves(membership: DataFrame, moves: DataFrame, above: float = MOVE_ABOVE) -> DataFrame:
    """key, grp after the moves of enough confidence, the best one of each key (CL18)."""
    best = moves.where(F.col("confidence") > above).groupBy("key").agg(F.max_by("best", F.struct("confidence", "best")).alias("to"))
    return membership.join(best, "key", "left").select("key", F.coalesce("to", "grp").alias("grp"))


def cluster_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b, jaccard of clusters of two labelings (node, cluster) that share nodes (CL11)."""
    both = a.toDF("node", "a").join(b.toDF("node", "b"), "node").groupBy("a", "b").agg(F.count("*").alias("both"))
    na, nb = a.toDF("node", "a").groupBy("a").agg(F.count("*").alias("na")), b.toDF("node", "b").groupBy("b").agg(F.count("*").alias("nb"))
    return both.join(na, "a").join(nb, "b").select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def normalised_mutual_information(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row nmi over nodes in both labelings, by the arithmetic mean of entropies; 0 for fewer than two nodes (CL12)."""
    table = materialize(a.toDF("node", "a").join(b.toDF("node", "b"), "node").groupBy("a", "b").agg(F.count("*").alias("n")), "nmi")
    n = F.lit(float(table.agg(F.sum("n")).first()[0] or 0))
    rows, cols = table.groupBy("a").agg(F.sum("n").alias("ra")), table.groupBy("b").agg(F.sum("n").alias("cb"))
    mutual = table.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") / n * F.log(n * F.col("n") / (F.col("ra") * F.col("cb")))).alias("mi"))
    entropy = lambda t, c: t.agg((-F.sum(F.col(c) / n * F.log(F.col(c) / n))).alias(f"h_{c}"))
    one = mutual.join(F.broadcast(entropy(rows, "ra"))).join(F.broadcast(entropy(cols, "cb")))  # one row each
    mean = (F.col("h_ra") + F.col("h_cb")) / 2
    return one.select(F.when((n < 2), 0.0).when(mean == 0, 1.0).otherwise(F.col("mi") / F.nullif(mean, F.lit(0.0))).alias("nmi"))


def best_mapping(a: DataFrame, b: DataFrame, most: int = 2000) -> DataFrame:
    """a, b: the one-to-one mapping of clusters with the largest overlap (CL14); at most `most` clusters a side, counted first."""
    table = a.toDF("node", "a").join(b.toDF("node", "b"), "node").groupBy("a", "b").agg(F.count("*").alias("n"))
    if table.select("a").distinct().limit(most + 1).count() > most or table.select("b").distinct().limit(most + 1).count() > most:
        raise ValueError(f"more than {most} clusters")
    pdf = table.toPandas()
    rows, cols = sorted(pdf["a"].unique()), sorted(pdf["b"].unique())
    size = max(len(rows), len(cols))
    gain = np.zeros((size, size))
    ri, ci = {x: i for i, x in enumerate(rows)}, {x: i for i, x in enumerate(cols)}
    for r, c, n in pdf[["a", "b", "n"]].itertuples(index=False):
        gain[ri[r], ci[c]] = n
    pairs = [(rows[i], cols[j]) for i, j in enumerate(assignment(-gain)) if i < len(rows) and j < len(cols)]
    kinds = dict(table.dtypes)
    return a.sparkSession.createDataFrame(pairs, f"a {kinds['a']}, b {kinds['b']}")


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest assignment of a square matrix, by shortest augmenting paths (Kuhn 1955)."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    match = np.zeros(n + 1, int)  # row matched to each column, 1-based
    for i in range(1, n + 1):
        match[0] = i
        j0, least, used, way = 0, np.full(n + 1, np.inf), np.zeros(n + 1, bool), np.zeros(n + 1, int)
        while match[j0]:
            used[j0] = True
            i0 = match[j0]
            free = ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, least[1:], np.inf))) + 1
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, n + 1):
        out[match[j] - 1] = j - 1
    return out


def modularity(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """One row modularity, coverage for undirected weighted (a, b, weight) and (node, cluster) (AG17)."""
    e = edges.join(membership.toDF("a", "ca"), "a").join(membership.toDF("b", "cb"), "b")
    total = F.lit(float(edges.agg(F.sum("weight")).first()[0] or 0))
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.sum("weight").alias("inside"))
    degree = e.select(F.col("ca").alias("c"), "weight").unionByName(e.select(F.col("cb").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("degree"))
    per = degree.join(inside, "c", "left").withColumn("inside", F.coalesce("inside", F.lit(0.0)))
    return per.agg(
        F.sum(F.col("inside") / total - F.pow(F.col("degree") / (2 * total), F.lit(2))).alias("modularity"), F.sum(F.col("inside") / total).alias("coverage")
    )


def communities(edges: DataFrame, rounds: int = 10, resolution: float = 1.0) -> DataFrame:
    """node, community by local modularity moves over (a, b, weight) (CL1, CL5; Blondel et al. 2008).

    Every round each node of one of two halves (by hash, alternating, so that neighbours don't swap for ever) moves to the
    neighbouring community of the largest gain; ends when neither half moves.
    """
    both = materialize(edges.select("a", "b", "weight").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "both")
    degree = materialize(both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree")), "degree")
    two_m = F.lit(float(degree.agg(F.sum("degree")).first()[0] or 1.0))
    label = materialize(degree.select("node", F.col("node").alias("community")), "label")
    still = 0
    for r in range(2 * rounds):
        volume = label.join(degree, "node").groupBy("community").agg(F.sum("degree").alias("volume"))
        near = both.join(label.toDF("b", "community"), "b").groupBy(F.col("a").alias("node"), "community").agg(F.sum("weight").alias("w"))
        stay = label.withColumn("w", F.lit(0.0)).select("node", "community", "w")
        options = near.unionByName(stay).groupBy("node", "community").agg(F.sum("w").alias("w"))
        scored = (
            options.join(degree, "node").join(volume, "community").join(label.withColumnRenamed("community", "own"), "node")
            .withColumn("others", F.col("volume") - F.when(F.col("community") == F.col("own"), F.col("degree")).otherwise(0.0))
            .withColumn("gain", F.col("w") - resolution * F.col("degree") * F.col("others") / two_m)
        )
        best = scored.groupBy("node", "own").agg(F.max_by("community", F.struct("gain", (F.col("community") == F.col("own")).alias("same"), "community")).alias("to"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == r % 2
        nxt = materialize(best.select("node", F.when(turn, F.col("to")).otherwise(F.col("own")).alias("community"), (turn & (F.col("to") != F.col("own"))).alias("moved")), "label")
        still = 0 if nxt.where("moved").limit(1).count() else still + 1
        label = nxt.select("node", "community")
        if still == 2:
            break
    return label


def utility_metrics(edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """node, relationship, fan and cluster-spread metrics, each divided by its largest (CL2).

    The own node counts as one of the clusters of the callers; overlap is shared clusters over the larger spread.
    """
    e = edges.select("src", "dst", "relationship").distinct()
    into = e.join(clusters.toDF("src", "c"), "src", "left").groupBy(F.col("dst").alias("node"), "relationship").agg(
        F.count("*").alias("fan_in"), F.collect_set("c").alias("in_set")
    )
    out = e.join(clusters.toDF("dst", "c"), "dst", "left").groupBy(F.col("src").alias("node"), "relationship").agg(
        F.count("*").alias("fan_out"), F.collect_set("c").alias("out_set")
    )
    empty = F.array().cast(dict(into.dtypes)["in_set"])
    both = into.join(out, ["node", "relationship"], "full_outer").select(
        "node", "relationship", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"),
        F.coalesce("in_set", empty).alias("in_set"), F.coalesce("out_set", empty).alias("out_set"),
    ).select(
        "node", "relationship", "fan_in", "fan_out", (F.size("in_set") + 1).alias("in_clusters"), F.size("out_set").alias("out_clusters"),
        F.size(F.array_intersect("in_set", "out_set")).alias("shared"),
    )
    top = both.groupBy("relationship").agg(*[F.max(c).alias(f"top_{c}") for c in ("fan_in", "fan_out", "in_clusters", "out_clusters")])
    share = lambda c: F.when(F.col(f"top_{c}") > 0, F.col(c) / F.col(f"top_{c}")).otherwise(0.0)
    return both.join(top, "relationship").select(
        "node", "relationship", *[share(c).alias(c) for c in ("fan_in", "fan_out", "in_clusters", "out_clusters")],
        (F.col("shared") / F.greatest("in_clusters", "out_clusters")).alias("overlap"),
    )


def two_stage(edges: DataFrame, utility: DataFrame) -> DataFrame:
    """node, community: communities without the utility nodes, which then join their neighbours' most frequent one (CL3)."""
    u = utility.select("node")
    rest = edges.join(u.toDF("a"), "a", "left_anti").join(u.toDF("b"), "b", "left_anti")
    base = materialize(communities(rest), "base")
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    votes = both.join(u.toDF("a"), "a", "left_semi").join(base.toDF("b", "community"), "b").groupBy(F.col("a").alias("node"), "community").count()
    return base.unionByName(votes.groupBy("node").agg(F.max_by("community", F.struct("count", "community")).alias("community")))


def co_occurrence(runs: DataFrame, floor: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(a, b, share of the runs that put two classes together, from the floor on; node, class) (CL4); runs: run, node, cluster.

    Nodes with equal labels in all runs are one class, named by its least node, so pairs are made of distinct label
    combinations only; the members of a class are together in every run.
    """
    n = F.lit(float(runs.select("run").distinct().count() or 1))
    signature = runs.groupBy("node").agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("run", "cluster")))), 256).alias("s"))
    names = signature.groupBy("s").agg(F.min("node").alias("class"))
    members = materialize(signature.join(names, "s").select("node", "class"), "classes")
    own = runs.join(members.where("node = class").select("node"), "node", "left_semi")
    a, b = own.select("run", "cluster", F.col("node").alias("a")), own.select("run", "cluster", F.col("node").alias("b"))
    pairs = a.join(b, ["run", "cluster"]).where("a < b").groupBy("a", "b").agg((F.count("*") / n).alias("share"))
    return pairs.where(F.col("share") >= floor), members


def stable_clusters(runs: DataFrame, floor: float = 0.5) -> DataFrame:
    """node, cluster: the components of classes that are together often enough (CL4)."""
    from quillgraph.operators.graph import components

    pairs, members = co_occurrence(runs, floor)
    joined = components(pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))).toDF("class", "component")
    return members.join(joined, "class", "left").select("node", F.coalesce("component", "class").alias("cluster"))


def merge_small(membership: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """membership with clusters under `least` nodes merged into the one they share most edges with (CL4); links: source, target, n."""
    small = membership.groupBy("cluster").count().where(F.col("count") < least).select("cluster")
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")).groupBy("source", "target").agg(F.sum("n").alias("n"))
    to = both.join(small.toDF("source"), "source", "left_semi").join(small.toDF("target"), "target", "left_anti").groupBy(F.col("source").alias("cluster")).agg(
        F.max_by("target", F.struct("n", "target")).alias("to")
    )
    return membership.join(to, "cluster", "left").select("node", F.coalesce("to", "cluster").alias("cluster"))


def consensus(labelings: list[tuple[DataFrame, float]], clusters: int, most: int = 3000) -> DataFrame:
    """node, cluster by average linkage on weighted, row-normalised co-occurrence (CL13, CL15).

    Nodes with the same clusters in all labelings are one class. Only the classes, at most `most` and counted first, reach
    the driver; the linkage is that of the single nodes. A cluster's number is its smallest node's place among all nodes;
    a class gives its smallest nodes away first, and of equal pairs the one whose classes begin with smaller nodes is merged.
    """
    if len(labelings) == 1:
        return labelings[0][0].toDF("node", "cluster")
    spark = labelings[0][0].sparkSession
    rows = None
    for k, (x, _) in enumerate(labelings):
        one = x.toDF("node", "cluster").select("node", F.when(F.col("cluster").isNotNull(), F.struct(F.lit(k).alias("k"), F.col("cluster").cast("string").alias("cluster"))).alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    classes = rows.where("node is not null").groupBy("node").agg(F.array_sort(F.collect_set("x")).alias("x")).select("node", "x", F.sha2(F.to_json("x"), 256).alias("class"))
    classes = materialize(classes, "classes")
    known = classes.groupBy("class").agg(F.count("*").alias("n"), F.min("node").alias("first"), F.first("x").alias("x")).limit(most + 1).collect()
    if len(known) > most:
        raise ValueError(f"consensus linkage takes at most {most} combinations of clusters")
    known.sort(key=lambda r: r["first"])
    column = {x: i for i, x in enumerate(sorted({tuple(x) for r in known for x in r["x"]}))}
    has = np.zeros((len(known), len(column)))
    for i, r in enumerate(known):
        has[i, [column[tuple(x)] for x in r["x"]]] = 1
    n = np.array([r["n"] for r in known], np.int64)
    m = has * np.array([float(labelings[k][1]) for k, _ in column]) @ has.T
    m /= np.maximum(m @ n, 1e-12)[:, None]
    parts = [(known[p]["class"], start, stop, g) for g, pieces in enumerate(_linked(n, (m + m.T) / 2, clusters)) for p, start, stop in pieces]
    shape = "class string, start long, stop long, g long"
    whole = {r["class"]: r["n"] for r in known}
    at_once = [x for x in parts if x[2] - x[1] == whole[x[0]]]
    cut = spark.createDataFrame([x for x in parts if x[2] - x[1] < whole[x[0]]], shape)
    place = F.row_number().over(Window.partitionBy("class").orderBy("node"))
    dealt = classes.join(F.broadcast(cut.select("class").distinct()), "class", "left_semi").select("class", "node", place.alias("place"))
    owned = (
        classes.join(F.broadcast(spark.createDataFrame(at_once, shape)), "class").select("node", "g")
        .unionByName(dealt.join(F.broadcast(cut), "class").where("place > start and place <= stop").select("node", "g"))
    )
    owned = materialize(owned, "consensus")
    least = owned.groupBy("g").agg(F.min("node").alias("least"))
    before = owned.select("node").join(F.broadcast(least), F.col("node") < F.col("least")).groupBy("g").agg(F.count("*").alias("n"))  # a row for each cluster
    number = least.join(before, "g", "left").select("g", F.coalesce("n", F.lit(0)).cast("int").alias("cluster"))
    return owned.join(F.broadcast(number), "g").select("node", "cluster")


def _linked(n: np.ndarray, s: np.ndarray, clusters: int) -> list[list[tuple[int, int, int]]]:
    """Average linkage of n[p] equal nodes of each class p down to so many clusters: lists of (class, from, to) of its nodes.

    A row of s is a class whose left nodes are single, or one cluster. Of two classes the one whose nodes have the smaller
    row sums is more similar inside, so it is one cluster, or one node, before the other's nodes join it one by one.
    """
    own, left, taken, size = s.diagonal().copy(), n.copy(), np.zeros(len(n), np.int64), np.ones(len(n), np.int64)
    pieces: list[list[tuple[int, int, int]]] = [[] for _ in n]
    np.fill_diagonal(s, np.where(left > 1, own, -np.inf))

    def take(p: int, k: int) -> list[tuple[int, int, int]]:
        taken[p] += k
        return [(p, int(taken[p] - k), int(taken[p]))]

    more = int(n.sum()) - max(1, clusters)  # merges
    while more > 0:
        i, j = divmod(int(s.argmax()), len(n))
        if left[i] > 1 and left[j] > 1:
            p = i if own[i] >= own[j] else j
            k = min(int(left[p]) - 1, more)
            pieces[p], size[p], left[p], s[p, p] = take(p, k + 1), k + 1, 1, -np.inf
            more -= k
            continue
        a, b = (i, j) if left[i] == 1 else (j, i)
        pieces[a] = pieces[a] or take(a, 1)
        if left[b] == 1:
            k, joined = 1, int(size[b])
            pieces[a], pieces[b] = pieces[a] + (pieces[b] or take(b, 1)), []
            inside = 0.0
        else:  # as many at once as join before any other pair is more similar
            rest = s.copy()
            rest[a], rest[:, a] = -np.inf, -np.inf
            other = np.delete(s[a], [a, b])
            gap = np.append(size[a] * (s[a, b] - other), size[a] * (s[a, b] - rest.max()))
            slope = np.append(own[b] - np.delete(s[b], [a, b]), own[b] - rest.max())
            falls = slope < 0
            until = np.min(np.maximum(gap[falls], 0) / -slope[falls], initial=float(more))
            k = joined = int(min(left[b], more, int(until) + 1))
            pieces[a] = pieces[a] + take(b, k)
            inside = own[b]
        with_b = (size[a] * s[a, b] + joined * inside) / (size[a] + joined)
        s[a] = (size[a] * s[a] + joined * s[b]) / (size[a] + joined)
        s[a, b], s[a, a] = with_b, -np.inf
        s[:, a] = s[a]
        size[a] += joined
        left[b] -= k
        more -= k
        if left[b] == 0:
            s[b], s[:, b] = -np.inf, -np.inf
        elif left[b] == 1:
            s[b, b] = -np.inf
    return [x for x in pieces if x] + [take(p, 1) for p in range(len(n)) for _ in range(int(n[p] - taken[p]))]


def term_counts(names: DataFrame, group: str, name: str) -> DataFrame:
    """grp, term, n of the significant terms of a group's names (AG20)."""
    return names.select(F.col(group).alias("grp"), F.explode(scalars.name_terms(F.col(name))).alias("term")).groupBy("grp", "term").agg(F.count("*").alias("n"))


def classify_groups(terms: DataFrame, default: str = "Core") -> DataFrame:
    """grp, class: the class whose keywords occur most, the first listed on a tie, the default without any (AG20)."""
    spark = terms.sparkSession
    listed = spark.createDataFrame([(k, i, t) for i, (k, ts) in enumerate(CLASS_KEYWORDS.items()) for t in ts], "class string, ord int, term string")
    hits = terms.join(F.broadcast(listed), "term").groupBy("grp", "class", "ord").agg(F.sum("n").alias("n"))  # the fixed keyword list
    best = hits.groupBy("grp").agg(F.max_by("class", F.struct("n", -F.col("ord"))).alias("class"))
    return terms.select("grp").distinct().join(best, "grp", "left").select("grp", F.coalesce("class", F.lit(default)).alias("class"))


def key_concepts(terms: DataFrame, classes: DataFrame, top: int = 5) -> DataFrame:
    """grp, concepts: the most frequent terms that are no keyword of the group's class, ties by term (AG20)."""
    keywords = F.create_map(*[x for k, ts in CLASS_KEYWORDS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in ts]))])
    rows = terms.join(classes, "grp").where(~F.array_contains(keywords[F.col("class")], F.col("term")))
    w = Window.partitionBy("grp").orderBy(F.desc("n"), "term")
    picked = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= top)
    return picked.groupBy("grp").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), ",").alias("concepts"))


def density(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster, density: distinct inner directed edges over n (n - 1) (AG21)."""
    n = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    inner = (
        edges.select("src", "dst").where("src <> dst").distinct().join(membership.toDF("src", "cluster"), "src").join(membership.toDF("dst", "c2"), "dst")
        .where("cluster = c2").groupBy("cluster").agg(F.count("*").alias("e"))
    )
    return n.join(inner, "cluster", "left").select("cluster", F.when(F.col("n") > 1, F.coalesce("e", F.lit(0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def cluster_links(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """source, target, n: edges between clusters (AG16, AG22)."""
    return (
        edges.join(membership.toDF("src", "source"), "src").join(membership.toDF("dst", "target"), "dst").where("source <> target")
        .groupBy("source", "target").agg(F.count("*").alias("n"))
    )


def size_summary(membership: DataFrame) -> DataFrame:
    """One row: clusters, nodes, least, most, mean, median size (AG16)."""
    sizes = membership.groupBy("cluster").agg(F.count("*").alias("n"))
    return sizes.agg(
        F.count("*").alias("clusters"), F.sum("n").alias("nodes"), F.min("n").alias("least"), F.max("n").alias("most"), F.avg("n").alias("mean"), F.expr("percentile(n, 0.5)").alias("median")
    )


def interfaces(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """cluster, node, direction, n: members that other clusters call or that call other clusters (AG22)."""
    ends = edges.join(membership.toDF("src", "sc"), "src").join(membership.toDF("dst", "dc"), "dst").where("sc <> dc")
    into = ends.groupBy(F.col("dc").alias("cluster"), F.col("dst").alias("node")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("in"))
    out = ends.groupBy(F.col("sc").alias("cluster"), F.col("src").alias("node")).agg(F.count("*").alias("n")).withColumn("direction", F.lit("out"))
    return into.unionByName(out)


def tfidf(docs: DataFrame, key: str, text: str, min_df: float = 0.01, max_df: float = 0.95, features: int = 5000):
    """key, features: TF-IDF of words and word pairs (CL7), with the fitted stages."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, SQLTransformer, StopWordsRemover

    rows = docs.select(key, scalars.clean_text(F.coalesce(F.col(text), F.lit(""))).alias("clean"))
    stages = [
        RegexTokenizer(inputCol="clean", outputCol="raw", pattern=r"\s+"),
        StopWordsRemover(inputCol="raw", outputCol="words"),
        NGram(n=2, inputCol="words", outputCol="pairs"),
        SQLTransformer(statement="SELECT *, concat(words, pairs) AS terms FROM __THIS__"),
        CountVectorizer(inputCol="terms", outputCol="counts", minDF=min_df, maxDF=max_df, vocabSize=features),
        IDF(inputCol="counts", outputCol="features"),
    ]
    model = Pipeline(stages=stages).fit(rows)
    return model.transform(rows).select(key, "counts", "features"), model


def topic_count(n: int) -> int:
    """Topics by the size of the corpus (CL9)."""
    return 5 if n < 100 else 10 if n < 500 else 15 if n < 1000 else 20


def topics(docs: DataFrame, key: str, text: str, k: int | None = None, seed: int = 42):
    """(key with its strongest topic, topic with its top terms) by latent Dirichlet allocation (CL8, CL9)."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.functions import vector_to_array

    rows, model = tfidf(docs, key, text)
    vocabulary = model.stages[4].vocabulary
    rows = materialize(rows, "tfidf")
    lda = LDA(k=k or topic_count(rows.count()), maxIter=10, seed=seed, featuresCol="features").fit(rows)
    best = lda.transform(rows).select(key, vector_to_array("topicDistribution").alias("d")).select(
        key, (F.array_position("d", F.array_max("d")) - 1).cast("int").alias("topic"), F.array_max("d").alias("share")
    )
    words = F.array(*[F.lit(w) for w in vocabulary])
    named = lda.describeTopics(10).select("topic", F.array_join(F.transform("termIndices", lambda i: F.get(words, i)), ",").alias("terms"))
    return best, named


def semantic_clusters(rows: DataFrame, key: str, vector: str, k: int | None = None, seed: int = 42) -> DataFrame:
    """key, cluster by k-means with k = max(2, floor(sqrt(n / 2))) (CL10, CL21)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.where(F.col(vector).isNotNull()).select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))
    k = k or max(2, int((data.count() / 2) ** 0.5))
    return KMeans(k=k, seed=seed, maxIter=20).fit(data).transform(data).select(key, F.col("prediction").alias("cluster"))


def silhouette(rows: DataFrame, clusters: DataFrame, key: str, vector: str) -> float:
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    data = rows.join(clusters, key).select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col("cluster").alias("prediction"))
    return ClusteringEvaluator().evaluate(data)


def centre_named_hierarchy(classes: DataFrame, communities_: DataFrame, central: DataFrame, direct: int = 5) -> DataFrame:
    """parent, child, level: class nodes with at most `direct` groups, else by community named after its most central (CL19).

    classes: grp, class; communities_: grp, community; central: grp, score.
    """
    n = Window.partitionBy("class")
    rows = classes.join(communities_, "grp", "left").join(central, "grp", "left").withColumn("n", F.count("*").over(n))
    head = F.first("grp").over(Window.partitionBy("class", "community").orderBy(F.desc("score"), "grp"))
    rows = rows.withColumn("head", F.concat_ws("/", "class", head))
    few = rows.where(F.col("n") <= direct).select(F.col("class").alias("parent"), F.col("grp").alias("child"), F.lit(1).alias("level"))
    mid = rows.where(F.col("n") > direct).select(F.col("class").alias("parent"), F.col("head").alias("child"), F.lit(1).alias("level")).distinct()
    leaf = rows.where(F.col("n") > direct).select(F.col("head").alias("parent"), F.col("grp").alias("child"), F.lit(2).alias("level"))
    return few.unionByName(mid).unionByName(leaf)


def entity_texts(documents: DataFrame, key: str = "node") -> DataFrame:
    """key, text: brief, details, rationale and returns in one cleaned text; entities without any have no row (CL6)."""
    part = lambda c, name="": F.when(F.col(c) != "", F.concat(F.lit(name), F.col(c)))
    parts = F.concat_ws(" ", part("brief"), part("details"), part("rationale", "Rationale: "), part("returns", "Returns: "))
    return documents.select(key, parts.alias("text")).where("text <> ''").select(key, scalars.clean_text(F.col("text")).alias("text"))


def analyse_clusters(membership: DataFrame, names: DataFrame, edges: DataFrame) -> DataFrame:
    """cluster, name, classification, dominant_type, key_concepts, entity_count, internal_connectivity, frequent_terms (CL20).

    membership: node, cluster; names: node, name, kind. The name joins the two most frequent terms that are no keyword of the
    class, or is the class and the dominant type. Ties go to the lesser term or type.
    """
    rows = membership.join(names, "node")
    terms = term_counts(rows, "cluster", "name").withColumnRenamed("grp", "cluster")
    kinds = rows.groupBy("cluster", "kind").agg(F.count("*").alias("n"))
    dominant = kinds.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("n"), "kind")).getField("kind").alias("dominant_type"))
    classes = classify_groups(terms.withColumnRenamed("cluster", "grp")).toDF("cluster", "classification")
    concepts = key_concepts(terms.withColumnRenamed("cluster", "grp"), classes.toDF("grp", "class")).toDF("cluster", "key_concepts")
    w = Window.partitionBy("cluster").orderBy(F.desc("n"), "term")
    frequent = terms.withColumn("r", F.row_number().over(w)).where("r <= 20").groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("r", "term", "n"))).alias("x"))
    frequent = frequent.select("cluster", F.transform("x", lambda x: F.struct(x["term"].alias("term"), x["n"].alias("n"))).alias("frequent_terms"))
    out = membership.groupBy("cluster").agg(F.count("*").alias("entity_count")).join(dominant, "cluster", "left").join(classes, "cluster", "left")
    out = out.join(concepts, "cluster", "left").join(frequent, "cluster", "left").join(density(edges, membership).withColumnRenamed("density", "internal_connectivity"), "cluster", "left")
    title = F.transform(F.slice(F.split("key_concepts", ","), 1, 2), lambda t: F.initcap(t))
    plain = F.concat_ws(" ", F.coalesce("classification", F.lit("Core")), F.coalesce("dominant_type", F.lit("unknown")))
    return out.select(
        "cluster", F.when(F.col("key_concepts") != "", F.concat_ws(" ", title)).otherwise(plain).alias("name"), F.coalesce("classification", F.lit("Core")).alias("classification"),
        F.coalesce("dominant_type", F.lit("unknown")).alias("dominant_type"), "key_concepts", "entity_count", "internal_connectivity", "frequent_terms",
    )


def class_counts(analysis: DataFrame) -> DataFrame:
    """classification, subsystems, entities, the most subsystems first (NB12); of analyse_clusters rows."""
    return analysis.groupBy("classification").agg(F.count("*").alias("subsystems"), F.sum("entity_count").alias("entities")).orderBy(F.desc("subsystems"), "classification")


def entity_summaries(entities: DataFrame, callers: DataFrame) -> DataFrame:
    """node, summary for prompts: kind and name, signature, brief, details, callers, with bars between (NB13).

    entities: node, kind, name, signature, brief, details; callers: node, caller (a name).
    """
    said = lambda c, label: F.when(F.col(c) != "", F.concat(F.lit(label), F.col(c)))
    called = callers.groupBy("node").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    kind = F.when(F.col("kind") != "", F.col("kind")).otherwise("unknown")
    parts = [
        F.concat(F.lit("["), F.coalesce(kind, F.lit("unknown")), F.lit("] "), F.coalesce("name", F.lit(""))), F.when(F.col("signature") != F.col("name"), said("signature", "Signature: ")),
        said("brief", "Brief: "), said("details", "Details: "), F.transform("callers", lambda c: F.concat(F.lit("Called by: "), c)),
    ]
    return entities.join(called, "node", "left").select("node", F.concat_ws(" | ", *parts).alias("summary"))


def document_entities(membership: DataFrame, key_entities: DataFrame, most: int = 10) -> DataFrame:
    """cluster, node, role: the key entities, filled up with further nodes in their order to at most `most` (NB14)."""
    keys = key_entities.select("cluster", "node").distinct().withColumn("key", F.lit(True))
    w = Window.partitionBy("cluster").orderBy(F.coalesce("key", F.lit(False)).desc(), "node")
    ranked = membership.select("cluster", "node").join(keys, ["cluster", "node"], "left").withColumn("r", F.row_number().over(w))
    return ranked.where(F.col("key") | (F.col("r") <= most)).select("cluster", "node", F.when(F.col("key"), "key").otherwise("sample").alias("role"))


def group_distribution(rows: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """group, measure, statistic, value: mean and quartiles of each measure, one row for each (AG24)."""
    long = rows.unpivot([group], measures, "measure", "x")
    stats = long.groupBy(group, "measure").agg(F.avg("x").alias("mean"), *[F.expr(f"percentile(x, {q})").alias(n) for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))])
    return stats.unpivot([group, "measure"], ["mean", "p25", "p50", "p75"], "statistic", "value")
