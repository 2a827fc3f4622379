"""What several operators share: byte tables, hashing, components of a link graph."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.session import materialize, release

#: Lower-cases A-Z and leaves every other byte of UTF-8 alone.
LOWER_AZ = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased runs without space and \\t to \\r, as UTF-8."""
    return text.translate(LOWER_AZ).split() if text else []


def fold_of(id_col: str, folds: int = 5):
    """crc32 of the id as text modulo folds; a null id counts as empty text (crc32 0)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def forget_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files and broadcasts of plans that nothing refers to any more.

    The collection also gives back the driver's heap that plans of many steps leave behind.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of links(a, b): rows (node, component), component the smallest reachable id.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until the links are stars. Each step is
    a grouped minimum with map-side combine and a join that adaptive execution splits where one node has
    very many links. Rows with a null end or a = b are ignored; no rows give no rows.
    """
    pairs = materialize(
        links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "cc", shrink=4
    )
    for _ in range(rounds):
        both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = (
            both.join(low, "a")
            .where("b > a")
            .select(F.col("m").alias("a"), "b")
            .where("a < b")
            .distinct()
        )
        # large has (m, b) with m < b: small-star groups by the larger end
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(low, "b")
        small = (
            joined.select(F.col("m").alias("x"), F.col("a").alias("y"))
            .unionByName(low.select(F.col("m").alias("x"), F.col("b").alias("y")))
            .where("x < y")
            .distinct()
            .select(F.col("x").alias("a"), F.col("y").alias("b"))
        )
        nxt = materialize(small, "cc", shrink=16)
        # Done when every node hangs on one root that hangs on nothing itself.
        roots = nxt.select(F.col("a").alias("b")).distinct()
        open_ = nxt.join(roots, "b", "left_semi").limit(1).count()
        multi = nxt.groupBy("b").count().where("count > 1").limit(1).count() if not open_ else 1
        release(pairs)
        pairs = nxt
        if not open_ and not multi:
            break
    else:
        raise RuntimeError("components did not converge")
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).unionByName(
        pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    )
