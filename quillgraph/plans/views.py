"""The driver tables as a knowledge graph: entities, edges and their SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, column: str):
    return F.concat(F.lit(f"{prefix}:"), F.col(column).cast("string"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, name, kind, capability: customers, parts, suppliers, nations and regions."""
    t = lambda n: table(spark, sf_dir, n)
    nation = F.broadcast(t("nation").select("n_nationkey", F.col("n_name").alias("capability")))  # 25 rows
    return (
        t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(_id("c", "c_custkey").alias("node"), F.col("c_name").alias("name"), F.lit("customer").alias("kind"), "capability")
        .unionByName(t("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(_id("s", "s_suppkey").alias("node"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"), "capability"))
        .unionByName(t("part").select(_id("p", "p_partkey").alias("node"), F.col("p_name").alias("name"), F.lit("part").alias("kind"), F.col("p_brand").alias("capability")))
        .unionByName(t("nation").select(_id("n", "n_nationkey").alias("node"), F.col("n_name").alias("name"), F.lit("nation").alias("kind"), F.lit(None).cast("string").alias("capability")))
        .unionByName(t("region").select(_id("r", "r_regionkey").alias("node"), F.col("r_name").alias("name"), F.lit("region").alias("kind"), F.lit(None).cast("string").alias("capability")))
    )


NODES_SQL = """nodes AS (
  SELECT 'c:' || c_custkey AS node, c_name AS name, 'customer' AS kind, n_name AS capability FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 's:' || s_suppkey, s_name, 'supplier', n_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'p:' || p_partkey, p_name, 'part', p_brand FROM part
  UNION ALL SELECT 'n:' || n_nationkey, n_name, 'nation', NULL FROM nation
  UNION ALL SELECT 'r:' || r_regionkey, r_name, 'region', NULL FROM region)"""


def _calls(spark: SparkSession, sf_dir: str, key) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("back"))
    sold = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    pairs = F.array(
        F.struct(key("c", "o_custkey").alias("src"), key("p", "l_partkey").alias("dst")),
        F.struct(key("p", "l_partkey").alias("src"), key("s", "l_suppkey").alias("dst")),
        F.when(F.col("back"), F.struct(key("s", "l_suppkey").alias("src"), key("c", "o_custkey").alias("dst"))),
    )
    return sold.select(F.explode(pairs).alias("e")).where("e is not null").select("e.*")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: a customer calls the parts ordered, a part its suppliers, a supplier the customers who returned its parts."""
    return _calls(spark, sf_dir, _id).distinct()


#: Kinds of nodes as the high bits of a code.
KINDS, KIND_BIT = "cpsnr", 60


def _code(prefix: str, column: str):
    return F.col(column).cast("long") + F.lit(KINDS.index(prefix) << KIND_BIT)


def call_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """calls() with nodes as longs, for keys below 2 to the 59, and repeated as the lines repeat them: a third of the bytes."""
    return _calls(spark, sf_dir, _code)


def supplier_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(_code("s", "s_suppkey").alias("node"))


def code_of(node: str):
    """A node's code."""
    return F.substring(node, 3, 20).cast("long") + F.shiftleft((F.instr(F.lit(KINDS), F.substring(node, 1, 1)) - 1).cast("long"), KIND_BIT)


def supplier_of(code: str):
    """The name of a supplier's code."""
    return F.concat(F.lit("s:"), (F.col(code) - F.lit(KINDS.index("s") << KIND_BIT)).cast("string"))


CALLS_SQL = """sold AS (SELECT o_custkey, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
calls AS (SELECT DISTINCT 'c:' || o_custkey AS src, 'p:' || l_partkey AS dst FROM sold
  UNION SELECT 'p:' || l_partkey, 's:' || l_suppkey FROM sold
  UNION SELECT 's:' || l_suppkey, 'c:' || o_custkey FROM sold WHERE l_returnflag = 'R')"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, relationship: calls, contained_by, uses (brand) and inherits (type)."""
    t = lambda n: table(spark, sf_dir, n)
    rel = lambda df, a, b, r: df.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relationship"))
    return (
        calls(spark, sf_dir).withColumn("relationship", F.lit("calls"))
        .unionByName(rel(t("customer"), _id("c", "c_custkey"), _id("n", "c_nationkey"), "contained_by"))
        .unionByName(rel(t("supplier"), _id("s", "s_suppkey"), _id("n", "s_nationkey"), "contained_by"))
        .unionByName(rel(t("nation"), _id("n", "n_nationkey"), _id("r", "n_regionkey"), "contained_by"))
        .unionByName(rel(t("part"), _id("p", "p_partkey"), _id("b", "p_brand"), "uses"))
        .unionByName(rel(t("part"), _id("p", "p_partkey"), _id("t", "p_type"), "inherits"))
    )


EDGES_SQL = f"""{CALLS_SQL},
edges AS (SELECT src, dst, 'calls' AS relationship FROM calls
  UNION ALL SELECT 'c:' || c_custkey, 'n:' || c_nationkey, 'contained_by' FROM customer
  UNION ALL SELECT 's:' || s_suppkey, 'n:' || s_nationkey, 'contained_by' FROM supplier
  UNION ALL SELECT 'n:' || n_nationkey, 'r:' || n_regionkey, 'contained_by' FROM nation
  UNION ALL SELECT 'p:' || p_partkey, 'b:' || p_brand, 'uses' FROM part
  UNION ALL SELECT 'p:' || p_partkey, 't:' || p_type, 'inherits' FROM part)"""
