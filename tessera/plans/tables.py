"""Inputs of the operators, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user, item, n: parts that a customer ordered, as long ids."""
    orders, lines = load(spark, sf_dir, "orders"), load(spark, sf_dir, "lineitem")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).groupBy(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


def purchase_graph(spark: SparkSession, sf_dir: str, pairs: DataFrame | None = None) -> DataFrame:
    """src, dst, weight: customers (2k) and parts (2k + 1), an edge each way; from ``pairs`` (user, item, n) if they are there."""
    user, item = 2 * F.col("user"), 2 * F.col("item") + 1
    ends = lambda a, b: F.struct(a.alias("src"), b.alias("dst"), F.col("n").alias("weight"))
    pairs = bought(spark, sf_dir) if pairs is None else pairs
    return pairs.select(F.explode(F.array(ends(user, item), ends(item, user))).alias("e")).select("e.*")


PURCHASES = """bought AS (SELECT o_custkey AS u, l_partkey AS i, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
edges AS (SELECT 2 * u AS src, 2 * i + 1 AS dst, n AS weight FROM bought UNION ALL SELECT 2 * i + 1, 2 * u, n FROM bought),
nodes AS (SELECT DISTINCT src AS id FROM edges)"""


def _lines_after(lines: DataFrame, key: str, name: str) -> DataFrame:
    """Lines, each with ``name``, the key of a line that is next in its order; rows for all of those.

    A window's frame holds the lines of the next number, so that lines are shuffled and sorted once.
    """
    onward = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rangeBetween(1, 1)
    known = lines.filter("l_orderkey is not null and l_linenumber is not null")
    return known.withColumn(name, F.collect_list(key).over(onward)).withColumn(name, F.explode(name))


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, amount: directed edges supplier to supplier, from each line of an order to the next."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    joined = _lines_after(lines, "l_suppkey", "dst")
    return joined.filter("l_suppkey <> dst").groupBy(F.col("l_suppkey").alias("src"), "dst").agg(F.sum("l_quantity").alias("amount"))


SUPPLIES = """edges AS (SELECT a.l_suppkey AS src, b.l_suppkey AS dst, sum(a.l_quantity) AS amount FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY 1, 2)"""


def together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst (src < dst): parts on neighbouring lines of one order."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    j = _lines_after(lines, "l_partkey", "q").filter("l_partkey <> q")
    return j.select(F.least("l_partkey", "q").alias("src"), F.greatest("l_partkey", "q").alias("dst")).distinct()


TOGETHER = """pairs AS (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS src, greatest(a.l_partkey, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
ways AS (SELECT src, dst FROM pairs UNION ALL SELECT dst, src FROM pairs),
deg AS (SELECT src AS id, count(*) AS degree FROM ways GROUP BY 1)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vec, label."""
    e = load(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("int").alias("label"))


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the label returned (1 if the flag is R) and the numeric columns."""
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
