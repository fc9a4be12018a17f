"""Loading of the tables and the code-graph stand-ins that several queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.picks import ranked_pick


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as changes: commit = order, path = part, author = supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("long").alias("added"), F.col("l_linenumber").cast("long").alias("deleted")
    )


def trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from a supplier's to a customer's nation by line items, those at the 90th pick of weight or above."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    w = li.join(s, "l_suppkey").join(o, "l_orderkey").join(c, "o_custkey").where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    return w.crossJoin(F.broadcast(ranked_pick(w, "weight", 0.9, few=True))).where("weight >= pick").select("src", "dst", "weight")


def referrals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between customers: everyone's last order (by date, then key) names the customer of its key's number; all customers and orders."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    last = o.groupBy(F.col("o_custkey").alias("src")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("k"))
    n = c.agg(F.count("*").alias("n"))
    return last.crossJoin(n).select("src", (F.col("k") % F.col("n")).alias("dst"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))


#: SQL of ``referrals`` as e(src, dst) and of what each customer reaches.
REFERRALS = """
e AS (SELECT o_custkey AS src, max_by(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) % (SELECT count(*) FROM customer) AS dst FROM orders GROUP BY 1),
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
ring AS (SELECT r.src AS node, min(b.src) AS component, count(*) AS size FROM reach r JOIN reach b ON b.src = r.dst AND b.dst = r.src GROUP BY 1),
comp AS (SELECT c_custkey AS node, least(c_custkey, coalesce(component, c_custkey)) AS component FROM customer LEFT JOIN ring ON node = c_custkey)"""


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"))


#: SQL of ``trade`` as common table expressions that end in e(src, dst, weight).
TRADE = """
w AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
      JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2),
pick AS (SELECT weight AS p FROM (SELECT weight, row_number() OVER (ORDER BY weight) AS r, count(*) OVER () AS n FROM w) WHERE r = least(n, floor(n * 0.9) + 1)),
e AS (SELECT src, dst, weight FROM w, pick WHERE weight >= p)"""

#: Reach pairs (without reflexive ones unless on a ring) and strongly connected components of e.
REACH = """
reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst),
comp AS (SELECT n_nationkey AS node, least(n_nationkey, coalesce(min(a.dst), n_nationkey)) AS component FROM nation
         LEFT JOIN (SELECT r.src, r.dst FROM reach r JOIN reach b ON r.src = b.dst AND r.dst = b.src) a ON a.src = n_nationkey GROUP BY n_nationkey)"""
