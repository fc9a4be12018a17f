"""Concentration and risk over customers, orders and parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.picks import ranked_pick, top_rows
from ..operators import distribution as D
from .base import table


def risk_profile(spark, sf_dir):
    """Orders over 300,000 weighted by their line items, by nation of the customer."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("sloc"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = orders.join(lines.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "left").join(cust, "o_custkey").join(nation, "c_nationkey")
    return D.risk_profile(rows, "o_totalprice", "sloc", 300000.0, ["n_name"]).withColumn("share_over", F.round("share_over", 6))


def _spend(spark, sf_dir):
    spend = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spend"))
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    return spend.join(cust, "o_custkey")


def gini_by_segment(spark, sf_dir):
    return D.gini(_spend(spark, sf_dir), "spend", ["segment"]).withColumn("gini", F.round("gini", 6))


def erosion_at_10pct(spark, sf_dir):
    return D.erosion(_spend(spark, sf_dir), "spend", ["segment"]).withColumn("erosion", F.round("erosion", 6))


def structural_erosion(spark, sf_dir):
    out = D.structural_erosion(_spend(spark, sf_dir), "o_custkey", "spend", ["segment"])
    return out.select("segment", "count", F.round("total", 2).alias("total"), "worst", F.round("gini", 6).alias("gini"), F.round("erosion", 6).alias("erosion"))


def coupling_distribution(spark, sf_dir):
    """Parts as classes, line items as cbo, suppliers as rfc, small parts as exact."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("cbo"), F.countDistinct("l_suppkey").alias("rfc"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_partkey").alias("name"), "p_brand", F.when(F.col("p_size") <= 25, "EXACT").otherwise("APPROX").alias("exactness"))
    return D.coupling_profile(li.join(part, "l_partkey"), ["p_brand"])


def god_cutoff(spark, sf_dir):
    """A27 over order counts of customers, floor 3."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("size"))
    return D.god_cutoff(n, "size", 3)


def hub_percentile(spark, sf_dir):
    """The 90th pick of total price by priority."""
    return ranked_pick(table(spark, sf_dir, "orders"), "o_totalprice", 0.9, ["o_orderpriority"], "p90")


def worst_entities(spark, sf_dir):
    """The filter stands below the limit."""
    o = table(spark, sf_dir, "orders").where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")
    return top_rows(o, [F.desc("o_totalprice"), F.col("o_orderkey")], 20)


QUERIES = {f.__name__: f for f in (risk_profile, gini_by_segment, erosion_at_10pct, structural_erosion, coupling_distribution, god_cutoff, hub_percentile, worst_entities)}
_SPEND = "sp AS (SELECT o_custkey, c_mktsegment AS segment, sum(o_totalprice) AS x FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"
_GINI = "g AS (SELECT segment, 2 * sum(i * x) / (count(*) * sum(x)) - (count(*) + 1) / count(*) AS gini, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY x) AS i FROM sp) GROUP BY 1)"
_EROSION = "er AS (SELECT segment, sum(x) FILTER (r <= greatest(1, ceil(n * 0.1))) / sum(x) AS erosion FROM (SELECT *, row_number() OVER (PARTITION BY segment ORDER BY x DESC) AS r, count(*) OVER (PARTITION BY segment) AS n FROM sp) GROUP BY 1)"
ORACLES = {
    "risk_profile": """WITH l AS (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1), r AS (SELECT n_name, o_totalprice AS v, greatest(coalesce(c, 0), 1) AS w FROM orders LEFT JOIN l ON l_orderkey = o_orderkey
        JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
        SELECT n_name, count(*) AS entities, sum(w)::BIGINT AS weight, sum(CASE WHEN v > 300000 THEN w ELSE 0 END)::BIGINT AS weight_over, count(*) FILTER (v > 300000) AS offenders,
        round(sum(CASE WHEN v > 300000 THEN w ELSE 0 END) / sum(w), 6) AS share_over FROM r GROUP BY 1""",
    "gini_by_segment": f"WITH {_SPEND}, {_GINI} SELECT segment, round(gini, 6) AS gini, n FROM g",
    "erosion_at_10pct": f"WITH {_SPEND}, {_EROSION} SELECT segment, round(erosion, 6) AS erosion FROM er",
    "structural_erosion": f"""WITH {_SPEND}, {_GINI}, {_EROSION}, b AS (SELECT segment, count(*) AS count, round(sum(x), 2) AS total, arg_max(o_custkey, x) AS worst FROM sp GROUP BY 1)
        SELECT b.*, round(gini, 6) AS gini, round(erosion, 6) AS erosion FROM b JOIN g USING (segment) JOIN er USING (segment)""",
    "coupling_distribution": """WITH c AS (SELECT l_partkey AS name, count(*) AS cbo, count(DISTINCT l_suppkey) AS rfc FROM lineitem GROUP BY 1),
        j AS (SELECT c.*, p_brand, p_size <= 25 AS ex FROM c JOIN part ON p_partkey = name),
        k AS (SELECT p_brand, count(*) FILTER (ex) AS exact, count(*) FILTER (NOT ex) AS bounded FROM j GROUP BY 1),
        ws AS (SELECT p_brand, name AS worst FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY cbo DESC, rfc DESC, name) AS r FROM j) WHERE r = 1),
        o AS (SELECT p_brand, cbo, row_number() OVER (PARTITION BY p_brand ORDER BY cbo) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM j WHERE ex),
        d AS (SELECT p_brand, max(cbo) AS max, max(cbo) FILTER (i = least(n - 1, floor(n * 0.5))) AS median, max(cbo) FILTER (i = least(n - 1, floor(n * 0.9))) AS p90 FROM o GROUP BY 1)
        SELECT k.p_brand, exact, bounded, worst, max, median, p90 FROM k JOIN ws USING (p_brand) LEFT JOIN d USING (p_brand)""",
    "god_cutoff": """WITH s AS (SELECT count(*) AS c FROM orders GROUP BY o_custkey), o AS (SELECT c, row_number() OVER (ORDER BY c) - 1 AS i, count(*) OVER () AS n FROM s)
        SELECT CASE WHEN max(n) < 10 THEN 3 ELSE greatest(max(c) FILTER (i = least(n - 1, floor(n * 0.9))), 3) END AS cutoff FROM o""",
    "hub_percentile": """SELECT o_orderpriority, o_totalprice AS p90 FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) - 1 AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
        WHERE i = least(n - 1, floor(n * 0.9))""",
    "worst_entities": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
}
