"""Change history over line items, and renames over parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import history as H
from .base import changes, table


def file_history(spark, sf_dir):
    return H.file_history(changes(spark, sf_dir))


def _suppliers(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("path"))


def change_coupling(spark, sf_dir):
    out = H.change_coupling(_suppliers(spark, sf_dir), max_files=5, min_support=5, min_confidence=0.03)
    return out.select("a", "b", "support", F.round("confidence", 6).alias("confidence"), F.round("jaccard", 6).alias("jaccard"))


def sum_of_coupling(spark, sf_dir):
    return H.sum_of_coupling(H.change_coupling(_suppliers(spark, sf_dir), max_files=5, min_support=5, min_confidence=0.03))


def ownership(spark, sf_dir):
    return H.ownership(changes(spark, sf_dir)).withColumn("top_share", F.round("top_share", 6))


def bus_factor(spark, sf_dir):
    return H.bus_factor(H.ownership(changes(spark, sf_dir)))


def hotspots(spark, sf_dir):
    complexity = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_retailprice").alias("complexity"))
    return H.hotspots(H.file_history(changes(spark, sf_dir)), complexity, 25).withColumn("score", F.round("score", 6))


def rename_chain(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("old"), F.floor(F.col("p_partkey") / 2).alias("new"))
    return H.rename_chain(p)


def history_filter(spark, sf_dir):
    """P8 and P13 over part names: kept changes by binary flag."""
    li = changes(spark, sf_dir).select("path", (F.col("added") % 10).alias("added"), (F.col("deleted") - 1).alias("deleted"))
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_name", "p_type")
    named = li.join(names, "path").select(F.col("p_name").alias("path"), "added", "deleted", F.lit(None).cast("string").alias("old_path"))
    kept = H.binary_change(H.history_filter(named, ["ring", "bolt"], ["small"]))
    return kept.groupBy("is_binary").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


_COUPLING = """
t AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS p FROM lineitem),
s AS (SELECT k, p FROM t WHERE k IN (SELECT k FROM t GROUP BY k HAVING count(*) <= 5)),
c AS (SELECT p, count(*) AS c FROM s GROUP BY p),
x AS (SELECT a.p AS a, b.p AS b, count(*) AS support FROM s a JOIN s b ON a.k = b.k AND a.p < b.p GROUP BY 1, 2 HAVING count(*) >= 5),
cc AS (SELECT a, b, support, support / least(ca.c, cb.c) AS confidence, support / (ca.c + cb.c - support) AS jaccard
       FROM x JOIN c ca ON ca.p = a JOIN c cb ON cb.p = b WHERE support / least(ca.c, cb.c) >= 0.03)"""
_OWNED = """
b AS (SELECT l_partkey AS path, l_suppkey AS author, count(*) AS n FROM lineitem GROUP BY 1, 2),
sh AS (SELECT *, n / sum(n) OVER (PARTITION BY path) AS share, row_number() OVER (PARTITION BY path ORDER BY n DESC, author) AS r FROM b),
o AS (SELECT path, max(author) FILTER (r = 1) AS top_author, max(share) AS top_share, count(*) AS authors, count(*) FILTER (share < 0.05) AS minors, max(share) < 0.5 AS orphaned FROM sh GROUP BY path)"""

QUERIES = {f.__name__: f for f in (file_history, change_coupling, sum_of_coupling, ownership, bus_factor, hotspots, rename_chain, history_filter)}
ORACLES = {
    "file_history": """SELECT l_partkey AS path, count(*) AS commits, sum(l_quantity::BIGINT)::BIGINT AS added, sum(l_linenumber)::BIGINT AS deleted,
        count(DISTINCT l_suppkey) AS authors, min(l_shipdate) AS first_ts, max(l_shipdate) AS last_ts FROM lineitem GROUP BY 1""",
    "change_coupling": f"WITH {_COUPLING} SELECT a, b, support, round(confidence, 6) AS confidence, round(jaccard, 6) AS jaccard FROM cc",
    "sum_of_coupling": f"WITH {_COUPLING} SELECT path, sum(support)::BIGINT AS soc FROM (SELECT a AS path, support FROM cc UNION ALL SELECT b, support FROM cc) GROUP BY path",
    "ownership": f"WITH {_OWNED} SELECT path, top_author, round(top_share, 6) AS top_share, authors, minors, orphaned FROM o",
    "bus_factor": f"""WITH {_OWNED}, g AS (SELECT top_author, count(*) AS n FROM o GROUP BY 1),
        r AS (SELECT row_number() OVER w AS r, sum(n) OVER (ORDER BY n DESC, top_author ROWS UNBOUNDED PRECEDING) AS cov, sum(n) OVER () AS tot FROM g WINDOW w AS (ORDER BY n DESC, top_author))
        SELECT coalesce(min(r), 0)::BIGINT AS bus_factor FROM r WHERE cov * 2 > tot""",
    "hotspots": """WITH h AS (SELECT l_partkey AS path, count(*) AS commits FROM lineitem GROUP BY 1), j AS (SELECT path, commits, p_retailprice AS complexity FROM h JOIN part ON p_partkey = path)
        SELECT path, commits, complexity, round((commits / (SELECT max(commits) FROM j)) * (complexity / (SELECT max(complexity) FROM j)), 6) AS score FROM j
        ORDER BY (commits / (SELECT max(commits) FROM j)) * (complexity / (SELECT max(complexity) FROM j)) DESC, path LIMIT 25""",
    "rename_chain": """WITH RECURSIVE c AS (SELECT p_partkey AS old, p_partkey // 2 AS cur, 1 AS steps FROM part WHERE p_partkey > 1
        UNION ALL SELECT old, cur // 2, steps + 1 FROM c WHERE cur > 1) SELECT old, cur AS last, steps::BIGINT AS steps FROM c WHERE cur = 1""",
    "history_filter": """SELECT (l_quantity::BIGINT % 10) = 0 AND l_linenumber = 1 AS is_binary, count(*) AS n, count(DISTINCT p_name) AS paths FROM lineitem JOIN part ON p_partkey = l_partkey
        WHERE (p_name LIKE '%ring' OR p_name LIKE '%bolt') AND p_name NOT LIKE '%small%' GROUP BY 1""",
}
