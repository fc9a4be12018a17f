"""Class, call and ledger operators over parts, line items and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classes as C
from ..streaming.ledger import ledger_at_once
from .base import TRADE, nations, table, trade


def lcom(spark, sf_dir):
    """class = customer, method = priority, field = month of an order; open orders call the first method, the last
    constructs, and every class declares the first quarter."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cls"), F.col("o_orderpriority").alias("method"), F.month("o_orderdate").alias("field"), "o_orderstatus")
    calls = o.where("o_orderstatus = 'P'").select("cls", "method", F.lit("1-URGENT").alias("callee"))
    declared = o.select("cls", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("field")).distinct()
    out = C.cohesion(o.select("cls", "method", "field"), calls=calls, fields=declared, constructors=("5-LOW",))
    return out.select("cls", "methods", "fields", "lcom1", "lcom2", "lcom3", "lcom4", F.round("lcom_star", 6).alias("lcom_star"), F.round("connectivity", 6).alias("connectivity"))


def inheritance(spark, sf_dir):
    """Part n extends part n div 2; part 1 extends an unknown one."""
    p = table(spark, sf_dir, "part").where("p_partkey > 0").select(F.col("p_partkey").alias("cls"))
    return C.inheritance_depth(p.select("cls", F.when(F.col("cls") == 1, -1).otherwise(F.floor(F.col("cls") / 2)).alias("base")), p)


def subclasses(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cls"))
    return C.children(p.where("cls > 1").select("cls", F.floor(F.col("cls") / 2).alias("base")), p)


def call_fans(spark, sf_dir):
    """A30, T8 on the trade graph."""
    return C.fans(trade(spark, sf_dir))


def class_sizes(spark, sf_dir):
    """Nations as classes, suppliers as methods, balances over 5000 as two decisions."""
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("cls"), F.when(F.col("s_acctbal") > 5000, 2).otherwise(1).alias("cyclomatic"))
    return C.size_of_classes(nations(spark, sf_dir).withColumnRenamed("node", "cls"), m)


def split_types(spark, sf_dir):
    """Brands as directories, types as names, parts as paths; the smallest size declares."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("directory"), F.lit("x").alias("language"), F.col("p_type").alias("name"), F.col("p_partkey").alias("path"), (F.col("p_size") == 1).alias("declares"))
    return C.merge_split_types(p)


def shredding(spark, sf_dir):
    """Parts as functions called by part n div 4; scores from sizes, odd parts private."""
    p = table(spark, sf_dir, "part")
    f = p.select(F.col("p_partkey").alias("entity"), F.lit("f").alias("path"), F.col("p_partkey").cast("string").alias("name"), (F.col("p_size") % 4).alias("score"), ((F.col("p_partkey") % 3) != 0).alias("private"))
    return C.shredding(f, p.where("p_partkey > 3").select(F.floor(F.col("p_partkey") / 4).alias("src"), F.col("p_partkey").alias("dst")))


def attempt_ledger(spark, sf_dir):
    """Y2, Y4, W6 over all events at once: attempts and last eight values of each key."""
    out = ledger_at_once(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return out.select("user_id", "event_type", "attempts", F.concat_ws(",", F.transform("values", lambda v: v.cast("string"))).alias("last_values"), "exhausted")


QUERIES = {f.__name__: f for f in (lcom, inheritance, subclasses, call_fans, class_sizes, split_types, shredding, attempt_ledger)}
ORACLES = {
    "lcom": """WITH RECURSIVE u AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS m, month(o_orderdate) AS f FROM orders),
        m AS (SELECT DISTINCT c, m FROM u), own AS (SELECT c, f FROM u UNION SELECT c, q.f FROM (SELECT DISTINCT c FROM u) x, (VALUES (1), (2), (3)) q(f)),
        pair AS (SELECT a.c, a.m AS x, b.m AS y FROM m a JOIN m b ON a.c = b.c AND a.m < b.m),
        call AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS x, '1-URGENT' AS y FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority <> '1-URGENT'),
        duo AS (SELECT c, x, y, EXISTS (SELECT 1 FROM u a JOIN u b ON a.f = b.f AND a.c = b.c WHERE a.c = p.c AND a.m = x AND b.m = y) AS shares,
                 EXISTS (SELECT 1 FROM call k WHERE k.c = p.c AND (k.x = p.x AND k.y = p.y OR k.x = p.y AND k.y = p.x)) AS calls FROM pair p),
        part AS (SELECT c, m FROM m WHERE m <> '5-LOW' OR c IN (SELECT c FROM m GROUP BY c HAVING count(*) FILTER (m <> '5-LOW') = 0)),
        step AS (SELECT b.c, x, y, shares FROM duo b JOIN part p ON p.c = b.c AND p.m = x JOIN part q ON q.c = b.c AND q.m = y WHERE shares OR calls),
        way AS (SELECT c, x, y, shares FROM step UNION ALL SELECT c, y, x, shares FROM step),
        r3 AS (SELECT c, m, m AS t FROM part UNION SELECT r.c, r.m, w.y FROM r3 r JOIN way w ON w.c = r.c AND w.x = r.t AND w.shares),
        r4 AS (SELECT c, m, m AS t FROM part UNION SELECT r.c, r.m, w.y FROM r4 r JOIN way w ON w.c = r.c AND w.x = r.t),
        l3 AS (SELECT c, count(DISTINCT k) AS n FROM (SELECT c, m, min(t) AS k FROM r3 GROUP BY 1, 2) GROUP BY 1), l4 AS (SELECT c, count(DISTINCT k) AS n FROM (SELECT c, m, min(t) AS k FROM r4 GROUP BY 1, 2) GROUP BY 1),
        g AS (SELECT c, count(*) AS n FROM m GROUP BY 1), fs AS (SELECT c, count(*) AS n FROM own GROUP BY 1), t AS (SELECT c, count(*) AS n FROM u GROUP BY 1),
        e AS (SELECT c, count(*) FILTER (NOT shares) AS off, count(*) FILTER (shares) AS on_, count(*) FILTER (shares OR calls) AS e FROM duo GROUP BY 1)
        SELECT g.c AS cls, g.n AS methods, fs.n AS fields, coalesce(off, 0) AS lcom1, greatest(0, coalesce(off - on_, 0)) AS lcom2, l3.n AS lcom3, l4.n AS lcom4,
        CASE WHEN g.n > 1 THEN round((t.n / fs.n - g.n) / (1 - g.n), 6) END AS lcom_star, CASE WHEN g.n >= 3 THEN round(2 * (e - (g.n - 1)) / ((g.n - 1) * (g.n - 2)), 6) END AS connectivity
        FROM g JOIN fs USING (c) JOIN t USING (c) JOIN l3 USING (c) JOIN l4 USING (c) LEFT JOIN e USING (c)""",
    "inheritance": "WITH RECURSIVE d AS (SELECT 1::BIGINT AS cls, 1::BIGINT AS dit UNION ALL SELECT p_partkey, dit + 1 FROM d JOIN part ON p_partkey // 2 = cls AND p_partkey > 1) SELECT cls, dit, true AS external FROM d",
    "subclasses": "SELECT a.p_partkey AS cls, count(b.p_partkey) AS noc FROM part a LEFT JOIN part b ON b.p_partkey // 2 = a.p_partkey AND b.p_partkey > 1 GROUP BY 1",
    "call_fans": f"WITH {TRADE}, i AS (SELECT dst AS k, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS k, count(*) AS n FROM e GROUP BY 1) SELECT coalesce(i.k, o.k) AS entity, coalesce(i.n, 0) AS fan_in, coalesce(o.n, 0) AS fan_out FROM i FULL JOIN o ON i.k = o.k",
    "class_sizes": "SELECT n_nationkey AS cls, count(s_suppkey) AS nom, coalesce(sum(CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_suppkey IS NOT NULL THEN 1 END), 0)::BIGINT AS wmc FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "split_types": "SELECT p_brand AS directory, 'x' AS language, p_type AS name, coalesce(min(p_partkey) FILTER (p_size = 1), min(p_partkey)) AS home, count(DISTINCT p_partkey) AS files FROM part GROUP BY 1, 2, 3",
    "shredding": """WITH RECURSIVE f AS (SELECT p_partkey AS k, p_size % 4 AS score, p_partkey % 3 <> 0 AS priv FROM part), h AS (SELECT k, score FROM f WHERE priv AND score <= 2 AND k > 3),
        w AS (SELECT k, k // 4 AS r FROM h UNION ALL SELECT w.k, w.r // 4 FROM w JOIN h ON h.k = w.r), t AS (SELECT w.k, r, h.score FROM w JOIN h ON h.k = w.k WHERE r NOT IN (SELECT k FROM h)),
        g AS (SELECT r, count(*) AS helpers, median(score) AS mid, sum(score) AS s FROM t GROUP BY 1 HAVING count(*) >= 3 AND median(score) <= 2) SELECT r AS root, helpers, (s + f.score)::BIGINT AS total FROM g JOIN f ON f.k = r""",
    "attempt_ledger": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
        SELECT user_id, event_type, max(n) AS attempts, string_agg(event_id::VARCHAR, ',' ORDER BY r DESC) AS last_values, max(n) > 3 AS exhausted FROM e WHERE r <= 8 GROUP BY 1, 2""",
}
