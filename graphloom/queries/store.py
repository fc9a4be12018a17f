"""Table statements, resolution and ring cuts over the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import resolve as R
from ..operators.small_graphs import ring_cuts
from ..runtime import checkpointed, shared_folder
from ..sources import buckets as B
from ..sources import store as S
from ..streaming import ledger as L
from .base import nations, table, trade


def edge_stats(spark, sf_dir):
    """A1, Q6: line items as edges by return flag; big ones have no target."""
    return S.edge_stats(table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.when(F.col("l_quantity") <= 40, F.col("l_partkey")).alias("dst_id")))


def complexity_by_file(spark, sf_dir):
    """A2, Q9."""
    return S.complexity_by_file(table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("metric_key"), F.col("p_size").cast("long").alias("value")), "SMALL")


def entity_scores(spark, sf_dir):
    """A3: the last order of a customer counts (by date, then key)."""
    return S.last_scores(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", ["o_orderdate", "o_orderkey"])


def table_counts(spark, sf_dir):
    """A4, Q14."""
    from functools import reduce

    names = ("region", "nation", "supplier", "part", "orders")
    return reduce(lambda a, b: a.unionByName(b), [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in names])


def resolve_symbols(spark, sf_dir):
    """Orders without a target get the least customer of their name's number."""
    e = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey")).alias("dst_id"), (F.col("o_custkey") % 50).alias("dst_ref"))
    s = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 40).alias("symbol"), F.col("c_custkey").alias("entity_id"))
    return R.resolve_symbols(e, s).select("o_orderkey", "dst_id")


def upsert_latest(spark, sf_dir):
    """K4, Q4: events of the second half over those of the first, one for each user and type."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    mid = F.lit(400)
    return S.upsert(e.where(F.col("event_id") < mid), e.where(F.col("event_id") >= mid), ["user_id", "event_type"], "event_id")


def replace_and_prune(spark, sf_dir):
    """K1, K5: rows of even suppliers replaced by their big ones, then suppliers in debt pruned; counts by supplier."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), "l_quantity")
    new = li.where((F.col("path") % 2 == 0) & (F.col("l_quantity") > 30))
    seen = table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("path"))
    return S.prune(S.replace_paths(li, new), seen).groupBy("path").agg(F.count("*").alias("n"))


def bucketed_replace(spark, sf_dir):
    """K1, K5, Q2, Q3: as ``replace_and_prune``, on a table in 32 buckets by supplier of which writes touch what they must."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), "l_quantity")
    root = f"{shared_folder(li).rstrip('/')}/graphloom/store-{uuid.uuid4().hex}"
    B.create(li, root, buckets=32)
    B.replace(li.where((F.col("path") % 2 == 0) & (F.col("l_quantity") > 30)), root)
    B.prune_unseen(table(spark, sf_dir, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("path")), root)
    return B.read(spark, root).groupBy("path").agg(F.count("*").alias("n"))


def occurrence_numbers(spark, sf_dir):
    """Customers of one nation and segment, numbered."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("path"), F.lit("k").alias("kind"), F.col("c_mktsegment").alias("qualified_name"), F.col("c_custkey").alias("start_byte"))
    return S.occurrence_numbers(c).select("start_byte", F.col("occurrence").cast("long").alias("occurrence"))


def name_ladder(spark, sf_dir):
    """Customers as sites in the file of their nation, named by balance. Household ones are written through FURNITURE, which
    every nation imports, the poorer ones through a receiver. Customers of the first region declare, those of machinery as members
    of FURNITURE; nation n republishes n div 2. Those in debt import their name."""
    c = table(spark, sf_dir, "customer").withColumn("name", F.concat(F.lit("n"), F.floor(F.col("c_acctbal") / 20).cast("string")))
    n = table(spark, sf_dir, "nation")
    path = F.col("c_nationkey").alias("path")
    qualifier = F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.when(F.col("c_acctbal") < 3000, "it").otherwise("FURNITURE"))
    sites = c.select(F.col("c_custkey").alias("site"), path, "name", qualifier.alias("qualifier"))
    first = n.where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"))
    member = F.col("c_mktsegment") == "MACHINERY"
    decl = c.join(first, "c_nationkey", "left_semi").select(F.col("c_custkey").alias("entity"), path, "name", F.concat(F.when(member, "p.FURNITURE.").otherwise("p."), "name").alias("qualified_name"), (~member).alias("top"))
    imports = c.where("c_acctbal < 0").select(path, "name", (F.col("c_custkey") % 25).cast("int").alias("file"), F.col("c_custkey").alias("at"))
    every = n.select(F.col("n_nationkey").alias("path"), F.lit("FURNITURE").alias("name"), ((F.col("n_nationkey") + 3) % 25).alias("file"), F.lit(0).cast("long").alias("at"))
    any_ = n.select(F.col("n_nationkey").alias("path"), F.lit(None).cast("string").alias("name"), ((F.col("n_nationkey") + 1) % 25).alias("file"), F.lit(0).cast("long").alias("at"))
    again = n.select(F.col("n_nationkey").alias("file"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("target"))
    external = c.where("c_acctbal > 9000").select(path, "name").union(n.where("n_regionkey = 3").select("n_nationkey", F.lit("it")))
    out = R.name_ladder(sites, decl, imports.union(every).union(any_), external, again)
    return out.select("site", "entity", "file", "rung", "candidates", F.round("confidence", 6).alias("confidence"))


def call_outcomes(spark, sf_dir):
    """Orders as call sites at (customer, date), big ones as occurrences."""
    o = table(spark, sf_dir, "orders")
    at = o.groupBy(F.col("o_custkey").cast("string").alias("path"), F.year("o_orderdate").alias("line")).agg(F.max("o_totalprice").alias("v"), F.min("o_orderkey").alias("k")).withColumn("col", F.lit(0))
    occ = at.where("v > 200000").select("path", F.col("line").alias("start_line"), F.col("col").alias("start_char"), F.when(F.col("k") % 2 == 0, "s").otherwise("t").alias("symbol"), F.lit(0).alias("roles"))
    sites = at.select("path", "line", "col", F.when(F.col("k") % 3 != 0, F.col("k")).alias("caller"))
    out = R.calls(sites, occ, spark.createDataFrame([("s", "e")], "symbol string, entity string"))
    return out.groupBy("outcome").agg(F.count("*").alias("n"))


def confident_edges(spark, sf_dir):
    """P10: kept and left edges in one pass."""
    e = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") <= 40, F.col("l_partkey")).alias("dst_id"), F.when(F.col("l_returnflag") == "R", "L2").otherwise("L1").alias("resolution"), F.when(F.col("l_linestatus") == "O", 1.0).otherwise(0.5).alias("confidence"))
    return e.agg(F.count("*").alias("n")).crossJoin(R.confident(e).agg(F.count("*").alias("kept")))


def trade_ring_cuts(spark, sf_dir):
    """The least cut of each ring of the trade graph."""
    e = checkpointed(trade(spark, sf_dir).select("src", "dst"))
    rings = G.cycles(e, G.scc(e, nations(spark, sf_dir))).select("component", "node")
    return ring_cuts(e, rings)


QUERIES = {f.__name__: f for f in (edge_stats, complexity_by_file, entity_scores, table_counts, resolve_symbols, upsert_latest, replace_and_prune, bucketed_replace, occurrence_numbers, name_ladder, call_outcomes, confident_edges, trade_ring_cuts)}
ORACLES = {
    "edge_stats": "SELECT l_returnflag AS kind, count(*) AS n, count(*) FILTER (l_quantity <= 40) AS resolved FROM lineitem GROUP BY 1",
    "complexity_by_file": "SELECT p_brand AS path, sum(p_size)::BIGINT AS value FROM part WHERE p_type = 'SMALL' GROUP BY 1",
    "entity_scores": "SELECT o_custkey, o_totalprice AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1",
    "table_counts": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("region", "nation", "supplier", "part", "orders")),
    "resolve_symbols": "WITH s AS (SELECT c_custkey % 40 AS k, min(c_custkey) AS m FROM customer GROUP BY 1) SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN o_custkey ELSE m END AS dst_id FROM orders LEFT JOIN s ON k = o_custkey % 50",
    "upsert_latest": "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY 1, 2",
    "replace_and_prune": """SELECT l_suppkey AS path, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal >= 0
        WHERE l_suppkey % 2 = 1 OR l_quantity > 30 OR l_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity > 30) GROUP BY 1""",
    "occurrence_numbers": "SELECT c_custkey AS start_byte, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_custkey) - 1 AS occurrence FROM customer",
    "name_ladder": """WITH RECURSIVE c AS (SELECT *, 'n' || floor(c_acctbal / 20)::BIGINT AS name, c_nationkey AS path FROM customer),
        s AS (SELECT c_custkey AS site, path, name, CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN CASE WHEN c_acctbal < 3000 THEN 'it' ELSE 'FURNITURE' END END AS q FROM c),
        g AS (SELECT *, coalesce(q, name) AS governing FROM s),
        d AS (SELECT c_custkey AS entity, path AS file, name, c_mktsegment = 'MACHINERY' AS member FROM c JOIN nation ON n_nationkey = path AND n_regionkey = 0),
        l AS (SELECT file, name, count(*) AS n, min(entity) AS entity FROM d WHERE NOT member GROUP BY 1, 2),
        b AS (SELECT path, name AS governing, c_custkey % 25 AS file, min(c_custkey) AS place FROM c WHERE c_acctbal < 0 GROUP BY 1, 2, 3 UNION ALL SELECT n_nationkey, 'FURNITURE', (n_nationkey + 3) % 25, 0 FROM nation),
        i AS (SELECT path, file FROM b UNION SELECT n_nationkey, (n_nationkey + 1) % 25 FROM nation),
        w AS (SELECT n_nationkey AS start, n_nationkey AS file, 0 AS hops FROM nation UNION ALL SELECT start, file // 2, hops + 1 FROM w WHERE file > 0),
        r1 AS (SELECT site, entity, path AS file, 1 AS rung, n FROM s JOIN l ON l.file = path AND l.name = s.name WHERE q IS NULL),
        o AS (SELECT * FROM g WHERE site NOT IN (SELECT site FROM r1) AND NOT EXISTS (SELECT 1 FROM c WHERE c_acctbal > 9000 AND c.path = g.path AND c.name = g.governing)
              AND NOT (g.governing = 'it' AND g.path IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3))),
        near AS (SELECT * FROM o WHERE q IS NULL OR q = 'FURNITURE'),
        r2m AS (SELECT site, min(entity) AS entity, min_by(d.file, entity) AS file, 2 AS rung, count(DISTINCT entity) AS n FROM near JOIN b ON b.path = near.path AND b.governing = near.governing JOIN d ON d.file = b.file AND d.name = near.name AND member WHERE q IS NOT NULL GROUP BY site),
        r2b AS (SELECT site, entity, file, 2 AS rung, n FROM (SELECT site, l.entity, l.file, l.n, row_number() OVER (PARTITION BY site ORDER BY hops, place, start) AS k
              FROM near JOIN b ON b.path = near.path AND b.governing = near.governing JOIN w ON w.start = b.file JOIN l ON l.file = w.file AND l.name = near.name WHERE site NOT IN (SELECT site FROM r2m)) WHERE k = 1),
        r3 AS (SELECT site, entity, file, 3 AS rung, n FROM (SELECT site, l.entity, l.file, l.n, row_number() OVER (PARTITION BY site ORDER BY l.file) AS k
              FROM near JOIN i ON i.path = near.path JOIN l ON l.file = i.file AND l.name = near.name WHERE site NOT IN (SELECT site FROM r2m UNION SELECT site FROM r2b)) WHERE k = 1),
        r4 AS (SELECT site, min(entity) AS entity, min_by(d.file, entity) AS file, 4 AS rung, count(*) AS n FROM o JOIN d ON d.name = o.name WHERE site NOT IN (SELECT site FROM r2m UNION SELECT site FROM r2b UNION SELECT site FROM r3) GROUP BY site)
        SELECT site, entity, file, rung, n AS candidates, round(1 / n, 6) AS confidence FROM (SELECT * FROM r1 UNION ALL SELECT * FROM r2m UNION ALL SELECT * FROM r2b UNION ALL SELECT * FROM r3 UNION ALL SELECT * FROM r4)""",
    "call_outcomes": """WITH a AS (SELECT o_custkey, year(o_orderdate) AS y, max(o_totalprice) AS v, min(o_orderkey) AS k FROM orders GROUP BY 1, 2)
        SELECT CASE WHEN k % 3 = 0 THEN 'no_caller' WHEN v <= 200000 THEN 'unmatched' WHEN k % 2 = 1 THEN 'no_target' ELSE 'joined' END AS outcome, count(*) AS n FROM a GROUP BY 1""",
    "confident_edges": "SELECT count(*) AS n, count(*) FILTER (l_quantity <= 40 AND (l_returnflag = 'R' OR l_linestatus = 'O')) AS kept FROM lineitem",
}
ORACLES["bucketed_replace"] = ORACLES["replace_and_prune"]


def incomplete_seen(spark, sf_dir):
    """Customers in debt as incomplete paths, those with an order as the scan's."""
    owing = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("path"))
    return S.still_incomplete(owing, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path")))


def repairs(spark, sf_dir):
    """Y2, K7: users as sessions, days as runs, event types as keys with the day's greatest value; what a day no longer has is repaired."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), F.to_date("ts").alias("run"), F.col("event_type").alias("key"), "value")
    out = L.repairs_at_once(e, ["session"])
    return out.select("session", F.col("run").cast("string").alias("run"), "key", "attempts", L.trend(F.transform("values", lambda v: F.floor(v))).alias("trend"))


QUERIES |= {f.__name__: f for f in (incomplete_seen, repairs)}
ORACLES["incomplete_seen"] = "SELECT c_custkey AS path FROM customer WHERE c_acctbal < 0 INTERSECT SELECT o_custkey FROM orders"
ORACLES["repairs"] = """WITH e AS (SELECT user_id AS session, ts::DATE AS run, event_type AS key, floor(max("value"))::BIGINT AS v FROM events GROUP BY 1, 2, 3),
    r AS (SELECT session, run, row_number() OVER (PARTITION BY session ORDER BY run) AS n FROM (SELECT DISTINCT session, run FROM e)),
    k AS (SELECT e.*, n, n - row_number() OVER (PARTITION BY e.session, key ORDER BY n) AS stretch FROM e JOIN r ON r.session = e.session AND r.run = e.run),
    s AS (SELECT session, key, stretch, max(n) AS last, count(*) AS attempts, list(v ORDER BY n) AS vs FROM k GROUP BY 1, 2, 3)
    SELECT s.session, r.run::VARCHAR AS run, key, attempts, array_to_string(vs[-8:], ' -> ') AS trend FROM s JOIN r ON r.session = s.session AND r.n = last + 1"""
