"""Graph operators on the trade graph between nations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..runtime import checkpointed
from .base import REACH, REFERRALS, TRADE, customers, nations, referrals, table, trade


def _edges(spark, sf_dir):
    return checkpointed(trade(spark, sf_dir).select("src", "dst"))


def trade_closure(spark, sf_dir):
    return G.closure(_edges(spark, sf_dir))


def trade_scc(spark, sf_dir):
    return G.scc(_edges(spark, sf_dir), nations(spark, sf_dir))


def trade_rings(spark, sf_dir):
    e = _edges(spark, sf_dir)
    return G.cycles(e, G.scc(e, nations(spark, sf_dir)))


def trade_levels(spark, sf_dir):
    e = _edges(spark, sf_dir)
    comp = G.scc(e, nations(spark, sf_dir))
    return G.levels(G.condense(e, comp), comp.select(F.col("component").alias("node")).distinct())


def trade_paths(spark, sf_dir):
    e = _edges(spark, sf_dir)
    start = e.agg(F.min("src")).first()[0]
    return G.shortest_paths(e, start).select("node", "distance", F.concat_ws(">", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def trade_components(spark, sf_dir):
    return G.connected_components(_edges(spark, sf_dir), nations(spark, sf_dir))


def dead_nations(spark, sf_dir):
    """Nations that trade doesn't reach from region 0."""
    roots = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("node"))
    return nations(spark, sf_dir).join(G.reachable(_edges(spark, sf_dir), roots), "node", "left_anti")


def propagation_cost(spark, sf_dir):
    out = G.propagation(G.reach_counts(_edges(spark, sf_dir), nations(spark, sf_dir)))
    return out.select("n", "ccd", *[F.round(c, 6).alias(c) for c in ("acd", "nccd", "propagation_cost")])


def martin(spark, sf_dir):
    types = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count_if(F.col("c_acctbal") < 0).alias("n_abstract"), F.count("*").alias("n_types"))
    out = G.martin(_edges(spark, sf_dir), nations(spark, sf_dir), types)
    return out.select("node", "ca", "ce", *[F.round(c, 6).alias(c) for c in ("instability", "abstractness", "distance")])


def visibility(spark, sf_dir):
    return G.visibility_roles(checkpointed(G.reach_counts(_edges(spark, sf_dir), nations(spark, sf_dir))))


def modularity(spark, sf_dir):
    part = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("part"))
    return G.modularity(_edges(spark, sf_dir), part).select(F.round("modularity", 6).alias("modularity"))


def smells(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey"), "l_suppkey").groupBy(F.col("s_nationkey").alias("node")).agg(F.count("*").alias("size"))
    out = G.smells(_edges(spark, sf_dir), nations(spark, sf_dir), sizes, hub_degree=2, hub_balance=0.3, god=500)
    return out.select("kind", "component", F.round("severity", 6).alias("severity"))


def degrees(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


def referral_rings(spark, sf_dir):
    """G1, G3 over all customers."""
    e = checkpointed(referrals(spark, sf_dir))
    return G.cycles(e, G.scc(e, customers(spark, sf_dir))).select("component", "node", "size")


def referral_levels(spark, sf_dir):
    """G4, G7 over all customers: how far each is above the ring or the end that it leads to."""
    e = checkpointed(referrals(spark, sf_dir))
    comp = G.scc(e, customers(spark, sf_dir))
    return G.levels(G.condense(e, comp), comp.select(F.col("component").alias("node")).distinct())


def referral_rings_spread(spark, sf_dir):
    """G1, G3 over all customers, never in one task."""
    e = checkpointed(referrals(spark, sf_dir))
    return G.cycles(e, G.scc(e, customers(spark, sf_dir), small=0)).select("component", "node", "size")


def referral_levels_spread(spark, sf_dir):
    """G4, G5, G7 over all customers, never in one task."""
    e = checkpointed(referrals(spark, sf_dir))
    comp = G.scc(e, customers(spark, sf_dir), small=0)
    return G.levels(G.condense(e, comp), comp.select(F.col("component").alias("node")).distinct(), small=0)


def referral_components(spark, sf_dir):
    """G13 over all customers."""
    return G.connected_components(referrals(spark, sf_dir), customers(spark, sf_dir))


def referral_reach(spark, sf_dir):
    """A24-A26 over all customers: what each reaches and is reached by."""
    return G.reach_counts(referrals(spark, sf_dir), customers(spark, sf_dir)).select("node", "fan_out", "fan_in")


def referral_reach_spread(spark, sf_dir):
    """A24-A26 over all customers, never in one task."""
    return G.reach_counts(referrals(spark, sf_dir), customers(spark, sf_dir), small=0).select("node", "fan_out", "fan_in")


def referral_live(spark, sf_dir):
    """G14 over all customers, from those in debt."""
    roots = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("node"))
    return G.reachable(referrals(spark, sf_dir), roots)


QUERIES = {f.__name__: f for f in (trade_closure, trade_scc, trade_rings, trade_levels, trade_paths, trade_components, dead_nations, propagation_cost, martin, visibility, modularity, smells, degrees, referral_rings, referral_rings_spread, referral_levels, referral_levels_spread, referral_components, referral_reach, referral_reach_spread, referral_live)}
_FANS = """
refl AS (SELECT src, dst FROM reach UNION SELECT n_nationkey, n_nationkey FROM nation),
fan AS (SELECT node, component, (SELECT count(*) FROM refl WHERE src = node) AS fan_out, (SELECT count(*) FROM refl WHERE dst = node) AS fan_in FROM comp)"""
_MARTIN = """
m AS (SELECT n_nationkey AS node, (SELECT count(DISTINCT src) FROM e WHERE dst = n_nationkey) AS ca, (SELECT count(DISTINCT dst) FROM e WHERE src = n_nationkey) AS ce FROM nation),
mi AS (SELECT *, coalesce(ce / nullif(ca + ce, 0), 0) AS instability FROM m)"""
ORACLES = {
    "referral_rings": f"WITH RECURSIVE {REFERRALS} SELECT component, node, size FROM ring",
    "referral_levels": f"""WITH RECURSIVE {REFERRALS}, up AS (SELECT DISTINCT a.component AS s, b.component AS d FROM e JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component <> b.component),
        l AS (SELECT DISTINCT component AS node, 0 AS level FROM comp UNION SELECT up.s, l.level + 1 FROM l JOIN up ON up.d = l.node) SELECT node, max(level)::BIGINT AS level FROM l GROUP BY node""",
    "referral_components": f"""WITH RECURSIVE {REFERRALS}, f AS (SELECT src, coalesce(min(dst) FILTER (dst IN (SELECT node FROM ring)), max(dst)) AS home FROM reach GROUP BY 1),
        h AS (SELECT c_custkey AS node, coalesce((SELECT component FROM ring WHERE ring.node = home), home, c_custkey) AS k FROM customer LEFT JOIN f ON src = c_custkey)
        SELECT node, min(node) OVER (PARTITION BY k) AS component FROM h""",
    "referral_reach": f"""WITH RECURSIVE {REFERRALS}, all_ AS (SELECT src, dst FROM reach UNION SELECT c_custkey, c_custkey FROM customer), o AS (SELECT src AS node, count(*) AS fan_out FROM all_ GROUP BY 1), i AS (SELECT dst AS node, count(*) AS fan_in FROM all_ GROUP BY 1)
        SELECT node, fan_out, fan_in FROM o JOIN i USING (node)""",
    "referral_live": f"""WITH RECURSIVE {REFERRALS} SELECT DISTINCT node FROM (SELECT c_custkey AS node FROM customer WHERE c_acctbal < 0 UNION ALL SELECT dst FROM reach JOIN customer ON c_custkey = src WHERE c_acctbal < 0)""",
    "trade_closure": f"WITH RECURSIVE {TRADE}, {REACH} SELECT src, dst FROM reach",
    "trade_scc": f"WITH RECURSIVE {TRADE}, {REACH} SELECT node, component FROM comp",
    "trade_rings": f"WITH RECURSIVE {TRADE}, {REACH} SELECT component, node, size FROM (SELECT *, count(*) OVER (PARTITION BY component) AS size FROM comp) WHERE size > 1",
    "trade_levels": f"""WITH RECURSIVE {TRADE}, {REACH}, ce AS (SELECT DISTINCT a.component AS s, b.component AS d FROM e JOIN comp a ON a.node = src JOIN comp b ON b.node = dst WHERE a.component <> b.component),
        l AS (SELECT DISTINCT component AS node, 0 AS level FROM comp UNION SELECT ce.s, l.level + 1 FROM l JOIN ce ON ce.d = l.node) SELECT node, max(level)::BIGINT AS level FROM l GROUP BY node""",
    "trade_paths": f"""WITH RECURSIVE {TRADE}, p AS (SELECT min(src) AS node, 0 AS distance, [min(src)] AS path FROM e UNION ALL
        SELECT e.dst, distance + 1, list_append(path, e.dst) FROM p JOIN e ON e.src = p.node WHERE NOT list_contains(path, e.dst) AND distance < 6)
        SELECT node, distance::BIGINT AS distance, array_to_string(path, '>') AS path FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY distance, path) AS r FROM p) WHERE r = 1""",
    "trade_components": f"""WITH RECURSIVE {TRADE}, u AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT u.a, x.d FROM u JOIN (SELECT src AS s, dst AS d FROM e UNION SELECT dst, src FROM e) x ON x.s = u.b)
        SELECT a AS node, min(b) AS component FROM u GROUP BY a""",
    "dead_nations": f"""WITH RECURSIVE {TRADE}, r AS (SELECT n_nationkey AS node FROM nation WHERE n_regionkey = 0 UNION SELECT e.dst FROM r JOIN e ON e.src = r.node)
        SELECT n_nationkey AS node FROM nation WHERE n_nationkey NOT IN (SELECT node FROM r)""",
    "propagation_cost": f"""WITH RECURSIVE {TRADE}, {REACH}, {_FANS} SELECT count(*) AS n, sum(fan_out)::BIGINT AS ccd, round(sum(fan_out) / count(*), 6) AS acd,
        round(sum(fan_out) / ((count(*) + 1) * log2(count(*) + 1) - count(*)), 6) AS nccd, round(sum(fan_out) / (count(*) * count(*)), 6) AS propagation_cost FROM fan""",
    "martin": f"""WITH {TRADE}, {_MARTIN}, t AS (SELECT c_nationkey AS node, count(*) FILTER (c_acctbal < 0) / count(*) AS a FROM customer GROUP BY 1)
        SELECT mi.node, ca, ce, round(instability, 6) AS instability, round(a, 6) AS abstractness, round(abs(a + instability - 1), 6) AS distance FROM mi LEFT JOIN t USING (node)""",
    "visibility": f"""WITH RECURSIVE {TRADE}, {REACH}, {_FANS}, ring AS (SELECT component, count(*) AS s, max(fan_in) AS ti, max(fan_out) AS tk FROM fan GROUP BY 1 HAVING count(*) > 1 ORDER BY s DESC, component LIMIT 1),
        b AS (SELECT count(*) AS n, coalesce((SELECT ti FROM ring), median(fan_in)) AS ti, coalesce((SELECT tk FROM ring), median(fan_out)) AS tk FROM fan)
        SELECT node, fan_in, fan_out, CASE WHEN n < 10 THEN NULL WHEN fan_in >= ti AND fan_out >= tk THEN 'core' WHEN fan_in >= ti THEN 'shared' WHEN fan_out >= tk THEN 'control' ELSE 'peripheral' END AS role FROM fan, b""",
    "modularity": f"""WITH {TRADE}, d AS (SELECT node, count(*) AS k FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1), m AS (SELECT 2 * count(*) AS m2 FROM e)
        SELECT round(coalesce(sum(1 - a.k * b.k / m2) / max(m2), 0), 6) AS modularity FROM e JOIN d a ON a.node = src JOIN d b ON b.node = dst JOIN nation x ON x.n_nationkey = src JOIN nation y ON y.n_nationkey = dst, m WHERE x.n_regionkey = y.n_regionkey""",
    "smells": f"""WITH RECURSIVE {TRADE}, {REACH}, {_MARTIN}, tot AS (SELECT *, ca + ce AS total FROM mi), pk AS (SELECT total AS cut FROM (SELECT total, row_number() OVER (ORDER BY total) - 1 AS i, count(*) OVER () AS n FROM tot) WHERE i = least(n - 1, floor(n * 0.9))),
        sz AS (SELECT s_nationkey AS node, count(*) AS size FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1), gp AS (SELECT size AS c FROM (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM sz) WHERE i = least(n - 1, floor(n * 0.9)) AND n >= 10),
        gc AS (SELECT greatest(coalesce(max(c), 500), 500) AS c FROM gp)
        SELECT 'cyclic' AS kind, component, count(*)::DOUBLE AS severity FROM comp GROUP BY component HAVING count(*) > 1
        UNION ALL SELECT 'hub_like', node, total FROM tot, pk WHERE total > cut AND least(ca, ce) >= 2 AND least(ca, ce) >= 0.3 * greatest(ca, ce)
        UNION ALL SELECT 'unstable_dependency', src, round(avg(CASE WHEN b.instability > a.instability THEN 1.0 ELSE 0.0 END), 6) FROM (SELECT DISTINCT src, dst FROM e) JOIN mi a ON a.node = src JOIN mi b ON b.node = dst GROUP BY src HAVING avg(CASE WHEN b.instability > a.instability THEN 1.0 ELSE 0.0 END) >= 0.3
        UNION ALL SELECT 'god_component', node, size FROM sz, gc WHERE size > c""",
    "degrees": f"WITH {TRADE} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1",
}
for _name in ("referral_rings", "referral_levels", "referral_reach"):
    ORACLES[f"{_name}_spread"] = ORACLES[_name]
