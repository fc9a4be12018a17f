"""Rules, contracts and the ratchet over the trade graph, line items and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import gate
from ..plans import rules as R
from ..plans.rules import Atom, Compare, Rule, V
from .base import TRADE, table, trade


def _facts(spark, sf_dir):
    region = table(spark, sf_dir, "region")
    layer = table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("path"), F.col("r_name").alias("layer"))
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE"]
    pairs = lambda rows, *cols: spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols))
    return {
        "imports": trade(spark, sf_dir).select("src", "dst"),
        "layer": layer,
        "in_contract": pairs([("c", n) for n in names], "contract", "layer"),
        "allowed_edge": gate.allowed_edges("c", names, spark),
        "forbidden_edge": pairs([("c", "EUROPE", "ASIA"), ("c", "ASIA", "AMERICA")], "contract", "from_layer", "to_layer"),
        "independent": pairs([("c", "AFRICA"), ("c", "MIDDLE EAST")], "contract", "layer"),
        "package": pairs([("c", "ASIA")], "contract", "layer"),
        "entrypoint_match": spark.createDataFrame([("c", 8), ("c", 9)], "contract string, path int"),
    }


def _contract(rule):
    def query(spark, sf_dir):
        return R.evaluate([rule], _facts(spark, sf_dir)).select("rule", "path", "entity")

    return query


def ceiling_rule(spark, sf_dir):
    """R5 on line items of suppliers in debt: quantity above 45, strictly."""
    li = table(spark, sf_dir, "lineitem").select(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), "l_suppkey", "l_quantity")
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    facts = {"entity": li.select("id", "l_suppkey"), "metric": li.select("id", "l_quantity"), "rich": rich}
    rule = Rule("quantity", {"entity": V("Id"), "value": V("Value")}, (Atom("entity", (V("Id"), V("Supplier"))), Atom("metric", (V("Id"), V("Value"))), Atom("rich", (V("Supplier"),), negated=True), Compare(V("Value"), ">", 45)))
    return R.evaluate([rule], facts).select("rule", "entity", F.col("value").cast("double").alias("value"))


def gated_ceilings(spark, sf_dir):
    """R5 with the full body: kinds, exactness, blocking and ceilings by brand."""
    part = table(spark, sf_dir, "part")
    facts = {
        "entity": part.select("p_partkey", "p_brand", "p_type", "p_name", "p_size"),
        "callable": spark.createDataFrame([("ECONOMY",), ("SMALL",)], "kind string"),
        "metric": part.select("p_partkey", F.lit("price").alias("key"), "p_retailprice", F.when(F.col("p_size") <= 25, "EXACT").otherwise("APPROX").alias("exactness"), F.when(F.col("p_size") % 2 == 0, "lower").otherwise("exact").alias("bound")),
        "blocking": spark.createDataFrame([(e, b, e == "EXACT" or b == "lower") for e in ("EXACT", "APPROX") for b in ("exact", "lower")], "exactness string, bound string, may boolean"),
        "ceiling": part.select(F.lit("price").alias("rule"), F.col("p_brand").alias("path"), F.lit(500.0).alias("limit")).distinct(),
    }
    out = R.evaluate([R.ceiling_rule("price", "callable", "price")], facts)
    return out.groupBy("path", "blocking").agg(F.count("*").alias("findings"), F.round(F.max(F.col("value").cast("double")), 2).alias("worst"))


def reflexion_absent(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return gate.reflexion(f["imports"], f["layer"], f["allowed_edge"])


def ungoverned(spark, sf_dir):
    f = _facts(spark, sf_dir)
    return gate.ungoverned(f["layer"], f["in_contract"])


def _totals(spark, sf_dir, late):
    o = table(spark, sf_dir, "orders")
    o = o.where(F.col("o_orderdate") >= "1997-01-01") if late else o.where(F.col("o_orderdate") < "1997-01-01")
    return o.groupBy(F.col("o_custkey").cast("string").alias("key")).agg(F.max("o_totalprice").alias("value"))


def ratchet(spark, sf_dir):
    now = _totals(spark, sf_dir, True).withColumn("rule", F.lit("total"))
    return gate.ratchet(now, _totals(spark, sf_dir, False)).select("key", "value", "recorded", "state")


def review_counts(spark, sf_dir):
    base = _totals(spark, sf_dir, False)
    now = gate.ratchet(_totals(spark, sf_dir, True).withColumn("rule", F.lit("total")), base)
    return gate.review_counts(gate.introduced(now, base))


def layer_assignment(spark, sf_dir):
    """Documents by the first layer whose globs match source/lang."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"))
    layers = [("front", ["src1*"]), ("english", ["*/en"]), ("odd", ["src[3579]/*"])]
    return d.groupBy(gate.layer_of(F.col("path"), layers).alias("layer")).agg(F.count("*").alias("files"))


def tightened_ceilings(spark, sf_dir):
    """Segment ceilings against decisions drawn from orders."""
    c = table(spark, sf_dir, "customer")
    ceilings = c.select(F.lit("price").alias("rule"), F.col("c_mktsegment").alias("path")).distinct().withColumn("limit", F.lit(200.0))
    decisions = c.where("c_nationkey < 5").select(F.lit("price").alias("rule"), F.col("c_mktsegment").alias("path"), (F.col("c_nationkey") * 60.0 + 100).alias("limit"), F.col("c_nationkey").alias("decision"))
    return gate.tightened(ceilings, decisions)


QUERIES = {
    "contract_layered": _contract(R.contract_rule("layered", "c")),
    "contract_forbidden": _contract(R.contract_rule("forbidden", "c")),
    "contract_independence": _contract(R.contract_rule("independence", "c")),
    "contract_deep_import": _contract(R.contract_rule("deep", "c")),
} | {f.__name__: f for f in (ceiling_rule, gated_ceilings, reflexion_absent, ungoverned, ratchet, review_counts, layer_assignment, tightened_ceilings)}
_LAYERS = f"""{TRADE}, l AS (SELECT n_nationkey AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey),
x AS (SELECT src, dst, a.r AS l1, b.r AS l2 FROM e JOIN l a ON a.n = src JOIN l b ON b.n = dst)"""
_FOUR = "('AFRICA', 'AMERICA', 'ASIA', 'EUROPE')"
_RATCHET = """b AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate < '1997-01-01' GROUP BY 1), w AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderdate >= '1997-01-01' GROUP BY 1),
r AS (SELECT w.k::VARCHAR AS key, w.v AS value, b.v AS recorded, CASE WHEN b.v IS NULL THEN 'new' WHEN w.v > b.v THEN 'regressed' ELSE 'forgiven' END AS state FROM w LEFT JOIN b ON b.k = w.k)"""
_HEAD = "src::VARCHAR AS path, dst::VARCHAR AS entity FROM x WHERE"
ORACLES = {
    "contract_layered": f"WITH {_LAYERS} SELECT 'layered:c' AS rule, {_HEAD} l1 IN {_FOUR} AND l2 IN {_FOUR} AND l1 > l2",
    "contract_forbidden": f"WITH {_LAYERS} SELECT 'forbidden:c' AS rule, {_HEAD} (l1 = 'EUROPE' AND l2 = 'ASIA') OR (l1 = 'ASIA' AND l2 = 'AMERICA')",
    "contract_independence": f"WITH {_LAYERS} SELECT 'independence:c' AS rule, {_HEAD} l1 IN ('AFRICA', 'MIDDLE EAST') AND l2 IN ('AFRICA', 'MIDDLE EAST') AND l1 <> l2",
    "contract_deep_import": f"WITH {_LAYERS} SELECT 'deep:c' AS rule, {_HEAD} l2 = 'ASIA' AND l1 <> 'ASIA' AND dst NOT IN (8, 9)",
    "ceiling_rule": """SELECT DISTINCT 'quantity' AS rule, concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS entity, l_quantity::DOUBLE AS value FROM lineitem
        WHERE l_quantity > 45 AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
    "gated_ceilings": """SELECT p_brand AS path, CASE WHEN p_size <= 25 OR p_size % 2 = 0 THEN 'true' ELSE 'false' END AS blocking, count(*) AS findings, round(max(p_retailprice), 2) AS worst FROM part
        WHERE p_type IN ('ECONOMY', 'SMALL') AND p_retailprice > 500 GROUP BY 1, 2""",
    "reflexion_absent": f"""WITH {_LAYERS}, s AS (SELECT l1, l2, count(*) AS c FROM x WHERE l1 <> l2 GROUP BY 1, 2), d AS (SELECT a.column0 AS l1, b.column0 AS l2 FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE')) a(column0) JOIN (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE')) b(column0) ON a.column0 < b.column0)
        SELECT coalesce(s.l1, d.l1) AS from_layer, coalesce(s.l2, d.l2) AS to_layer, coalesce(c, 0) AS edges, CASE WHEN c IS NULL THEN 'absent' WHEN d.l1 IS NOT NULL THEN 'convergent' ELSE 'divergent' END AS kind FROM s FULL JOIN d ON s.l1 = d.l1 AND s.l2 = d.l2""",
    "ungoverned": f"SELECT n_nationkey AS path, r_name AS layer FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name NOT IN {_FOUR}",
    "ratchet": f"WITH {_RATCHET} SELECT * FROM r",
    "review_counts": f"WITH {_RATCHET} SELECT count(*) FILTER (state = 'new') AS new, count(*) FILTER (state = 'regressed') AS regressed, count(*) FILTER (state = 'forgiven') AS forgiven, count(*) FILTER (recorded IS NULL) AS introduced FROM r",
    "layer_assignment": """SELECT CASE WHEN source LIKE 'src1%' THEN 'front' WHEN lang = 'en' THEN 'english' WHEN regexp_matches(source, '^src[3579]$') THEN 'odd' END AS layer, count(*) AS files FROM documents GROUP BY 1""",
    "tightened_ceilings": """WITH d AS (SELECT c_mktsegment AS path, min(c_nationkey) AS k FROM customer WHERE c_nationkey < 5 GROUP BY 1)
        SELECT 'price' AS rule, s.path, CASE WHEN k * 60.0 + 100 < 200 THEN k * 60.0 + 100 ELSE 200.0 END::DOUBLE AS "limit", CASE WHEN k * 60.0 + 100 < 200 THEN k END AS decision FROM (SELECT DISTINCT c_mktsegment AS path FROM customer) s LEFT JOIN d USING (path)""",
}
