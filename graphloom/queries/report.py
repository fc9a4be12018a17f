"""Reports, gate, statements and resolution on stand-ins from whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators import context as X
from ..operators import imports as I
from ..operators import reports as R
from ..plans import facts as P
from ..sources import config as C
from ..sources import statements as Q
from .base import REFERRALS, TRADE, nations, referrals, table, trade
from .code import _FILES, _files

ORACLES: dict[str, str] = {}
_PATH = "'src/' || replace(p_brand, '#', '') || '.py'"


def _entities(spark, sf_dir):
    """Parts as entities of their brand's file; types are their kinds."""
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type") == "SMALL", "class").when(F.col("p_type") == "LARGE", "interface").when(F.col("p_type") == "MEDIUM", "method").when(F.col("p_type") == "ECONOMY", "module").otherwise("function")
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."), F.col("p_partkey").cast("string"))
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py"))
    return p.select(F.col("p_partkey").alias("id"), path.alias("file_path"), kind.alias("kind"), name.alias("qualified_name"), "p_size", "p_retailprice", "p_type", "p_brand")


_ENT = f"""ent AS (SELECT p_partkey AS id, {_PATH} AS path, CASE p_type WHEN 'SMALL' THEN 'class' WHEN 'LARGE' THEN 'interface' WHEN 'MEDIUM' THEN 'method' WHEN 'ECONOMY' THEN 'module' ELSE 'function' END AS kind,
    replace(p_name, ' ', '_') || '.' || p_partkey AS name, p_size, p_retailprice, p_type FROM part)"""


def _metrics(spark, sf_dir):
    """Prices as cognitive complexity, sizes as lines, types as exactness."""
    e = _entities(spark, sf_dir)
    how = F.when(F.col("p_type").isin("SMALL", "MEDIUM"), "EXACT").otherwise("APPROX")
    side = F.when(F.col("p_size") % 2 == 0, "lower").otherwise("exact")
    both = F.array(F.struct(F.lit("cognitive_complexity").alias("k"), (F.col("p_retailprice") / 60).alias("v")), F.struct(F.lit("sloc").alias("k"), (F.col("p_size") * 2.0).alias("v")), F.struct(F.lit("nom").alias("k"), (F.col("p_size") / 2).alias("v")))
    rows = e.select(F.col("id").alias("entity_id"), "file_path", how.alias("exactness"), side.alias("bound"), F.explode(both).alias("m"))
    return rows.select("entity_id", "file_path", F.col("m.k").alias("metric_key"), F.col("m.v").alias("value"), "exactness", "bound", F.array(F.lit("first"), F.col("m.k")).alias("explanation"))


def metrics_report(spark, sf_dir):
    """The dearest entities of the files of ten brands."""
    paths = table(spark, sf_dir, "part").where(F.col("p_brand").startswith("Brand#1")).select(F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".py")).alias("path"))
    none = spark.createDataFrame([], "path string, metric_key string, value double")
    out = R.metrics_report("cognitive_complexity", _metrics(spark, sf_dir), _entities(spark, sf_dir), none, 20, paths)
    return out.select("scope", "qualified_name", "path", F.round("value", 6).alias("value"))


ORACLES["metrics_report"] = f"WITH {_ENT} SELECT 'entity' AS scope, name AS qualified_name, path, round(p_retailprice / 60, 6) AS value FROM ent WHERE path LIKE 'src/Brand1%' ORDER BY p_retailprice DESC, name, path LIMIT 20"


def file_ranking(spark, sf_dir):
    """Brands by their line items."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    m = li.groupBy(F.col("p_brand").alias("path")).agg(F.count("*").cast("double").alias("value")).withColumn("metric_key", F.lit("churn"))
    return R.metrics_report("churn", _metrics(spark, sf_dir), _entities(spark, sf_dir), m, 5).select("path", "value")


ORACLES["file_ranking"] = "SELECT p_brand AS path, count(*)::DOUBLE AS value FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 ORDER BY value DESC, path LIMIT 5"


def class_ranking(spark, sf_dir):
    """Suppliers by balance, those in debt without one; with their place."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("cls"), F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("lcom_star"))
    return R.rank_classes(s, limit=None).limit(10).select("cls", "lcom_star")


ORACLES["class_ranking"] = "SELECT s_suppkey AS cls, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS lcom_star FROM supplier ORDER BY lcom_star DESC NULLS LAST, cls LIMIT 10"


def findings_shown(spark, sf_dir):
    """The five dearest orders, and how many more there are."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return R.shown(o, [F.desc("o_totalprice"), F.col("o_orderkey").asc()]).select("o_orderkey", F.col("position").cast("long").alias("position"), "more")


ORACLES["findings_shown"] = "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position, (SELECT count(*) - 5 FROM orders) AS more FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 5"


def entity_places(spark, sf_dir):
    """Each part's place in its brand's file by byte range, enclosing ones first, of one range by key (the SQL leaves that open)."""
    e = table(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 7).alias("start_byte"), (F.col("p_size") * 1000 + F.col("p_partkey")).alias("end_byte"))
    return e.select("p_partkey", F.row_number().over(Window.partitionBy("p_brand").orderBy(*Q.entity_order(), "p_partkey")).cast("long").alias("place"))


ORACLES["entity_places"] = "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 7, p_size * 1000 + p_partkey DESC) AS place FROM part"


def _edges(spark, sf_dir):
    """Line items as edges: kinds by line number, targets of small ones, local symbols by return flag."""
    li = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("calls", "references", "overrides", "implements", "imports", "calls", "references"))), (F.col("l_linenumber") % 7 + 1).cast("int"))
    ref = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("local "), F.col("l_linenumber").cast("string"))).otherwise("sym")
    return li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("src_id"), kind.alias("kind"), F.when(F.col("l_quantity") <= 40, F.col("l_partkey")).alias("dst_id"), ref.alias("dst_ref"), F.lit("L2").alias("resolution"), F.lit(1.0).alias("confidence"))


_EDGES = "edg AS (SELECT l_suppkey AS src_id, ['calls', 'references', 'overrides', 'implements', 'imports', 'calls', 'references'][l_linenumber % 7 + 1] AS kind, CASE WHEN l_quantity <= 40 THEN l_partkey END AS dst_id, l_returnflag = 'A' AS loc FROM lineitem)"


def edge_statements(spark, sf_dir):
    """Q17-Q21: rows of each statement over all edges."""
    e = _edges(spark, sf_dir)
    parts = {"calls": Q.call_edges(e), "dispatch": Q.dispatch_sources(e), "references": Q.reference_edges(e), "kept": Q.without_lost_references(e), "local": Q.local_calls(e)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("statement"), "n")
        out = row if out is None else out.unionByName(row)
    return out


ORACLES["edge_statements"] = f"""WITH {_EDGES} SELECT 'calls' AS statement, count(*) AS n FROM edg WHERE kind = 'calls' UNION ALL SELECT 'dispatch', count(DISTINCT src_id) FROM edg WHERE kind IN ('overrides', 'implements')
    UNION ALL SELECT 'references', count(*) FROM (SELECT DISTINCT src_id, dst_id FROM edg WHERE kind = 'references' AND dst_id IS NOT NULL) UNION ALL SELECT 'kept', count(*) FROM edg WHERE NOT (kind = 'references' AND dst_id IS NULL)
    UNION ALL SELECT 'local', count(*) FROM edg WHERE kind = 'calls' AND dst_id IS NULL AND loc"""


def file_statements(spark, sf_dir):
    """Q1-Q3, Q13, Q15, Q16: a file's row, tables without it, tables with it put again, known, broken and measured paths."""
    e = _entities(spark, sf_dir)
    files = e.groupBy(F.col("file_path").alias("path")).agg((F.max("p_size") > 49).alias("parse_incomplete"))
    tables = {"files": files, "entities": e}
    left = Q.delete_path(tables, "src/Brand7.py")
    put = Q.put_files(tables, {"files": files.where("path = 'src/Brand7.py'"), "entities": e.where("file_path = 'src/Brand7.py' and kind = 'class'")})
    small = _metrics(spark, sf_dir).where("value > 15 and metric_key = 'nom'")
    parts = {"row": Q.file_row(files, "src/Brand7.py"), "files left": left["files"], "entities left": left["entities"], "files put": put["files"], "entities put": put["entities"], "known": Q.known_paths(files), "broken": Q.incomplete_paths(files), "measured": Q.has_measurements(small, e)}
    out = None
    for name, df in parts.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("statement"), "n")
        out = row if out is None else out.unionByName(row)
    return out


ORACLES["file_statements"] = f"""WITH {_ENT}, f AS (SELECT path, max(p_size) > 49 AS bad FROM ent GROUP BY 1) SELECT 'row' AS statement, count(*) AS n FROM f WHERE path = 'src/Brand7.py' UNION ALL SELECT 'files left', count(*) FROM f WHERE path <> 'src/Brand7.py'
    UNION ALL SELECT 'entities left', count(*) FROM ent WHERE path <> 'src/Brand7.py' UNION ALL SELECT 'files put', count(*) FROM f UNION ALL SELECT 'entities put', count(*) FROM ent WHERE path <> 'src/Brand7.py' OR kind = 'class'
    UNION ALL SELECT 'known', count(*) FROM f UNION ALL SELECT 'broken', count(*) FROM f WHERE bad UNION ALL SELECT 'measured', count(DISTINCT path) FROM ent WHERE p_size / 2 > 15"""


def pointed_calls(spark, sf_dir):
    """Q22: orders as calls; those of customers in debt get a target, by which way is told."""
    o = table(spark, sf_dir, "orders")
    attrs = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("name"), F.col("o_orderpriority")))
    e = o.select(F.col("o_orderkey").alias("edge_id"), "o_custkey", F.lit(None).cast("long").alias("dst_id"), F.lit("L2").alias("resolution"), F.lit(0.0).alias("confidence"), attrs.alias("attrs"))
    poor = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    found = e.join(poor, "o_custkey").select("edge_id", F.col("o_custkey").alias("entity_id"), F.lit(0.5).alias("confidence"))
    out = Q.point_calls(e, found)
    return out.select("edge_id", "dst_id", "resolution", "confidence", F.col("attrs")["via"].alias("via"), F.col("attrs")["name"].alias("name"))


ORACLES["pointed_calls"] = """SELECT o_orderkey AS edge_id, c_custkey AS dst_id, CASE WHEN c_custkey IS NULL THEN 'L2' ELSE 'L1' END AS resolution, CASE WHEN c_custkey IS NULL THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence,
    CASE WHEN c_custkey IS NOT NULL THEN 'import_alias' END AS via, CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal < 0"""


def worst_trail(spark, sf_dir):
    """Q11, Q23: the increments of the first part's metric, and how many values the metric has."""
    m, e = _metrics(spark, sf_dir), _entities(spark, sf_dir)
    name = e.where("id = 1").select("qualified_name", "file_path").first()
    return Q.trail_of(m, e, name.qualified_name, name.file_path).crossJoin(Q.metric_values(m, "sloc").agg(F.count("*").alias("n"))).select(F.col("at").cast("long").alias("place"), "said", "n")


ORACLES["worst_trail"] = "SELECT place, said, (SELECT count(*) FROM part) AS n FROM (VALUES (0::BIGINT, 'first'), (1::BIGINT, 'cognitive_complexity')) v(place, said)"


def type_counts(spark, sf_dir):
    """Types and abstract ones by file; even classes say that they are."""
    e = _entities(spark, sf_dir).withColumn("attrs", F.when(F.col("id") % 2 == 0, '{"is_abstract": true}').otherwise("{}"))
    return Q.type_counts(e, F.col("file_path"))


ORACLES["type_counts"] = f"WITH {_ENT} SELECT path AS node, count(*) FILTER (kind = 'interface' OR id % 2 = 0) AS n_abstract, count(*) AS n_types FROM ent WHERE kind IN ('class', 'interface') GROUP BY 1"


def recursion(spark, sf_dir):
    """Rings of the calls between customers that are sure."""
    e = referrals(spark, sf_dir).select(F.col("src").alias("src_id"), F.lit("calls").alias("kind"), F.col("dst").alias("dst_id"), F.lit("L1").alias("resolution"), F.when(F.col("dst") % 3 == 0, 0.5).otherwise(1.0).alias("confidence"))
    return R.recursion(e).select("component", "node", "size")


ORACLES["recursion"] = f"""WITH RECURSIVE {REFERRALS}, s AS (SELECT * FROM e WHERE dst % 3 <> 0), w AS (SELECT src, dst FROM s UNION SELECT w.src, s.dst FROM w JOIN s ON s.src = w.dst)
    SELECT min(b.src) AS component, a.src AS node, count(*) AS size FROM w a JOIN w b ON b.src = a.dst AND b.dst = a.src GROUP BY 2"""


def entity_nodes(spark, sf_dir):
    """Parts with the least part of their brand that has their size and type as a node of the same range."""
    p = table(spark, sf_dir, "part")
    e = p.select("p_partkey", F.col("p_brand").alias("path"), F.col("p_size").alias("start_byte"), (F.col("p_size") + F.length("p_type")).alias("end_byte"))
    nodes = p.where("p_type <> 'SMALL'").select(F.col("p_brand").alias("path"), F.col("p_size").alias("start_byte"), (F.col("p_size") + F.length("p_type")).alias("end_byte"), F.col("p_partkey").alias("node"))
    return R.entity_nodes(e, nodes).select("p_partkey", "node")


ORACLES["entity_nodes"] = "SELECT a.p_partkey, min(b.p_partkey) AS node FROM part a LEFT JOIN part b ON b.p_brand = a.p_brand AND b.p_size = a.p_size AND len(b.p_type) = len(a.p_type) AND b.p_type <> 'SMALL' GROUP BY 1"


def declared_privacy(spark, sf_dir):
    """parts as definitions in seven languages, private and public by size, exported by type."""
    languages = F.array(*map(F.lit, ("python", "go", "java", "swift", "rust", "typescript", "javascript", "cobol")))
    c = [F.when(F.col("p_type") == "SMALL", "_x").when(F.col("p_type") == "LARGE", "#x").otherwise("X"), F.element_at(languages, (F.col("p_partkey") % 8 + 1).cast("int")), F.col("p_size") > 40, F.col("p_size") < 10, F.col("p_type") != "MEDIUM", F.col("p_type") == "ECONOMY", F.col("p_size") % 2 == 0]
    return table(spark, sf_dir, "part").select("p_partkey", N.declared_private(*c).alias("private"))


ORACLES["declared_privacy"] = """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN p_type = 'SMALL' WHEN 1 THEN p_type IN ('SMALL', 'LARGE') WHEN 2 THEN p_size > 40 WHEN 3 THEN p_size > 40 WHEN 4 THEN p_size >= 10
    WHEN 5 THEN p_type = 'LARGE' OR p_size > 40 OR (p_size % 2 = 0 AND p_type NOT IN ('MEDIUM', 'ECONOMY')) WHEN 6 THEN p_type = 'LARGE' OR (p_size % 2 = 0 AND p_type NOT IN ('MEDIUM', 'ECONOMY')) END AS private FROM part"""

_SETTINGS = P.Settings(ceilings={"cognitive_complexity": 16.0, "function_sloc": 60.0, "file_sloc": 80.0, "methods_per_class": 20.0}, layers=(("old", ("src/Brand2*",)), ("new", ("src/Brand1*",))), layer_ceilings={"old": {"cognitive_complexity": 16.4}}, advisory=("src/Brand3*",))


def _gate_tables(spark, sf_dir):
    e = _entities(spark, sf_dir)
    entities = e.select("id", F.col("file_path").alias("path"), "kind", F.col("qualified_name").alias("name"), F.col("p_size").alias("line"))
    return e.select(F.col("file_path").alias("path")).distinct(), entities, _metrics(spark, sf_dir).withColumnRenamed("entity_id", "id").drop("file_path")


def _found(df):
    cast = [F.col("rule"), F.col("path"), F.col("entity"), F.col("line").cast("long").alias("line"), F.round(F.col("value").cast("double"), 6).alias("value"), F.col("ceiling").cast("double").alias("ceiling"), (F.col("blocking").cast("string") == "true").alias("blocking")]
    return df.select(*cast)


def gate_findings(spark, sf_dir):
    """The project's rules over facts from whole tables."""
    return _found(P.gate(P.file_facts(*_gate_tables(spark, sf_dir), _SETTINGS), _SETTINGS, deep=False))


def gate_by_hand(spark, sf_dir):
    """The same without the rule compiler."""
    return _found(P.gate_by_hand(*_gate_tables(spark, sf_dir), _SETTINGS))


ORACLES["gate_findings"] = f"""WITH {_ENT}, m AS (SELECT *, unnest([{{'k': 'cognitive_complexity', 'v': p_retailprice / 60}}, {{'k': 'sloc', 'v': p_size * 2.0}}, {{'k': 'nom', 'v': p_size / 2}}]) AS q FROM ent),
    r AS (SELECT *, CASE WHEN q.k = 'cognitive_complexity' AND kind IN ('method', 'function') THEN 'cognitive_complexity' WHEN q.k = 'sloc' AND kind IN ('method', 'function') THEN 'function_sloc' WHEN q.k = 'sloc' AND kind = 'module' THEN 'file_sloc'
          WHEN q.k = 'nom' AND kind IN ('class', 'interface') THEN 'methods_per_class' END AS rule FROM m WHERE path NOT LIKE 'src/Brand3%'),
    l AS (SELECT *, CASE rule WHEN 'cognitive_complexity' THEN CASE WHEN path LIKE 'src/Brand2%' THEN 16.4 ELSE 16.0 END WHEN 'function_sloc' THEN 60.0 WHEN 'file_sloc' THEN 80.0 WHEN 'methods_per_class' THEN 20.0 END AS c FROM r)
    SELECT rule, path, name AS entity, p_size::BIGINT AS line, round(q.v, 6)::DOUBLE AS value, c::DOUBLE AS ceiling, p_type IN ('SMALL', 'MEDIUM') OR p_size % 2 = 0 AS blocking FROM l WHERE q.v > c"""
ORACLES["gate_by_hand"] = ORACLES["gate_findings"]


def contract_findings(spark, sf_dir):
    """Four contracts between regions over the trade of nations, facts from the edges."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("r%d/n%d", "n_regionkey", "n_nationkey").alias("f"))
    e = trade(spark, sf_dir).join(n.select(F.col("k").alias("src"), F.col("f").alias("a")), "src").join(n.select(F.col("k").alias("dst"), F.col("f").alias("b")), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(False).alias("deferred"))
    layers = tuple((f"r{i}", (f"r{i}/*",)) for i in range(5))
    contracts = (P.ContractOf("order", "layered", ("r0", "r1", "r2")), P.ContractOf("no", "forbidden", ("r4",), "r3"), P.ContractOf("apart", "independence", ("r0", "r4")), P.ContractOf("door", "deep_import", ("r2",), entries=("r2/n?",)))
    settings = P.Settings(ceilings={}, layers=layers, contracts=contracts)
    return P.gate(P.graph_facts(e, settings), settings).select("rule", "path", "entity")


ORACLES["contract_findings"] = f"""WITH {TRADE}, x AS (SELECT DISTINCT a.n_regionkey AS s, b.n_regionkey AS d, src, dst FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey <> b.n_regionkey),
    f AS (SELECT 'layered:order' AS rule, * FROM x WHERE s <= 2 AND d <= 2 AND s > d UNION ALL SELECT 'forbidden:no', * FROM x WHERE s = 3 AND d = 4 UNION ALL SELECT 'independence:apart', * FROM x WHERE s IN (0, 4) AND d IN (0, 4) UNION ALL SELECT 'deep:door', * FROM x WHERE d = 2 AND dst >= 10)
    SELECT rule, 'r' || s || '/n' || src AS path, 'r' || d || '/n' || dst AS entity FROM f"""


def check_states(spark, sf_dir):
    """Findings against a baseline, unreadable files and unscoped decisions beside them, by rule and state."""
    found = gate_by_hand(spark, sf_dir).withColumn("line", F.col("line").cast("int"))
    key = F.concat_ws("|", "rule", "path", "entity")
    base = found.where("line % 3 <> 0").select(key.alias("key"), (F.col("value") - F.when(F.col("line") % 3 == 1, 1.0).otherwise(0.0)).alias("value"))
    files = _entities(spark, sf_dir).groupBy(F.col("file_path").alias("path")).agg((F.min("p_size") == 1).alias("parse_incomplete"), F.max("p_size").alias("error_line"))
    report = R.check_report(found, base, P.unparseable(files))
    decisions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("decision"), F.array(F.format_string("src/Brand%d.py", F.col("r_regionkey") * 10)).alias("globs"), F.col("r_name").alias("document"))
    lost = P.unscoped(decisions, files).select("rule", F.lit("advisory").alias("state"))
    return report.select("rule", "state").union(lost).groupBy("rule", "state").agg(F.count("*").alias("n"))


ORACLES["check_states"] = f"""WITH {_ENT}, g AS ({ORACLES["gate_findings"]}), s AS (SELECT rule, CASE line % 3 WHEN 0 THEN 'new' WHEN 1 THEN 'regressed' ELSE 'forgiven' END AS state FROM g
    UNION ALL SELECT 'unparseable', 'new' FROM (SELECT path FROM ent GROUP BY 1 HAVING min(p_size) = 1) UNION ALL SELECT 'decision:unscoped', 'advisory' FROM region WHERE 'src/Brand' || r_regionkey * 10 || '.py' NOT IN (SELECT path FROM ent))
    SELECT rule, state, count(*) AS n FROM s GROUP BY 1, 2"""


def health_profiles(spark, sf_dir):
    """A16, the ``health`` report: how much code is above each ceiling."""
    _, entities, metrics = _gate_tables(spark, sf_dir)
    out = R.health(entities, metrics, _SETTINGS)["profiles"]
    return out.select("rule", "entities", "weight", "weight_over", "offenders", F.round("share_over", 6).alias("share_over"))


ORACLES["health_profiles"] = f"""WITH {_ENT}, r AS (SELECT 'cognitive_complexity' AS rule, p_retailprice / 60 > 16 AS o, * FROM ent WHERE kind IN ('method', 'function') UNION ALL SELECT 'function_sloc', p_size * 2 > 60, * FROM ent WHERE kind IN ('method', 'function')
    UNION ALL SELECT 'file_sloc', p_size * 2 > 80, * FROM ent WHERE kind = 'module' UNION ALL SELECT 'methods_per_class', p_size / 2 > 20, * FROM ent WHERE kind IN ('class', 'interface'))
    SELECT rule, count(*) AS entities, sum(greatest(p_size * 2.0, 1))::DOUBLE AS weight, coalesce(sum(greatest(p_size * 2.0, 1)) FILTER (o), 0)::DOUBLE AS weight_over, count(*) FILTER (o) AS offenders,
    round(coalesce(sum(greatest(p_size * 2.0, 1)) FILTER (o), 0) / sum(greatest(p_size * 2.0, 1)), 6)::DOUBLE AS share_over FROM r GROUP BY 1"""


def review_files(spark, sf_dir):
    """Changed files, those that can be measured, and their findings on touched lines."""
    found = gate_by_hand(spark, sf_dir).withColumn("line", F.col("line").cast("int"))
    report = R.check_report(found, found.limit(0).select(F.lit("").alias("key"), "value"))
    files = _entities(spark, sf_dir).select(F.col("file_path").alias("path")).distinct()
    changed = files.where(F.col("path").startswith("src/Brand1"))
    touched = changed.select("path", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("line"))
    got = R.review(report, changed, files.where("path <> 'src/Brand1.py'"), touched, report.where("line < 40").select("key"))
    return got["files"].crossJoin(got["comments"].agg(F.count("*").alias("comments"))).crossJoin(got["counts"].select("new", "introduced"))


ORACLES["review_files"] = f"""WITH {_ENT}, g AS ({ORACLES["gate_findings"]}), f AS (SELECT DISTINCT path FROM ent WHERE path LIKE 'src/Brand1%'), i AS (SELECT * FROM g WHERE path LIKE 'src/Brand1%' AND path <> 'src/Brand1.py')
    SELECT (SELECT count(*) FROM f) AS changed, (SELECT count(*) FROM f WHERE path <> 'src/Brand1.py') AS measured, (SELECT count(*) FROM f WHERE path = 'src/Brand1.py') AS excluded, (SELECT count(*) FROM i WHERE line <= 25) AS comments, (SELECT count(*) FROM i) AS "new", (SELECT count(*) FROM i WHERE line >= 40) AS introduced"""


def architecture(spark, sf_dir):
    """The ``arch`` report: imports between files of regions, counted, and their components' rings, levels and couplings."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("r%d/n%d.py", "n_regionkey", "n_nationkey").alias("f"))
    e = trade(spark, sf_dir).join(n.select(F.col("k").alias("src"), F.col("f").alias("path")), "src").join(n.select(F.col("k").alias("dst"), F.col("f").alias("target")), "dst")
    e = e.select("path", F.col("dst").cast("int").alias("line"), F.col("target").alias("specifier"), F.lit("value").alias("kind"), (F.col("src") % 2 == 0).alias("deferred"), "target")
    comps = n.select(N.folder(F.col("f")).alias("node")).distinct()
    got = R.architecture(e.drop("target"), e.where("line % 5 <> 0").select("path", "line", "specifier", "target"), F.col("line") % 2 == 0, comps)
    parts = [got["counts"].select(F.explode(F.create_map(*[x for c in ("total", "internal", "external", "unresolved") for x in (F.lit(c), F.col(c))])).alias("what", "n"))]
    parts += [got["edges"].agg(F.sum("weight").alias("n")).select(F.lit("weight").alias("what"), "n"), got["martin"].agg(F.sum("ce").alias("n")).select(F.lit("ce").alias("what"), "n")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


ORACLES["architecture"] = f"""WITH {TRADE}, x AS (SELECT a.n_regionkey AS s, b.n_regionkey AS d, dst FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst), y AS (SELECT * FROM x WHERE dst % 5 <> 0 AND s <> d)
    SELECT 'total' AS what, count(*) AS n FROM x UNION ALL SELECT 'internal', count(*) FROM x WHERE dst % 5 <> 0 UNION ALL SELECT 'external', count(*) FROM x WHERE dst % 5 = 0 AND dst % 2 <> 0 UNION ALL SELECT 'unresolved', count(*) FROM x WHERE dst % 5 = 0 AND dst % 2 = 0
    UNION ALL SELECT 'weight', count(*) FROM y UNION ALL SELECT 'ce', count(*) FROM (SELECT DISTINCT s, d FROM y)"""


def rust_imports(spark, sf_dir):
    """every part's module uses its crate, its parent, another crate and a dependency."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace("p_brand", F.lit("#"), F.lit("")).alias("c"), F.lower("p_type").alias("m"))
    home = F.concat_ws("/", F.lit("crates"), "c", F.lit("src"))
    files = p.select(F.explode(F.array(F.concat(home, F.lit("/lib.rs")), F.concat(home, F.lit("/"), "m", F.lit("/mod.rs")), F.concat(home, F.lit("/"), "m", F.lit("/p"), "p_partkey", F.lit(".rs")))).alias("path")).distinct()
    crates = p.select("c").distinct().select(F.col("c").alias("crate"), F.concat(F.lit("crates/"), "c").alias("folder"), F.concat(F.lit("crates/"), "c", F.lit("/src/lib.rs")).alias("root"))
    uses = F.array(F.concat(F.lit("crate::"), "m", F.lit("::Thing")), F.concat(F.lit("super::p"), "p_partkey", F.lit("::X")), F.lit("Brand3::Y"), F.lit("std::fmt"), F.lit("super::Z"))
    imports = p.select(F.concat(home, F.lit("/"), "m", F.lit("/p"), "p_partkey", F.lit(".rs")).alias("path"), F.posexplode(uses).alias("line", "specifier"))
    return I.resolve_rust(imports, files, crates).select("path", "line", "target")


ORACLES["rust_imports"] = """WITH p AS (SELECT p_partkey AS k, 'crates/' || replace(p_brand, '#', '') || '/src/' AS h, lower(p_type) AS m FROM part)
    SELECT h || m || '/p' || k || '.rs' AS path, line, CASE line WHEN 1 THEN h || m || '/p' || k || '.rs' WHEN 2 THEN 'crates/Brand3/src/lib.rs' ELSE h || m || '/mod.rs' END AS target FROM p, (VALUES (0), (1), (2), (4)) v(line)"""


def swift_imports(spark, sf_dir):
    """parts as files of a Swift module for each brand, which each nation's file imports by number."""
    files = _files(spark, sf_dir).select(F.concat(F.lit("Packages/X/Sources/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("/f"), "p_partkey", F.lit(".swift")).alias("path"))
    imports = nations(spark, sf_dir).select(F.format_string("App/n%d.swift", "node").alias("path"), F.lit(1).alias("line"), F.format_string("Brand%d", "node").alias("specifier"))
    return I.resolve_swift(imports, files).groupBy("path").agg(F.count("*").alias("n"))


ORACLES["swift_imports"] = "SELECT 'App/n' || n_nationkey || '.swift' AS path, count(*) AS n FROM nation JOIN part ON p_brand = 'Brand#' || n_nationkey GROUP BY 1"


def candidates(spark, sf_dir):
    """Ceilings, those of a layer, a contract, and regions as decisions with a limit."""
    settings = P.Settings(ceilings={"function_sloc": 60.0, "file_sloc": 500.0}, layers=_SETTINGS.layers, layer_ceilings={"old": {"file_sloc": 900.0}}, contracts=(P.ContractOf("apart", "independence", ("old", "new")),))
    d = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("decision"), F.col("r_name").alias("title"), F.when(F.col("r_regionkey") < 3, "accepted").otherwise("rejected").alias("status"), F.lit("body").alias("body"), F.array(F.lit("*")).alias("globs"), F.create_map(F.lit("file_sloc"), F.col("r_regionkey") * 100.0).alias("limits"))
    return X.candidates(settings, d).select("id", "name", "enforced", "rule", "limit", F.size("globs").cast("long").alias("globs"))


ORACLES["candidates"] = """SELECT * FROM (VALUES (0::BIGINT, 'file_sloc', true, 'file_sloc', 500.0::DOUBLE, 1::BIGINT), (1, 'function_sloc', true, 'function_sloc', 60.0, 1), (2, 'file_sloc in old', true, 'file_sloc', 900.0, 1), (3, 'apart', true, NULL, NULL, 2)) v(id, name, enforced, rule, "limit", globs)
    UNION ALL SELECT 4 + 2 * r_regionkey, r_name, false, NULL, NULL, 1 FROM region WHERE r_regionkey < 3 UNION ALL SELECT 5 + 2 * r_regionkey, 'file_sloc (' || r_regionkey || ')', true, 'file_sloc', r_regionkey * 100.0, 1 FROM region WHERE r_regionkey < 3"""


def calibration(spark, sf_dir):
    """What can be tuned, for a configuration that moves one ceiling and turns one off."""
    settings = C.read_config("ceilings: {cognitive_complexity: 15, max_nesting_depth: false}\nretry_budget: 5\n")
    return C.calibration(spark, settings).where("value <> standard or not on").select("parameter", "value", "standard", "on")


ORACLES["calibration"] = "SELECT * FROM (VALUES ('cognitive_complexity', 15.0::DOUBLE, 12.0::DOUBLE, true), ('max_nesting_depth', 4.0, 4.0, false), ('retry_budget', 5.0, 3.0, NULL)) v(parameter, \"value\", standard, \"on\")"


def recent_events(spark, sf_dir):
    """K7: events of the seven days before the last one, as rows of a ledger."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("seen"))
    now = e.agg(F.max("seen").alias("now"))
    return Q.without_old(e.crossJoin(now), F.col("now")).select("event_id")


ORACLES["recent_events"] = "SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY"


def emitted(spark, sf_dir):
    """K8: nations as JSON lines."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_regionkey") > 0, F.col("n_regionkey")).alias("region"))
    return R.emit({"nations": n})["nations"]


ORACLES["emitted"] = """SELECT '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || CASE WHEN n_regionkey > 0 THEN ',"region":' || n_regionkey ELSE '' END || '}' AS value FROM nation"""


QUERIES = {name: globals()[name] for name in ORACLES}
