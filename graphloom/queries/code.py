"""Files, names, symbols, imports, logs and reviews, on stand-ins from whole tables.

Parts are files (``src/Brand7/small/m12.py``), brands and types their folders; nations are packages, customers and orders sites.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators import classes as C
from ..operators import context as X
from ..operators import graph as G
from ..operators import imports as I
from ..operators import resolve as R
from ..operators import text as W
from ..parse import python_source as S_
from ..plans import gate
from ..plans import rules as P
from ..sources import readers as S
from ..streaming import ledger as L
from .base import TRADE, nations, table, trade

ORACLES: dict[str, str] = {}
_FILES = "SELECT *, 'src/' || replace(p_brand, '#', '') || '/' || lower(p_type) || '/m' || p_partkey || '.py' AS path FROM part"


def _files(spark, sf_dir):
    path = F.concat_ws("/", F.lit("src"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lower("p_type"), F.concat(F.lit("m"), "p_partkey", F.lit(".py")))
    return table(spark, sf_dir, "part").withColumn("path", path)


def component_sizes(spark, sf_dir):
    """Lines of root entities by folder; small parts have a parent."""
    f = _files(spark, sf_dir).select("path", F.when(F.col("p_type") == "SMALL", F.col("p_partkey")).alias("parent_id"), F.col("p_size").alias("line_count"))
    return I.component_sizes(f)


ORACLES["component_sizes"] = f"SELECT regexp_replace(path, '/[^/]*$', '') AS component, sum(p_size)::BIGINT AS size FROM ({_FILES}) WHERE p_type <> 'SMALL' GROUP BY 1"


def granularities(spark, sf_dir):
    """Files by directory, top folder and themselves; suppliers lie at the root."""
    paths = _files(spark, sf_dir).select("path").union(table(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(".py"))))
    out = paths.select(F.explode(F.array(*[F.struct(F.lit(g).alias("granularity"), N.component(F.col("path"), g).alias("component")) for g in ("directory", "top", "file")])).alias("c"))
    return out.groupBy("c.granularity", "c.component").agg(F.count("*").alias("files"))


ORACLES["granularities"] = f"""WITH f AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, 'src' AS top FROM ({_FILES}) UNION ALL SELECT s_name || '.py', '<root>', '<root>' FROM supplier)
    SELECT 'directory' AS granularity, dir AS component, count(*) AS files FROM f GROUP BY 2 UNION ALL SELECT 'top', top, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'file', path, count(*) FROM f GROUP BY 2"""


def files_under(spark, sf_dir):
    """Files under the folder of the first brand, not of those whose name goes on."""
    return _files(spark, sf_dir).where(gate.path_under(F.col("path"), F.lit("src/Brand1"))).groupBy("p_type").agg(F.count("*").alias("files"))


ORACLES["files_under"] = "SELECT p_type, count(*) AS files FROM part WHERE p_brand = 'Brand#1' GROUP BY 1"


def runtime_imports(spark, sf_dir):
    """Line items as imports, returned ones type-only, open ones in declaration files."""
    kind = F.when(F.col("l_returnflag") == "R", "type_only").when(F.col("l_returnflag") == "A", "value").otherwise("dynamic")
    li = table(spark, sf_dir, "lineitem").select(kind.alias("kind"), F.concat(F.col("l_suppkey").cast("string"), F.when(F.col("l_linestatus") == "O", ".d.ts").otherwise(".ts")).alias("path"))
    return I.runtime_imports(li).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


ORACLES["runtime_imports"] = "SELECT CASE l_returnflag WHEN 'A' THEN 'value' ELSE 'dynamic' END AS kind, count(*) AS n, count(DISTINCT l_suppkey) AS paths FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'O' GROUP BY 1"


def component_edges(spark, sf_dir):
    """Nations as components of suppliers and customers, all line items as imports."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("a")), "l_suppkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("b")), "c_custkey")
    return G.component_edges(li.join(o, "l_orderkey").select("a", "b"), F.col("a"), F.col("b"))


ORACLES["component_edges"] = "SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey GROUP BY 1, 2"


def ck_suite(spark, sf_dir):
    """Nations as classes under nation n div 2 (the first under an unknown one), customers as methods, trade as uses, priorities as callees."""
    n = nations(spark, sf_dir).withColumnRenamed("node", "cls")
    c = table(spark, sf_dir, "customer")
    methods = c.select(F.col("c_nationkey").alias("cls"), F.when(F.col("c_acctbal") < 0, 2).otherwise(1).alias("cyclomatic"))
    bases = n.select("cls", F.when(F.col("cls") == 0, -1).otherwise(F.floor(F.col("cls") / 2)).alias("base"))
    calls = table(spark, sf_dir, "orders").join(c.select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("cls")), "o_custkey").select("cls", F.col("o_orderpriority").alias("callee"))
    return C.ck_suite(n, methods, bases, trade(spark, sf_dir).select(F.col("src").alias("cls"), F.col("dst").alias("used")), calls)


ORACLES["ck_suite"] = f"""WITH RECURSIVE {TRADE}, d AS (SELECT 0 AS cls, 1::BIGINT AS dit UNION ALL SELECT n_nationkey, dit + 1 FROM d JOIN nation ON n_nationkey // 2 = cls AND n_nationkey > 0),
    m AS (SELECT c_nationkey AS cls, count(*) AS nom, sum(CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END)::BIGINT AS wmc FROM customer GROUP BY 1), k AS (SELECT n_nationkey // 2 AS cls, count(*) AS noc FROM nation WHERE n_nationkey > 0 GROUP BY 1),
    u AS (SELECT cls, count(*) AS cbo FROM (SELECT src AS cls, dst AS x FROM e UNION SELECT dst, src FROM e) GROUP BY 1), r AS (SELECT c_nationkey AS cls, count(DISTINCT o_orderpriority) AS remote FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
    SELECT d.cls, coalesce(wmc, 0) AS wmc, coalesce(nom, 0) AS nom, dit, coalesce(noc, 0) AS noc, coalesce(cbo, 0) AS cbo, coalesce(nom, 0) + coalesce(remote, 0) AS rfc, 'APPROX' AS exactness FROM d LEFT JOIN m USING (cls) LEFT JOIN k USING (cls) LEFT JOIN u USING (cls) LEFT JOIN r USING (cls)"""


def unresolved_share(spark, sf_dir):
    """Orders as imports, filled ones resolved, dear ones the own code's."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("path"), F.col("o_orderkey").alias("line"), F.col("o_orderpriority").alias("specifier"), "o_orderstatus", "o_totalprice")
    out = I.unresolved_share(o, o.where("o_orderstatus = 'F'"), F.col("o_totalprice") > 200_000)
    return out.select("missing", "edges", F.round("share", 6).alias("share"))


ORACLES["unresolved_share"] = "SELECT m AS missing, e AS edges, round(m / (m + e), 6) AS share FROM (SELECT count(*) FILTER (o_orderstatus <> 'F' AND o_totalprice > 200000) AS m, count(*) FILTER (o_orderstatus = 'F') AS e FROM orders)"


def imports_behind(spark, sf_dir):
    """The trade between nations that stands behind each pair of regions."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.format_string("r%d/n%d.py", "n_regionkey", "n_nationkey").alias("f"))
    e = trade(spark, sf_dir).join(n.select(F.col("k").alias("src"), F.col("f").alias("path")), "src").join(n.select(F.col("k").alias("dst"), F.col("f").alias("target")), "dst")
    e = e.select("path", "target", F.lit(1).alias("line"), F.col("target").alias("specifier"))
    folders = n.select(N.folder(F.col("f")).alias("r")).distinct()
    cut = folders.withColumnRenamed("r", "src").crossJoin(folders.withColumnRenamed("r", "dst")).where("src < dst")
    return I.imports_behind(cut, e.drop("target"), e).select("src", "dst", F.concat_ws("|", "imports").alias("imports"))


ORACLES["imports_behind"] = f"""WITH {TRADE}, x AS (SELECT DISTINCT 'r' || a.n_regionkey AS src, 'r' || b.n_regionkey AS dst, 'r' || a.n_regionkey || '/n' || a.n_nationkey || '.py -> r' || b.n_regionkey || '/n' || b.n_nationkey || '.py' AS i
    FROM e JOIN nation a ON a.n_nationkey = src JOIN nation b ON b.n_nationkey = dst WHERE a.n_regionkey < b.n_regionkey) SELECT src, dst, string_agg(i, '|' ORDER BY i) AS imports FROM x GROUP BY 1, 2"""


def freshness(spark, sf_dir):
    """Parts as scanned files, those up to size 25 known as they are, economy ones measured."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), "p_size", "p_type", F.lit(1).alias("version"))
    scan = p.select("path", F.col("p_size").alias("sha"), "version")
    known = p.select("path", F.least("p_size", F.lit(25)).alias("sha"), "version")
    return L.freshness(scan, known, p.where("p_type = 'ECONOMY'")).groupBy("state").agg(F.count("*").alias("n"))


ORACLES["freshness"] = "SELECT CASE WHEN p_size > 25 THEN 'STALE' WHEN p_type = 'ECONOMY' THEN 'CURRENT' ELSE 'UNMEASURED' END AS state, count(*) AS n FROM part GROUP BY 1"


def work_list(spark, sf_dir):
    """Parts above size 25 have changed since they were known."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("sha"), F.lit(1).alias("version"))
    return L.work_list(p, p.withColumn("sha", F.least("sha", F.lit(25)))).select("path", "sha")


ORACLES["work_list"] = "SELECT p_partkey AS path, p_size AS sha FROM part WHERE p_size > 25"


def references(spark, sf_dir):
    """Line items as occurrences, roles by return flag, big ones consumed by calls."""
    roles = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "R", 8).otherwise(2)
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("start_line"), F.lit(0).alias("start_char"), roles.alias("roles"), "l_quantity", "l_linestatus")
    used = li.where("l_quantity > 40").select("path", F.col("start_line").alias("line"), F.col("start_char").alias("col"))
    return R.references(li, used).groupBy("l_linestatus").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


ORACLES["references"] = """WITH u AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40) SELECT l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS paths FROM lineitem a
    WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM u WHERE u.l_orderkey = a.l_orderkey AND u.l_linenumber = a.l_linenumber) GROUP BY 1"""


def relationships(spark, sf_dir):
    """Customers implement their nation, those in building a method of it."""
    c = table(spark, sf_dir, "customer")
    target = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.when(F.col("c_mktsegment") == "BUILDING", "#m().").otherwise("#"))
    rel = F.array(F.struct(target.alias("symbol"), (F.col("c_acctbal") < 0).alias("is_implementation")))
    return R.relationships(c.select(F.col("c_name").alias("symbol"), rel.alias("relationships")))


ORACLES["relationships"] = "SELECT c_name AS symbol, 'N' || c_nationkey || CASE WHEN c_mktsegment = 'BUILDING' THEN '#m().' ELSE '#' END AS target, CASE WHEN c_mktsegment = 'BUILDING' THEN 'OVERRIDES' ELSE 'EXTENDS' END AS kind FROM customer WHERE c_acctbal < 0"


def definitions(spark, sf_dir):
    """Customers as entities whose name stands at (nation, key), accounts in debt as definitions."""
    c = table(spark, sf_dir, "customer")
    sites = c.select(F.col("c_custkey").alias("entity"), F.col("c_nationkey").cast("string").alias("path"), F.col("c_custkey").alias("line"), F.lit(0).alias("col"))
    occ = c.select(F.col("c_nationkey").cast("string").alias("path"), F.col("c_custkey").alias("start_line"), F.lit(0).alias("start_char"), F.when(F.col("c_mktsegment") == "BUILDING", "local 1").otherwise(F.col("c_name")).alias("symbol"), F.when(F.col("c_acctbal") < 0, 1).otherwise(8).alias("roles"))
    return R.definitions(sites, occ).select("entity", "symbol")


ORACLES["definitions"] = "SELECT c_custkey AS entity, CASE WHEN c_mktsegment = 'BUILDING' THEN 'local 1@' || c_nationkey ELSE c_name END AS symbol FROM customer WHERE c_acctbal < 0"


def qualifier_members(spark, sf_dir):
    """Parts call the member of their type in their brand; brands and types declare."""
    p = _files(spark, sf_dir).withColumn("q", F.replace("p_brand", F.lit("#"), F.lit("")))
    decl = p.select(F.concat_ws("/", "q", "p_type").alias("entity"), F.col("p_type").alias("name"), F.concat_ws(".", F.lit("pkg"), "q", "p_type").alias("qualified_name")).distinct()
    return R.qualifier_members(p.select(F.col("p_partkey").alias("site"), F.col("p_type").alias("name"), F.col("q").alias("qualifier")), decl)


ORACLES["qualifier_members"] = "SELECT p_partkey AS site, replace(p_brand, '#', '') || '/' || p_type AS entity FROM part"


def reexports(spark, sf_dir):
    """Suppliers look in their nation's file; nation n republishes nation 2n + 1."""
    t = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("site"), F.col("s_nationkey").alias("file"))
    again = nations(spark, sf_dir).select(F.col("node").alias("file"), ((2 * F.col("node") + 1) % 25).cast("int").alias("target"))
    return R.reexports(t, again, 30)


ORACLES["reexports"] = """WITH RECURSIVE r AS (SELECT s_suppkey AS site, s_nationkey AS file, 0 AS hops FROM supplier UNION ALL SELECT site, ((2 * file + 1) % 25)::INTEGER, hops + 1 FROM r WHERE hops < 25) SELECT site, file, min(hops) AS hops FROM r GROUP BY 1, 2"""


def alias_targets(spark, sf_dir):
    """Orders as local symbols, closed ones bound to a priority; dear orders assign, open ones import it."""
    o = table(spark, sf_dir, "orders").withColumn("path", F.col("o_custkey").cast("string"))
    name = F.col("o_orderpriority").alias("name")
    binds = o.where("o_orderstatus <> 'P'").select("path", F.col("o_orderkey").alias("symbol"), name)
    files = o.where("o_orderstatus = 'O'").select("path", name, F.concat(F.lit("f"), "o_orderpriority").alias("file")).distinct()
    return R.alias_targets(o.select("path", F.col("o_orderkey").alias("symbol")), binds, o.where("o_totalprice > 400000").select("path", name), files).groupBy("outcome", "target").agg(F.count("*").alias("n"))


ORACLES["alias_targets"] = """WITH a AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_totalprice > 400000), i AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS p FROM orders WHERE o_orderstatus = 'O'),
    s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'no_binding' WHEN a.c IS NOT NULL THEN 'rebound' WHEN i.c IS NULL THEN 'no_import' ELSE 'recovered' END AS outcome, o_orderpriority AS p
          FROM orders LEFT JOIN a ON a.c = o_custkey AND a.p = o_orderpriority LEFT JOIN i ON i.c = o_custkey AND i.p = o_orderpriority)
    SELECT outcome, CASE WHEN outcome = 'recovered' THEN 'f' || p END AS target, count(*) AS n FROM s GROUP BY 1, 2"""


def on_changed_lines(spark, sf_dir):
    """Line items as findings, the first three lines of filled orders as touched."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"))
    touched = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("path"), F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("line"))
    return gate.on_changed_lines(li, touched).groupBy("line").agg(F.count("*").alias("n"))


ORACLES["on_changed_lines"] = "SELECT l_linenumber AS line, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linenumber <= 3 GROUP BY 1"


def _decisions(spark, sf_dir):
    """Regions as decisions on the files of a brand, or of the small type of the tens."""
    r = table(spark, sf_dir, "region")
    globs = F.array(F.format_string("src/Brand%d/*", "r_regionkey"), F.format_string("src/Brand[1!]%d/small/m?.py", "r_regionkey"), F.when(F.col("r_regionkey") == 4, "*/m7.py"))
    return r.select(F.col("r_regionkey").alias("decision"), F.filter(globs, lambda g: g.isNotNull()).alias("globs"), F.col("r_name").alias("name"))


def scope_paths(spark, sf_dir):
    """Files that decisions govern."""
    return gate.scope_paths(_decisions(spark, sf_dir), _files(spark, sf_dir))


_SCOPE = f"""SELECT r_regionkey AS decision, path, r_name FROM region, ({_FILES}) WHERE path LIKE 'src/Brand' || r_regionkey || '/%' OR regexp_full_match(path, 'src/Brand[1!]' || r_regionkey || '/small/m.\\.py') OR (r_regionkey = 4 AND path LIKE '%/m7.py')"""
ORACLES["scope_paths"] = f"SELECT decision, path FROM ({_SCOPE})"


def effective_ceilings(spark, sf_dir):
    """Limits by size for each type as a layer, economy with an own one."""
    project = spark.createDataFrame([("size", 30.0), ("price", 950.0)], "rule string, limit double")
    layers = spark.createDataFrame([("ECONOMY", "size", 10.0)], "layer string, rule string, limit double")
    files = _files(spark, sf_dir).select("path", F.col("p_type").alias("layer"))
    return gate.effective_ceilings(project, layers, files)


ORACLES["effective_ceilings"] = f"SELECT rule, path, CASE WHEN rule = 'size' AND p_type = 'ECONOMY' THEN 10.0 ELSE l END::DOUBLE AS \"limit\" FROM ({_FILES}), (VALUES ('size', 30.0), ('price', 950.0)) v(rule, l)"


def maintainability(spark, sf_dir):
    """F8: price as volume, size as complexity and, threefold, as lines."""
    m = W.maintainability(F.col("p_retailprice"), F.col("p_size"), F.col("p_size") * 3, F.col("p_size") / 100)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(c, 5).alias(k) for k, c in m.items()])


ORACLES["maintainability"] = "SELECT p_partkey, round(b, 5) AS mi, round(b + 50 * sin(sqrt(2.4 * p_size / 100)), 5) AS mi_sei, round(greatest(0, b * 100 / 171), 5) AS mi_vs FROM (SELECT *, 171 - 5.2 * ln(greatest(p_retailprice, 1)) - 0.23 * p_size - 16.2 * ln(greatest(p_size * 3, 1)) AS b FROM part)"


def names(spark, sf_dir):
    """privacy, dispatch and module names of parts in six languages."""
    p = _files(spark, sf_dir)
    language = F.element_at(F.array(*map(F.lit, ("python", "go", "typescript", "java", "rust", "swift"))), (F.col("p_size") % 6 + 1).cast("int"))
    name = F.when(F.col("p_type") == "SMALL", "_hidden").when(F.col("p_type") == "ECONOMY", "__call__").when(F.col("p_type") == "LARGE", "constructor").when(F.col("p_type") == "MEDIUM", "#secret").otherwise("Widget")
    rows = p.select("p_partkey", "path", language.alias("language"), name.alias("name"))
    return rows.select("p_partkey", N.private_by_name(F.col("name"), F.col("language")).alias("private"), N.dispatched_by_name(F.col("name"), F.col("language"), F.lit("Widget")).alias("dispatched"), N.module_name(F.col("path")).alias("module"))


ORACLES["names"] = f"""WITH p AS (SELECT p_partkey, path, ['python', 'go', 'typescript', 'java', 'rust', 'swift'][p_size % 6 + 1] AS l, CASE p_type WHEN 'SMALL' THEN '_hidden' WHEN 'ECONOMY' THEN '__call__' WHEN 'LARGE' THEN 'constructor' WHEN 'MEDIUM' THEN '#secret' ELSE 'Widget' END AS n FROM ({_FILES}))
    SELECT p_partkey, CASE l WHEN 'python' THEN n[1] = '_' WHEN 'go' THEN n <> 'Widget' WHEN 'typescript' THEN CASE WHEN n = '#secret' THEN true END END AS private,
    l = 'python' AND n = '__call__' OR l = 'typescript' AND n = 'constructor' OR l = 'java' AND n = 'Widget' AS dispatched, replace(replace(path, '.py', ''), '/', '.') AS module FROM p"""


def normal_paths(spark, sf_dir):
    """paths with dots, and file names of sessions."""
    p = _files(spark, sf_dir)
    path = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("./x/../"), "path")).when(F.col("p_type") == "LARGE", F.concat(F.lit("../"), "path")).otherwise(F.concat(F.lit("a//b/../../"), "path"))
    return p.select("p_partkey", N.normal_path(path).alias("path"), N.safe_session(F.col("p_brand")).alias("session"))


ORACLES["normal_paths"] = f"SELECT p_partkey, CASE WHEN p_type <> 'LARGE' THEN path END AS path, replace(p_brand, '#', '_') AS session FROM ({_FILES})"


def symbols(spark, sf_dir):
    """the last descriptor of symbols, and local ones with their path."""
    s = F.when(F.col("p_type") == "SMALL", F.concat(F.lit("local "), "p_partkey")).when(F.col("p_type") == "LARGE", F.concat(F.lit("pkg `odd "), "p_partkey", F.lit("`/"))).otherwise(F.concat(F.lit("pkg a/B#m"), "p_partkey", F.lit("().")))
    rows = _files(spark, sf_dir).select("p_partkey", "path", "p_type", s.alias("s"))
    return rows.select("p_partkey", F.when(F.col("p_type") != "SMALL", R.symbol_tail(F.col("s"))).alias("tail"), R.scoped_symbol(F.col("s"), F.col("path")).alias("symbol"))


ORACLES["symbols"] = f"""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN NULL WHEN 'LARGE' THEN 'odd ' || p_partkey ELSE 'm' || p_partkey END AS tail,
    CASE p_type WHEN 'SMALL' THEN 'local ' || p_partkey || '@' || path WHEN 'LARGE' THEN 'pkg `odd ' || p_partkey || '`/' ELSE 'pkg a/B#m' || p_partkey || '().' END AS symbol FROM ({_FILES})"""


def finding_texts(spark, sf_dir):
    """keys and sentences of sizes over a limit; small parts have none."""
    limit = F.when(F.col("p_type") != "SMALL", F.lit(10.25))
    value = F.col("p_size") + F.when(F.col("p_partkey") % 2 == 0, 0.5).otherwise(0.0)
    return _files(spark, sf_dir).select(gate.finding_key(F.lit("size"), F.col("path"), F.col("p_name")).alias("key"), N.finding_sentence(F.lit("size"), F.col("p_name"), value, limit).alias("said"))


ORACLES["finding_texts"] = f"SELECT 'size|' || path || '|' || p_name AS key, CASE WHEN p_type = 'SMALL' THEN p_name || ' breaks size' ELSE p_name || ': size ' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '.5' ELSE '' END || ' is over 10.25' END AS said FROM ({_FILES})"


def log_changes(spark, sf_dir):
    """Orders as log records with one renamed and one binary file."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    date = F.when(F.col("o_orderstatus") == "P", "never").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    text = F.concat(F.lit(S.RECORD), key, F.lit(S.FIELD + "An Author" + S.FIELD + "a@x" + S.FIELD), date, F.lit(S.FIELD + "subject\n\n1\t2\tsrc/{old => new}/f"), key, F.lit(".py\n-\t-\timg"), key, F.lit(".png\nbroken line\n"))
    found = S.parse_log(o.select(text.alias("value")))
    return found.select("commit", F.date_format("ts", "yyyy-MM-dd").alias("day"), "path", "old_path", "added", "deleted")


ORACLES["log_changes"] = """WITH o AS (SELECT o_orderkey::VARCHAR AS k, CASE WHEN o_orderstatus = 'P' THEN '1970-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders)
    SELECT k AS "commit", day, 'src/new/f' || k || '.py' AS path, 'src/old/f' || k || '.py' AS old_path, 1::BIGINT AS added, 2::BIGINT AS deleted FROM o UNION ALL SELECT k, day, 'img' || k || '.png', NULL, 0, 0 FROM o"""


def touched_lines(spark, sf_dir):
    """A diff for each part, with a hunk of its size and one of a single line."""
    p = table(spark, sf_dir, "part")
    lines = F.array(F.format_string("+++ b/x%d.py", "p_partkey"), F.format_string("@@ -1 +%d,%d @@", "p_size", F.col("p_size") % 4), F.lit("+a"), F.format_string("@@ -9,2 +%d @@", F.col("p_size") + 100))
    return S.diff_lines(p.select(F.col("p_partkey").alias("file"), F.posexplode(lines).alias("pos", "value")))


ORACLES["touched_lines"] = "SELECT 'x' || p_partkey || '.py' AS path, unnest(range(p_size, p_size + p_size % 4) || [p_size + 100])::INTEGER AS line FROM part"


def decision_records(spark, sf_dir):
    """Nations as decision records, some with frontmatter, some of the old style, some without a title."""
    n = table(spark, sf_dir, "nation")
    new = F.concat(F.lit("---\ntitle: "), "n_name", F.lit("\nstatus: Accepted\n---\nBody"))
    old = F.concat(F.lit("# "), "n_name", F.lit("\n\n## Status\n\nProposed\n"))
    value = F.when(F.col("n_regionkey") < 2, new).when(F.col("n_regionkey") < 4, old).otherwise("nothing")
    return S.decisions(n.select(F.format_string("adr/%04d.md", "n_nationkey").alias("path"), value.alias("value"))).select("decision", "title", "status")


ORACLES["decision_records"] = "SELECT printf('%04d', n_nationkey) AS decision, n_name AS title, CASE WHEN n_regionkey < 2 THEN 'accepted' ELSE 'proposed' END AS status FROM nation WHERE n_regionkey < 4"


def decision_ceilings(spark, sf_dir):
    """Nations as decision records that limit the size of their brands' parts: those above their ceiling, by decision.

    Records of the last region are only proposed; odd ones list their globs in brackets."""
    n = table(spark, sf_dir, "nation")
    glob = F.concat(F.lit("src/Brand"), (F.col("n_nationkey") + 1).cast("string"), F.lit("/"))
    globs = F.when(F.col("n_nationkey") % 2 == 1, F.concat(F.lit(" ["), glob, F.lit("small/*, '"), glob, F.lit("large/*']"))).otherwise(F.concat(F.lit("\n  - "), glob, F.lit("small/*  # by size\n  - "), glob, F.lit("large/*")))
    status = F.when(F.col("n_regionkey") == 4, "Proposed").otherwise("Accepted")
    text = F.concat(F.lit("---\nid: D-"), "n_nationkey", F.lit("\ntitle: "), "n_name", F.lit("\nstatus: "), status, F.lit("\napplies-to:"), globs, F.lit("\nconstraints:\n  why: size\n  ceilings:\n    size: "), (F.col("n_nationkey") + 10).cast("string"), F.lit("\n    other: none\ntags: [a]\n---\nBody"))
    records = S.decisions(n.select(F.format_string("adr/%04d.md", "n_nationkey").alias("path"), text.alias("value")))
    files = _files(spark, sf_dir)
    ceilings = files.select(F.lit("size").alias("rule"), "path", F.lit(45.0).alias("limit"))
    held = gate.tightened(ceilings, S.decision_limits(records, files))
    over = files.join(held, "path").where(F.col("p_size") > F.col("limit"))
    return over.groupBy(F.coalesce("decision", F.lit("project")).alias("decision")).agg(F.count("*").alias("findings"), F.max("limit").alias("limit"))


ORACLES["decision_ceilings"] = """WITH p AS (SELECT p_size, p_type, replace(p_brand, 'Brand#', '')::INTEGER - 1 AS k FROM part),
    l AS (SELECT p_size, CASE WHEN n_regionkey < 4 AND p_type IN ('SMALL', 'LARGE') AND n_nationkey + 10 < 45 THEN 'D-' || n_nationkey END AS d, n_nationkey + 10 AS own FROM p LEFT JOIN nation ON n_nationkey = k)
    SELECT coalesce(d, 'project') AS decision, count(*) AS findings, max(CASE WHEN d IS NULL THEN 45 ELSE own END)::DOUBLE AS limit FROM l WHERE p_size > CASE WHEN d IS NULL THEN 45 ELSE own END GROUP BY 1"""


def scope_lookup(spark, sf_dir):
    """Customers as sites at their key in the file of their nation, named by segment. Keys in hundreds are scopes, classes if the
    hundred is even, and two of three tens in them are functions; the nation's file is a module. Those in debt bind their
    segment in their ten, rich ones in their hundred, and nations below 15 bind two segments in their module."""
    c = table(spark, sf_dir, "customer").withColumn("ten", F.floor(F.col("c_custkey") / 10)).withColumn("hundred", F.floor(F.col("c_custkey") / 100)).withColumn("path", F.col("c_nationkey"))
    scope = lambda kind, at: F.concat_ws("/", "path", F.lit(kind), at)
    tens = c.where("ten % 3 <> 0").select(scope("t", "ten").alias("scope"), "path", F.lit("function").alias("kind"), (F.col("ten") * 10).alias("start"), (F.col("ten") * 10 + 10).alias("end"))
    hundreds = c.select(scope("h", "hundred").alias("scope"), "path", F.when(F.col("hundred") % 2 == 0, "class").otherwise("function").alias("kind"), (F.col("hundred") * 100).alias("start"), (F.col("hundred") * 100 + 100).alias("end"))
    n = nations(spark, sf_dir).withColumnRenamed("node", "path")
    modules = n.select(scope("m", F.lit("0")).alias("scope"), "path", F.lit("module").alias("kind"), F.lit(0).cast("long").alias("start"), F.lit(1 << 40).alias("end"))
    binds = c.where("c_acctbal < 0 and ten % 3 <> 0").select(scope("t", "ten").alias("scope"), F.col("c_mktsegment").alias("name"))
    binds = binds.union(c.where("c_acctbal > 9000").select(scope("h", "hundred"), "c_mktsegment")).union(n.where("path < 15").select(scope("m", F.lit("0")), F.explode(F.array(F.lit("BUILDING"), F.lit("MACHINERY")))))
    sites = c.select(F.col("c_custkey").alias("site"), "path", F.col("c_custkey").alias("at"), F.col("c_mktsegment").alias("name"))
    return R.scope_lookup(sites, tens.union(hundreds).union(modules).distinct(), binds)


ORACLES["scope_lookup"] = """WITH c AS (SELECT *, c_nationkey AS path, c_custkey // 10 AS ten, c_custkey // 100 AS hundred, c_mktsegment AS name FROM customer),
    t AS (SELECT DISTINCT path, ten, name FROM c WHERE c_acctbal < 0 AND ten % 3 <> 0), h AS (SELECT DISTINCT path, hundred, name FROM c WHERE c_acctbal > 9000)
    SELECT c_custkey AS site, CASE WHEN t.name IS NOT NULL THEN c.path || '/t/' || c.ten WHEN h.name IS NOT NULL AND (c.hundred % 2 = 1 OR c.ten % 3 = 0) THEN c.path || '/h/' || c.hundred ELSE c.path || '/m/0' END AS scope
    FROM c LEFT JOIN t ON t.path = c.path AND t.ten = c.ten AND t.name = c.name LEFT JOIN h ON h.path = c.path AND h.hundred = c.hundred AND h.name = c.name
    WHERE t.name IS NOT NULL OR (h.name IS NOT NULL AND (c.hundred % 2 = 1 OR c.ten % 3 = 0)) OR (c.path < 15 AND c.name IN ('BUILDING', 'MACHINERY'))"""


def _constraints(spark, sf_dir):
    d = _decisions(spark, sf_dir)
    return d.select(F.col("decision").alias("id"), "name", (F.col("decision") < 2).alias("enforced"), F.concat(F.lit("limit complexity of "), F.repeat(F.concat("name", F.lit(" ")), F.col("decision") + 1)).alias("text"), "globs", F.lit("r").alias("rule"), (10.0 - F.col("decision")).alias("limit"))


_TEXTS = "SELECT r_regionkey AS id, r_name AS name, r_regionkey < 2 AS enforced, ['limit', 'complexity', 'of'] || list_transform(range(r_regionkey + 1), lambda i: lower(split_part(r_name, ' ', 1))) || CASE WHEN contains(r_name, ' ') THEN list_transform(range(r_regionkey + 1), lambda i: lower(split_part(r_name, ' ', 2))) ELSE [] END AS ts FROM region"
_RELEVANCE = f"""t AS ({_TEXTS}), st AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM t), q(term) AS (VALUES ('complexity'), ('asia'), ('europe')),
    p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(ts) AS len, unnest(ts) AS term FROM t) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3), f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
    s AS (SELECT id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / average))) AS relevance FROM p JOIN f USING (term), st GROUP BY 1),
    g AS (SELECT decision AS id, count(DISTINCT path) AS governs FROM ({_SCOPE}) GROUP BY 1), a AS (SELECT t.id, name, enforced, coalesce(governs, 0) AS governs, coalesce(relevance, 0) AS relevance FROM t LEFT JOIN s USING (id) LEFT JOIN g USING (id))"""


def annotate(spark, sf_dir):
    """How many files each constraint governs, and how relevant it is to a task."""
    return X.annotate(_constraints(spark, sf_dir), _files(spark, sf_dir), "Complexity asia europe").select("id", "governs", F.round("relevance", 6).alias("relevance"))


ORACLES["annotate"] = f"WITH {_RELEVANCE} SELECT id, governs, round(relevance, 6) AS relevance FROM a"


def bundle(spark, sf_dir):
    """Three constraints for a task on the files of one decision."""
    targets = _files(spark, sf_dir).where(F.col("path").startswith("src/Brand3/"))
    return X.bundle(_constraints(spark, sf_dir), _files(spark, sf_dir), "Complexity asia europe", targets, 3).select("id", "position", "omitted")


ORACLES["bundle"] = f"""WITH {_RELEVANCE}, c AS (SELECT *, id IN (SELECT decision FROM ({_SCOPE}) WHERE path LIKE 'src/Brand3/%') AS covers FROM a), r AS (SELECT *, row_number() OVER (PARTITION BY enforced ORDER BY covers DESC, relevance DESC, governs, name) AS k FROM c)
    SELECT id, CASE WHEN enforced THEN k ELSE 2 + k END AS position, 2 AS omitted FROM r WHERE k <= CASE WHEN enforced THEN 2 ELSE 1 END"""


def declarations(spark, sf_dir):
    """Declarations that cover a file, the tightest first."""
    return X.declarations(_constraints(spark, sf_dir), "r", "src/Brand3/small/m7.py").select("id", "limit")


ORACLES["declarations"] = 'SELECT r_regionkey AS id, (10.0 - r_regionkey)::DOUBLE AS "limit" FROM region WHERE r_regionkey IN (3, 4)'


def acyclic_contract(spark, sf_dir):
    """Trade inside a ring, by the facts of its rings."""
    from ..runtime import checkpointed

    e = checkpointed(trade(spark, sf_dir).select("src", "dst"))
    rings = G.cycles(e, G.scc(e, nations(spark, sf_dir)))
    facts = {"imports": e, "cycle": I.cycle_facts("c", e, rings)}
    return P.evaluate([P.contract_rule("acyclic", "c")], facts).select("path", "entity")


ORACLES["acyclic_contract"] = f"""WITH RECURSIVE {TRADE}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)
    SELECT DISTINCT e.src::VARCHAR AS path, e.dst::VARCHAR AS entity FROM e JOIN reach r ON r.src = e.dst AND r.dst = e.src"""


def baseline_of(spark, sf_dir):
    """K6: the worst quantity of each part, without returned items."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("key"), F.when(F.col("l_returnflag") == "R", "unparseable").otherwise("size").alias("rule"), F.col("l_quantity").alias("value"))
    return gate.baseline_of(li)


ORACLES["baseline_of"] = "SELECT l_partkey AS key, max(l_quantity) AS value FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1"


def live_entities(spark, sf_dir):
    """Customers from the roots: test names and what isn't private; a class reaches its dispatched and overriding members."""
    c = table(spark, sf_dir, "customer")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "module").otherwise("method")
    e = c.select(F.col("c_custkey").alias("entity"), F.when(F.col("c_acctbal") > 9900, "test_x").otherwise("f").alias("name"), F.lit("p").alias("path"), kind.alias("kind"), (F.col("c_mktsegment") != "BUILDING").alias("private"), (F.col("c_acctbal") < 0).alias("dispatched"))
    members = c.where("c_custkey > 0").select(F.floor(F.col("c_custkey") / 2).alias("owner"), F.col("c_custkey").alias("member"))
    overrides = c.where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("src"))
    return G.reachable(C.dispatch_edges(e, overrides, members), C.roots(e)).select(F.col("node").cast("long").alias("node"))


ORACLES["live_entities"] = """WITH RECURSIVE r AS (SELECT c_custkey AS node FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9900
    UNION SELECT c_custkey FROM r JOIN customer ON c_custkey // 2 = node AND c_custkey > 0 WHERE c_acctbal < 0 OR c_mktsegment = 'MACHINERY') SELECT node FROM r"""


def settled_fields(spark, sf_dir):
    """priorities as members of a customer; open orders write them, filled ones call; urgent ones are declared."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cls"), F.col("o_orderkey").alias("method"), F.col("o_orderpriority").alias("member"), F.when(F.col("o_orderstatus") == "O", "write").when(F.col("o_orderstatus") == "F", "call").otherwise("read").alias("access"))
    declared = o.select("cls", F.lit("1-URGENT").alias("field")).distinct()
    return C.settle_fields(declared, o).groupBy("access", "state").agg(F.count("*").alias("n"))


ORACLES["settled_fields"] = """WITH f AS (SELECT DISTINCT o_custkey AS c, o_orderpriority AS m FROM orders WHERE o_orderstatus = 'O' UNION SELECT DISTINCT o_custkey, '1-URGENT' FROM orders)
    SELECT CASE o_orderstatus WHEN 'O' THEN 'write' WHEN 'F' THEN 'call' ELSE 'read' END AS access, CASE WHEN o_orderstatus = 'F' THEN 'call' WHEN f.c IS NOT NULL THEN 'field' ELSE 'unresolved' END AS state, count(*) AS n
    FROM orders LEFT JOIN f ON f.c = o_custkey AND f.m = o_orderpriority GROUP BY 1, 2"""


def fed_classes(spark, sf_dir):
    """Orders as methods in their customer's file, owned by the nation's file or, where that is even, by their own."""
    j = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    owner = C.owner_of(F.when(F.col("c_nationkey") % 2 == 1, F.col("c_nationkey").cast("long")), F.col("o_custkey"), F.lit(-1).cast("long"))
    m = j.select(F.col("o_custkey").alias("path"), F.lit("T").alias("owner"), owner.alias("owner_path"))
    return C.fed_classes(m).select("path", "owner_path")


ORACLES["fed_classes"] = "SELECT DISTINCT o_custkey AS path, c_nationkey::BIGINT AS owner_path FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey % 2 = 1 AND c_nationkey <> o_custkey"


def unquotable(spark, sf_dir):
    """numerals of documents that aren't their own length or id."""
    d = table(spark, sf_dir, "documents")
    left = W.unquotable(F.col("text"), F.array(F.col("n_chars").cast("string"), F.col("doc_id").cast("string")))
    return d.select("doc_id", F.explode(left).alias("numeral"))


ORACLES["unquotable"] = r"""SELECT DISTINCT doc_id, n AS numeral FROM (SELECT doc_id, n_chars, regexp_replace(regexp_replace(replace(x, ',', ''), '(\.\d*?)0+$', '\1'), '\.$', '') AS n FROM (SELECT doc_id, n_chars, unnest(regexp_extract_all(text, '\d[\d,]*(?:\.\d+)?')) AS x FROM documents)) WHERE n <> n_chars::VARCHAR AND n <> doc_id::VARCHAR"""


def _sources(spark, sf_dir):
    """A Python file for each part: a function with as many decisions as its size modulo 4, and a class whose method writes a field."""
    n = (F.col("p_size") % 4).cast("int")
    text = F.concat(
        F.lit("import os\nfrom pkg.b import thing\n\ndef f(a, b):\n"), F.repeat(F.lit("    if a:\n        b += 1\n"), n), F.lit("    # done\n    return b\n\nclass C:\n    def put(self, x):\n        self.field"), n.cast("string"), F.lit(" = x\n\n    def get(self):\n        return self.field0\n")
    )
    return _files(spark, sf_dir).select("p_partkey", "p_size", "path", F.when(F.col("p_type") == "SMALL", "def (").otherwise(text).alias("text"))


_SOURCES = f"SELECT *, p_size % 4 AS n FROM ({_FILES})"


def python_measures(spark, sf_dir):
    """Measures of the function, the class and the file; small parts don't parse."""
    out = S_.measure_files(_sources(spark, sf_dir))
    return out.select("path", F.when(F.col("kind") == "module", "-").otherwise(F.col("entity")).alias("entity"), "metric_key", "value").where("kind <> 'method'")


ORACLES["python_measures"] = f"""WITH p AS ({_SOURCES}), ok AS (SELECT * FROM p WHERE p_type <> 'SMALL') SELECT path, '-' AS entity, 'parse_incomplete' AS metric_key, 1.0::DOUBLE AS value FROM p WHERE p_type = 'SMALL'
    UNION ALL SELECT path, e, k, v::DOUBLE FROM (SELECT path, unnest([{{'e': 'f', 'k': 'cyclomatic', 'v': 1 + n}}, {{'e': 'f', 'k': 'cognitive', 'v': n}}, {{'e': 'f', 'k': 'params', 'v': 2}}, {{'e': 'f', 'k': 'nesting', 'v': least(n, 1)}}, {{'e': 'f', 'k': 'exits', 'v': 1}},
    {{'e': 'f', 'k': 'sloc', 'v': 2 + 2 * n}}, {{'e': 'C', 'k': 'nom', 'v': 2}}, {{'e': 'C', 'k': 'wmc', 'v': 2}}, {{'e': '-', 'k': 'lines', 'v': 13 + 2 * n}}, {{'e': '-', 'k': 'sloc', 'v': 9 + 2 * n}}, {{'e': '-', 'k': 'cloc', 'v': 1}}, {{'e': '-', 'k': 'blank', 'v': 3}}, {{'e': '-', 'k': 'lloc', 'v': 9 + 2 * n}}], recursive := true) FROM ok) t(path, e, k, v)"""


def python_imports(spark, sf_dir):
    """Imports of the files that parse, resolved to a package of two modules."""
    sources = _sources(spark, sf_dir)
    found = S_.import_rows(sources)
    known = sources.select("path").union(spark.createDataFrame([("pkg/__init__.py",), ("pkg/b.py",)], "path string"))
    hit = I.resolve_python(found.withColumn("specifier", F.col("specifier")), known)
    return found.join(hit, ["path", "line", "specifier"], "left").groupBy("specifier", "target").agg(F.count("*").alias("n"))


ORACLES["python_imports"] = "SELECT s AS specifier, t AS target, count(*) AS n FROM part, (VALUES ('os', NULL), ('pkg.b', 'pkg/b.py')) v(s, t) WHERE p_type <> 'SMALL' GROUP BY 1, 2"


def python_members(spark, sf_dir):
    """Members of the classes that parse, and their cohesion: one field if the method writes what is read."""
    m = S_.member_rows(_sources(spark, sf_dir))
    out = C.cohesion(m.select(F.col("path").alias("cls"), "method", F.col("member").alias("field")))
    return out.select("cls", "methods", "fields", "lcom1", "lcom4")


ORACLES["python_members"] = f"SELECT path AS cls, 2::BIGINT AS methods, CASE WHEN n = 0 THEN 1 ELSE 2 END::BIGINT AS fields, CASE WHEN n = 0 THEN 0 ELSE 1 END::BIGINT AS lcom1, CASE WHEN n = 0 THEN 1 ELSE 2 END::BIGINT AS lcom4 FROM ({_SOURCES}) WHERE p_type <> 'SMALL'"


def python_scopes(spark, sf_dir):
    """bindings of the files that parse, by kind of scope and of binding."""
    s = _sources(spark, sf_dir)
    b = S_.binding_rows(s).withColumnRenamed("kind", "binding").withColumnRenamed("name", "bound")
    return b.join(S_.scope_rows(s), ["path", "scope"]).groupBy("kind", "binding", "bound").agg(F.count("*").alias("n"))


ORACLES["python_scopes"] = f"""SELECT kind, binding, bound, sum(k)::BIGINT AS n FROM (SELECT * FROM ({_SOURCES}) WHERE p_type <> 'SMALL'), (VALUES ('module', 'import', 'os', 1), ('module', 'import', 'thing', 1), ('module', 'definition', 'f', 1), ('module', 'definition', 'C', 1),
    ('function', 'parameter', 'a', 1), ('function', 'parameter', 'b', 1), ('function', 'assignment', 'b', 0), ('class', 'definition', 'put', 1), ('class', 'definition', 'get', 1), ('function', 'receiver', 'self', 2), ('function', 'parameter', 'x', 1)) v(kind, binding, bound, k0),
    LATERAL (SELECT CASE WHEN binding = 'assignment' THEN CASE WHEN n > 0 THEN 1 ELSE 0 END ELSE k0 END AS k) GROUP BY 1, 2, 3 HAVING sum(k) > 0"""


QUERIES = {name: globals()[name] for name in ORACLES}
