"""Fact builder, reports, statements, configuration, Rust and Swift imports."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalars as N
from graphloom.operators import context as X
from graphloom.operators import imports as I
from graphloom.operators import reports as R
from graphloom.plans import facts as P
from graphloom.sources import config as C
from graphloom.sources import readers as S
from graphloom.sources import statements as Q

ENTITY = "id long, path string, kind string, name string, line int"
METRIC = "id long, metric_key string, value double, exactness string, bound string, explanation array<string>"


@pytest.fixture(scope="module")
def code(spark):
    r = random.Random(2)
    paths = [f"src/{d}/m{i}.py" for d in ("app", "core", "gen") for i in range(4)]
    entities, metrics = [], []
    for k in range(80):
        kind = r.choice(["function", "method", "class", "module", "field"])
        entities.append((k, r.choice(paths), kind, f"n{k}", k))
        for key in r.sample(["cognitive_complexity", "cyclomatic_complexity", "sloc", "nom", "wmc", "shredding_cluster"], 3):
            metrics.append((k, key, float(r.randrange(90)), r.choice(["EXACT", "APPROX"]), r.choice(["exact", "lower", "upper"]), r.choice([None, ["+1"]])))
    return spark.createDataFrame([(p,) for p in [*paths, "src/none.py"]], "path string"), spark.createDataFrame(entities, ENTITY), spark.createDataFrame(metrics, METRIC)


SETTINGS = P.Settings(layers=(("app", ("src/app/*",)), ("core", ("src/core/*",))), layer_ceilings={"app": {"cognitive_complexity": 40.0}}, advisory=("src/gen/*",))


def test_gate_is_the_gate_by_hand(code):
    files, entities, metrics = code
    got = P.gate(P.file_facts(files, entities, metrics, SETTINGS), SETTINGS, deep=False)
    want = P.gate_by_hand(files, entities, metrics, SETTINGS)
    key = lambda r: (r.rule, r.path, r.entity, int(r.line), float(r.value), float(r.ceiling), str(r.blocking).lower())
    found = sorted(map(key, got.collect()))
    assert found == sorted(map(key, want.collect())) and len(found) > 20
    assert not any("gen" in x[1] for x in found) and any(x[0] == "shredding" and x[5] == 40.0 for x in found) and {"true", "false"} == {x[6] for x in found}
    off = P.Settings(ceilings={"function_sloc": 60.0})
    assert {x.rule for x in P.gate(P.file_facts(files, entities, metrics, off), off, deep=False).collect()} == {"function_sloc"}


def test_no_files_no_findings(code):
    files, entities, metrics = code
    assert P.gate(P.file_facts(files.limit(0), entities, metrics, SETTINGS), SETTINGS, deep=False).count() == 0
    assert P.gate_by_hand(files, entities.limit(0), metrics, SETTINGS).count() == 0


def test_contracts_over_a_graph(spark):
    edges = [("src/app/a.py", "src/core/b.py", False), ("src/core/b.py", "src/app/a.py", True), ("src/core/b.py", "src/db/in.py", False), ("src/app/a.py", "src/db/api.py", False)]
    imports = spark.createDataFrame(edges, "src string, dst string, deferred boolean")
    contracts = (
        P.ContractOf("down", "layered", ("app", "core")), P.ContractOf("no-db", "forbidden", ("db",), "core"), P.ContractOf("apart", "independence", ("app", "db")),
        P.ContractOf("door", "deep_import", ("db",), entries=("src/db/api.py",)), P.ContractOf("rings", "acyclic", deferred=True), P.ContractOf("load", "acyclic"),
    )
    settings = P.Settings(ceilings={}, layers=(("app", ("src/app/*",)), ("core", ("src/core/*",)), ("db", ("src/db/*",))), contracts=contracts)
    whole = imports.select("src", "dst")
    from graphloom.operators import graph as G

    rings = G.cycles(whole, G.scc(whole)).select("component", "node")
    hard = imports.where("not deferred").select("src", "dst")
    facts = P.graph_facts(imports, settings, rings, None, G.cycles(hard, G.scc(hard)).select("component", "node"))
    found = sorted((r.rule, r.path[4:8], r.entity[4:]) for r in P.gate(facts, settings).collect())
    assert found == [
        ("acyclic:rings", "app/", "core/b.py"), ("acyclic:rings", "core", "app/a.py"), ("deep:door", "core", "db/in.py"),
        ("forbidden:no-db", "core", "db/in.py"), ("independence:apart", "app/", "db/api.py"), ("layered:down", "core", "app/a.py"),
    ]
    assert {r.label for r in facts["edge_label"].collect()} >= {"src/app/a.py -> src/core/b.py"}
    shallow = P.gate({k: v for k, v in P.file_facts(whole.select(F.col("src").alias("path")), *(spark.createDataFrame([], s) for s in (ENTITY, METRIC)), SETTINGS).items()}, SETTINGS, deep=False)
    assert shallow.count() == 0
    with pytest.raises(ValueError):
        P.graph_facts(imports, P.Settings(contracts=(P.ContractOf("x", "odd"),)))


def test_unscoped_and_unparseable(spark):
    decisions = spark.createDataFrame([("1", ["src/app/*"], "a.md"), ("2", ["lib/*"], "b.md"), ("3", [], "c.md")], "decision string, globs array<string>, document string")
    files = spark.createDataFrame([("src/app/x.py", False, None), ("src/bad.py", True, 7), ("src/worse.py", True, None)], "path string, parse_incomplete boolean, error_line int")
    assert sorted((r.path, r.blocking) for r in P.unscoped(decisions, files).collect()) == [("b.md", False), ("c.md", False)]
    broken = P.unparseable(files)
    assert sorted((r.path, r.line, r.blocking) for r in broken.collect()) == [("src/bad.py", 7, True), ("src/worse.py", 1, True)]
    findings = broken.limit(0).unionByName(spark.createDataFrame([("sloc", "p", "e", 1, 70.0, 60.0, True), ("sloc", "p", "f", 2, 61.0, 60.0, True)], broken.schema))
    base = spark.createDataFrame([("sloc|p|e", 70.0), ("unparseable|src/bad.py|src/bad.py", 1.0)], "key string, value double")
    report = R.check_report(findings, base, broken)
    assert sorted((r.entity, r.state) for r in report.collect()) == [("e", "forgiven"), ("f", "new"), ("src/bad.py", "new"), ("src/worse.py", "new")]
    assert tuple(R.verdict(report).first()) == (3, 0, 1, 2) and R.verdict(report.limit(0)).first().code == 0
    changed = spark.createDataFrame([("p",), ("readme",)], "path string")
    touched = spark.createDataFrame([("p", 2)], "path string, line int")
    payload = R.review(report, changed, files.select("path").union(changed.limit(1)), touched, base.select("key"))
    assert tuple(payload["files"].first()) == (2, 1, 1) and [r.entity for r in payload["comments"].collect()] == ["f"]
    assert tuple(payload["counts"].first()) == (1, 0, 1, 1) and R.review(report, changed, changed, touched, None)["counts"].first().introduced is None
    assert [r.value for r in R.emit({"x": base.where("value = 70")})["x"].collect()] == ['{"key":"sloc|p|e","value":70.0}']


def test_shown(spark):
    df = spark.createDataFrame([(i,) for i in range(8)], "v int")
    got = R.shown(df, [F.desc("v")], 5).orderBy("position").collect()
    assert [(r.v, r.position, r.more) for r in got] == [(7 - i, i + 1, 3) for i in range(5)] and R.shown(df.limit(0), [F.desc("v")]).count() == 0


def test_rankings(spark):
    entities = spark.createDataFrame([(1, "a", "p", "function"), (2, "b", "p", "function"), (3, "c", "q", "function")], "id long, qualified_name string, file_path string, kind string")
    metrics = spark.createDataFrame([(1, "p", "cog", 5.0, ["x", "y"]), (2, "p", "cog", 9.0, []), (3, "q", "cog", 9.0, None), (3, "q", "sloc", 1.0, None)], "entity_id long, file_path string, metric_key string, value double, explanation array<string>")
    by_file = spark.createDataFrame([("p", "churn", 3.0), ("q", "churn", 8.0)], "path string, metric_key string, value double")
    only = spark.createDataFrame([("p",)], "path string")
    assert [r.qualified_name for r in R.metrics_report("cog", metrics, entities, by_file, 2).collect()] == ["b", "c"]
    assert [r.qualified_name for r in R.metrics_report("cog", metrics, entities, by_file, 2, only).collect()] == ["b", "a"]
    assert [(r.scope, r.path) for r in R.metrics_report("churn", metrics, entities, by_file, 1).collect()] == [("file", "q")]
    assert [r.said for r in Q.trail_of(metrics, entities, "a", "p", "cog").collect()] == ["x", "y"]
    assert [r.path for r in Q.has_measurements(metrics, entities).orderBy("path").collect()] == ["p", "q"]
    classes = spark.createDataFrame([("A", 0.5), ("B", None), ("C", 0.9)], "cls string, lcom_star double")
    assert [r.cls for r in R.rank_classes(classes).collect()] == ["C", "A", "B"]


def test_statements(spark):
    edge = "edge_id long, src_id long, kind string, dst_id long, dst_ref string, resolution string, confidence double, attrs map<string,string>"
    edges = spark.createDataFrame([(1, 1, "calls", None, "local 3", "L2", 0.0, {"name": "f"}), (2, 1, "calls", 2, "x", "L2", 1.0, None), (3, 2, "references", None, "y", "L2", 0.0, None), (4, 2, "references", 1, "z", "L2", 1.0, None), (5, 2, "references", 1, "w", "L2", 1.0, None), (6, 1, "overrides", 2, "v", "L2", 1.0, None), (7, 2, "calls", 1, "u", "L2", 1.0, None)], edge)
    assert [r.edge_id for r in Q.local_calls(edges).collect()] == [1] and Q.call_edges(edges).count() == 3 and Q.reference_edges(edges).count() == 1
    assert Q.without_lost_references(edges).count() == 6 and [r.src_id for r in Q.dispatch_sources(edges).collect()] == [1]
    found = spark.createDataFrame([(1, 9, 0.5)], "edge_id long, entity_id long, confidence double")
    got = {r.edge_id: (r.dst_id, r.resolution, r.confidence, r.attrs) for r in Q.point_calls(edges, found).collect()}
    assert got[1] == (9, "L1", 0.5, {"name": "f", "via": "import_alias"}) and got[2] == (2, "L2", 1.0, None)
    assert sorted(r.node for r in R.recursion(edges).collect()) == [1, 2]
    files = spark.createDataFrame([("p", True), ("q", False)], "path string, parse_incomplete boolean")
    entities = spark.createDataFrame([(1, "p", "class", 0, 9, '{"is_abstract": true}'), (2, "p", "interface", 0, 20, "{}"), (3, "q", "class", 5, 6, None)], "id long, file_path string, kind string, start_byte int, end_byte int, attrs string")
    assert [r.id for r in Q.entities_of(entities, "p").collect()] == [2, 1] and [r.path for r in Q.incomplete_paths(files).collect()] == ["p"]
    assert {(r.node, r.n_abstract, r.n_types) for r in Q.type_counts(entities, F.col("file_path")).collect()} == {("p", 2, 2), ("q", 0, 1)}
    left = Q.delete_path({"files": files, "entities": entities}, "p")
    assert left["files"].count() == 1 and [r.id for r in left["entities"].collect()] == [3] and Q.file_row(files, "q").count() == 1 and Q.known_paths(files).count() == 2
    new = Q.put_files({"files": files, "entities": entities}, {"files": files.where("path = 'p'"), "entities": entities.where("id = 1")})
    assert new["files"].count() == 2 and sorted(r.id for r in new["entities"].collect()) == [1, 3]
    nodes = spark.createDataFrame([("p", 0, 9, 7), ("p", 0, 9, 5), ("p", 1, 9, 3)], "path string, start_byte int, end_byte int, node int")
    assert {r.id: r.node for r in R.entity_nodes(entities.withColumnRenamed("file_path", "path"), nodes).collect()} == {1: 5, 2: None, 3: None}
    ledger = spark.sql("select 1 as k, timestamp'2024-01-01' as seen union all select 2, timestamp'2024-01-09'")
    assert [r.k for r in Q.without_old(ledger, F.lit("2024-01-10").cast("timestamp")).collect()] == [2]


def test_architecture(spark):
    rows = [("a/x.py", 1, "b.y", "value", False), ("b/y.py", 1, "a.x", "value", False), ("b/y.py", 2, "os", "value", False), ("a/x.py", 2, "own.gone", "value", False), ("a/x.py", 3, "c.z", "type_only", False), ("b/y.py", 4, "c.z", "value", True)]
    imports = spark.createDataFrame(rows, "path string, line int, specifier string, kind string, deferred boolean")
    targets = spark.createDataFrame([("a/x.py", 1, "b.y", "b/y.py"), ("b/y.py", 1, "a.x", "a/x.py"), ("b/y.py", 4, "c.z", "c/z.py")], "path string, line int, specifier string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    got = R.architecture(imports, targets, F.col("specifier").startswith("own"), nodes)
    assert tuple(got["counts"].first()) == (5, 3, 1, 1) and {r.node for r in got["cycles"].collect()} == {"a", "b"}
    cut = got["cuts"].collect()
    assert len(cut) == 1 and cut[0].cut == 1 and len(cut[0].imports) == 1
    assert dict(got["levels"].collect()) == {"a": 1, "c": 0} and got["propagation"].first().n == 3
    assert {r.node: (r.ca, r.ce) for r in got["martin"].collect()} == {"a": (1, 1), "b": (1, 2), "c": (1, 0)}


def test_health(code):
    _, entities, metrics = code
    got = R.health(entities, metrics, SETTINGS, limit=3)
    rows = {r.rule: r for r in got["profiles"].collect()}
    assert "shredding" not in rows and 0 < rows["cognitive_complexity"].share_over <= 1
    by_rule: dict = {}
    for r in got["offenders"].collect():
        by_rule.setdefault(r.rule, []).append((r.position, -r.value))
    assert all(len(v) <= 3 and sorted(v) == sorted(v, key=lambda x: (x[1], x[0])) for v in by_rule.values())


def test_volume(spark):
    clones = spark.createDataFrame([("c", "p", 50, 1, 4), ("c", "q", 50, 3, 6)], "class string, path string, length long, first_line long, last_line long")
    complexity = spark.createDataFrame([("f", "p", 9.0), ("g", "q", 1.0)], "entity string, path string, value double")
    changes = spark.sql("select 'p' as path, 'x' as author, timestamp'2024-01-01' as ts, 1L as added, 0L as deleted")
    got = R.volume(clones, 200, complexity, changes)
    assert tuple(got["duplication"].first()) == (50, 0.25) and got["duplicate_lines"].count() == 2 and got["erosion"].first().worst == "f"
    assert [r.path for r in got["hotspots"].collect()] == ["p"]


def test_config(spark):
    text = """
ceilings: {cognitive_complexity: 15, max_nesting_depth: false}
layers: {app: ["src/app/*"], core: ["src/core/*"]}
layer_ceilings: {core: {file_sloc: 900}}
contracts:
  - {name: down, kind: layered, order: [app, core]}
  - {name: door, kind: deep_import, package: core, allowed_entrypoints: ["src/core/api.py"]}
advisory: ["gen/*"]
"""
    s = C.read_config(text)
    assert s.ceilings["cognitive_complexity"] == 15 and "max_nesting_depth" not in s.ceilings and s.layer_ceilings == {"core": {"file_sloc": 900.0}}
    assert s.contracts[1].names == ("core",) and s.advisory == ("gen/*",) and C.read_config(None) == P.Settings() and C.read_config("").ceilings == dict(P.Settings().ceilings)
    for bad in ("ceiling: {}", "ceilings: {nonsense: 1}", "ceilings: {cognitive_complexity: high}", "layer_ceilings: {x: {}}", "contracts: [{name: a, kind: b}]", "contracts: [{name: a, kind: layered, order: [x]}]", "contracts: [{name: a, kind: layered, odd: 1}]", "layers: []", "ceilings: {shredding: 3}", "a: [", "retry_budget: x", "advisory: x"):
        with pytest.raises(C.ConfigError):
            C.read_config(bad)
    rows = {r.parameter: r for r in C.calibration(spark, s).collect()}
    assert rows["cognitive_complexity"].value == 15 and rows["max_nesting_depth"].on is False and rows["bm25_k1"].on is None and len(rows) == len(P.GATES) + len(C.PARAMETERS)


def test_candidates(spark):
    s = P.Settings(ceilings={"function_sloc": 60.0}, layers=(("app", ("src/app/*",)),), layer_ceilings={"app": {"function_sloc": 80.0}}, contracts=(P.ContractOf("keep", "independence", ("app",)),))
    d = spark.createDataFrame([("1", "Use joins", "accepted", "body", ["*"], {"function_sloc": 40.0}), ("2", "No", "rejected", "x", ["*"], {})], "decision string, title string, status string, body string, globs array<string>, limits map<string,double>")
    got = X.candidates(s, d).orderBy("id").collect()
    assert [(r.id, r.name, r.enforced, r.limit) for r in got] == [(0, "function_sloc", True, 60.0), (1, "function_sloc in app", True, 80.0), (2, "keep", True, None), (3, "Use joins", False, None), (4, "function_sloc (1)", True, 40.0)]
    files = spark.createDataFrame([("src/app/x.py",), ("y.py",)], "path string")
    assert {r.id: r.governs for r in X.annotate(X.candidates(s, d), files, "joins").collect()} == {0: 2, 1: 1, 2: 1, 3: 2, 4: 2}
    assert all(X.contract_text(P.ContractOf("c", k, ("a", "b"), "s")) for k in P.CONTRACT_KINDS)


def test_rust_imports(spark):
    paths = ["crates/engine/src/lib.rs", "crates/app/src/lib.rs", "crates/app/src/inner.rs", "crates/app/src/deep/mod.rs", "crates/app/src/deep/leaf.rs", "core/main.rs", "core/util.rs"]
    crates = spark.createDataFrame([("engine", "crates/engine", "crates/engine/src/lib.rs"), ("app", "crates/app", "crates/app/src/lib.rs"), ("top", "", "core/main.rs")], "crate string, folder string, root string")
    app = "crates/app/src/"
    rows = [
        (app + "inner.rs", 1, "crate::App"), (app + "inner.rs", 2, "engine::Engine"), (app + "inner.rs", 3, "super::Sink"), (app + "inner.rs", 4, "std::path::Path"), (app + "inner.rs", 5, "crate::deep::leaf::Thing"),
        (app + "deep/leaf.rs", 6, "crate::inner"), (app + "deep/leaf.rs", 7, "super::x"), (app + "deep/mod.rs", 8, "super::inner"), (app + "deep/mod.rs", 9, "self::leaf::Y"), ("core/util.rs", 10, "crate::Thing"), (app + "lib.rs", 11, "super::Z"), (app + "inner.rs", 12, ""), (app + "inner.rs", 13, "crate.deep"),
    ]
    got = {r.line: r.target for r in I.resolve_rust(spark.createDataFrame(rows, "path string, line int, specifier string"), I.files_frame(spark, paths), crates).collect()}
    assert got == {
        1: app + "lib.rs", 2: "crates/engine/src/lib.rs", 3: app + "lib.rs", 5: app + "deep/leaf.rs", 6: app + "inner.rs", 7: app + "deep/mod.rs",
        8: app + "inner.rs", 9: app + "deep/leaf.rs", 10: "core/main.rs", 11: app + "lib.rs", 13: app + "deep/mod.rs",
    }


def test_swift_imports(spark):
    files = I.files_frame(spark, ["Sources/Core/a.swift", "Packages/Kit/Sources/Kit/b.swift", "Packages/Kit/Sources/Kit/readme.md", "App/c.swift"])
    rows = [("App/c.swift", 1, "Core"), ("App/c.swift", 2, "Kit"), ("App/c.swift", 3, "Foundation")]
    got = I.resolve_swift(spark.createDataFrame(rows, "path string, line int, specifier string"), files).collect()
    assert sorted((r.line, r.target) for r in got) == [(1, "Sources/Core/a.swift"), (2, "Packages/Kit/Sources/Kit/b.swift")]


def test_declared_privacy(spark):
    rows = [("_x", "python", False, False, True, False, False, True), ("X", "go", False, False, True, False, False, False), ("run", "java", True, False, False, False, False, True), ("run", "rust", False, False, True, False, False, True), ("run", "rust", False, True, True, False, False, False),
            ("f", "typescript", False, False, True, False, True, True), ("f", "typescript", False, False, True, True, True, False), ("#f", "javascript", False, False, False, False, False, True), ("f", "cobol", True, False, True, False, True, None)]
    df = spark.createDataFrame(rows, "name string, language string, private_ boolean, public_ boolean, top boolean, exported boolean, module boolean, want boolean")
    c = [F.col(x) for x in ("name", "language", "private_", "public_", "top", "exported", "module")]
    assert all(r.got == r.want for r in df.select(N.declared_private(*c).alias("got"), "want").collect())


def test_ring_facts_and_sizes(spark):
    edges = spark.createDataFrame([("a/1", "b/1"), ("b/2", "a/1"), ("a/1", "a/2"), ("b/1", "c/1")], "src string, dst string")
    rings = spark.createDataFrame([("a", "a"), ("a", "b")], "component string, node string")
    of = spark.createDataFrame([(f"{c}/{i}", c) for c in "abc" for i in (1, 2)], "path string, component string")
    assert sorted((r.src, r.dst) for r in I.cycle_facts("c", edges, rings, of).collect()) == [("a/1", "b/1"), ("b/2", "a/1")]
    entities = spark.createDataFrame([("a/x", None, 10), ("a/x", 1, 5), ("y", None, 3)], "path string, parent_id int, line_count int")
    assert dict(I.component_sizes(entities).collect()) == {"a": 10, "<root>": 3}


def test_tree_is_pruned(tmp_path):
    for name in ("a/b/c.py", "node_modules/x/y.py", "a/third_party/z.py", ".git/q.py", "gen/deep/d.py"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = {f[len(str(tmp_path)) :] for f in S.source_folders(str(tmp_path), ["gen/*"])}
    assert found == {"", "/a", "/a/b"}


def test_git(spark, tmp_path):
    import subprocess

    def git(*args):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A B", "-c", "user.email=a@b", *args], check=True, capture_output=True)

    git("init", "-q", "-b", "main")
    (tmp_path / "a.py").write_text("x = 1\n")
    git("add", "."), git("commit", "-qm", "one")
    git("checkout", "-qb", "side")
    (tmp_path / "b.py").write_text("y = 1\n")
    git("add", "."), git("commit", "-qm", "two")
    assert [r.path for r in S.changed_files(spark, str(tmp_path), "main", "side").collect()] == ["b.py"]
    assert sorted((r.subject, r.path, r.added, r.author) for r in S.git_log(spark, str(tmp_path)).collect()) == [("one", "a.py", 1, "A B"), ("two", "b.py", 1, "A B")]
    assert [r.subject for r in S.git_log(spark, str(tmp_path), paths=["a.py"], most=1).collect()] == ["one"]


def test_entity_places_of_one_range_go_by_key(spark, tmp_path):
    """Parts of equal start and end, written with falling keys."""
    from graphloom.queries.report import entity_places

    rows = [(k * 7000, "b", 70 - k * 7) for k in range(9, -1, -1)] + [(5, "b", 71), (6, "a", 1)]
    spark.createDataFrame(rows, "p_partkey long, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = dict(entity_places(spark, str(tmp_path)).collect())
    assert got == {**{k * 7000: k + 1 for k in range(10)}, 5: 11, 6: 1}
