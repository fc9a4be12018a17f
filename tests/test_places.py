"""The sweep over intervals, the walk through scopes, and decision records with their limits."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import resolve as R
from graphloom.plans import gate
from graphloom.sources import readers as S


@pytest.mark.parametrize("whole,bucket", [(10**6, None), (20, None), (10**6, 7)])
def test_sweep_equals_every_pair(spark, whole, bucket):
    """Overlapping spans, ties, nulls, repeated rows; a key with nearly all rows, in pieces and whole."""
    rng = random.Random(5)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    spans = [(key(), s := rng.randint(0, 200), s + rng.choice([0, 1, 3, 10, 40, 150]), rng.choice(["m", "n", "o"])) for _ in range(150)] + [("b", None, 5, "x"), ("b", 0, 9, "z")] * 2
    points = [(i % 300, key(), rng.choice([*range(210), None])) for i in range(330)]
    got = R.innermost(spark.createDataFrame(points, "id long, path string, at long").repartition(3), spark.createDataFrame(spans, "path string, start long, end long, name string"), "path", bucket, whole)
    want = set()
    for i, k, at in points:
        held = [(e - s, s, n) for p, s, e, n in spans if k is not None and p == k and None not in (s, at) and s <= at < e]
        if held:
            want.add((i, k, at, min(held)[2], min(held)[1]))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sweep_passes_other_columns(spark):
    points = spark.createDataFrame([(1, "a", 5, ["x"], 0.5)], "id long, path string, at int, more array<string>, start double").drop("start")
    spans = spark.createDataFrame([("a", 0, 9, 7)], "path string, start int, end int, name long")
    row = R.innermost(points, spans, ["path"]).first()
    assert (row.id, row.more, row.name, row["start"]) == (1, ["x"], 7, 0)
    assert R.innermost(points, spans.limit(0), "path").count() == 0


def test_scope_lookup_walks_outward_past_classes(spark):
    scopes = [("m", "f", "module", 0, 1000), ("K", "f", "class", 100, 500), ("g", "f", "function", 200, 300), ("h", "f", "function", 220, 260), ("L", "f", "class", 600, 700)]
    bindings = [("m", "x"), ("K", "x"), ("g", "y"), ("h", "y"), ("K", "only"), ("L", "z"), ("m", "z")]
    sites = [(1, "f", 230, "x"), (2, "f", 150, "x"), (3, "f", 230, "y"), (4, "f", 280, "y"), (5, "f", 230, "only"), (6, "f", 150, "only"), (7, "f", 650, "z"), (8, "f", 650, "x"), (9, "g", 1, "x"), (10, "f", 1, None), (11, "f", 2000, "x"), (12, "f", 50, "z")]
    got = R.scope_lookup(spark.createDataFrame(sites, "site long, path string, at long, name string"), spark.createDataFrame(scopes, "scope string, path string, kind string, start long, end long"), spark.createDataFrame(bindings, "scope string, name string"))
    assert dict(got.collect()) == {1: "m", 2: "K", 3: "h", 4: "g", 6: "K", 7: "L", 8: "m", 12: "m"}


def test_decision_frontmatter(spark):
    lines = "---\nid: ADR-7\ntitle: \"Keep: small\"\nstatus: Accepted # since May\napplies-to:\n  - 'src/a/*'\n- src/b/** # all\ntags: [x, \"y\"]\nconstraints:\n  note: why\n  ceilings:\n    cyclomatic: 10\n    \"nesting\": 3.5\n    broken: many\n  after: 5\nmore: 9\n---\n# Body\ntext"
    braces = "---\ntitle: Braces\nstatus: accepted\napplies-to: [src/c/*, '*.py']\nconstraints:\n  ceilings: {cyclomatic: 4, nesting: 2}\n---"
    files = [("adr/0007-small.md", lines), ("adr/0008.md", braces), ("adr/0009-old.md", "# 9. Use a bus\n\n## Status\n\nSuperseded by ADR-14\n"), ("adr/0010.md", "---\ntitle: Empty\napplies-to:\nconstraints:\n---\n"), ("adr/README.md", "no title"), ("adr/none.md", None)]
    records = S.decisions(spark.createDataFrame(files, "path string, value string"))
    got = {r.decision: r for r in records.collect()}
    assert set(got) == {"ADR-7", "0008", "0009-old", "0010"}
    a, b, old, empty = (got[k] for k in ("ADR-7", "0008", "0009-old", "0010"))
    assert (a.title, a.status, a.globs, a.tags, a.limits) == ("Keep: small", "accepted", ["src/a/*", "src/b/**"], ["x", "y"], {"cyclomatic": 10.0, "nesting": 3.5})
    assert a.body == "# Body\ntext" and a.document == "adr/0007-small.md"
    assert (b.globs, b.limits) == (["src/c/*", "*.py"], {"cyclomatic": 4.0, "nesting": 2.0})
    assert (old.title, old.status, old.globs, old.limits) == ("Use a bus", "superseded", [], {}) and (empty.globs, empty.limits, empty.status) == ([], {}, None)
    paths = spark.createDataFrame([("src/a/x.go",), ("src/c/y.py",), ("src/d/z.go",)], "path string")
    limits = S.decision_limits(records, paths)
    assert {tuple(r) for r in limits.collect()} == {("cyclomatic", "src/a/x.go", 10.0, "ADR-7"), ("nesting", "src/a/x.go", 3.5, "ADR-7"), ("cyclomatic", "src/c/y.py", 4.0, "0008"), ("nesting", "src/c/y.py", 2.0, "0008")}
    held = gate.tightened(paths.selectExpr("'cyclomatic' AS rule", "path", "8.0D AS limit"), limits)
    assert {r.path: (r.limit, r.decision) for r in held.collect()} == {"src/a/x.go": (8.0, None), "src/c/y.py": (4.0, "0008"), "src/d/z.go": (8.0, None)}


def test_imports_meet_roots_by_what_they_spell(spark):
    """600 roots and the plan has no cross join; the deepest root wins, modules before packages of one root."""
    from graphloom.operators import imports as I

    paths = [f"r{i}/pkg{i}/__init__.py" for i in range(600)] + [f"r{i}/pkg{i}/mod.py" for i in range(600)] + ["r1/deep/pkg2/__init__.py", "r1/deep/pkg2/mod.py", "r3/both.py", "r3/both/__init__.py", "top.py"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    asked = [("x.py", i, f"pkg{i}.mod", 0, []) for i in range(0, 600, 7)] + [("x.py", 1000, "pkg2.mod", 0, []), ("x.py", 1001, "both", 0, []), ("x.py", 1002, "top", 0, []), ("x.py", 1003, "nowhere", 0, [])]
    found = I.resolve_python(spark.createDataFrame(asked, "path string, line long, specifier string, level int, names array<string>"), files)
    got = {r.line: r.target for r in found.collect()}
    assert got == {i: f"r{i}/pkg{i}/mod.py" for i in range(0, 600, 7)} | {1000: "r1/deep/pkg2/mod.py", 1001: "r3/both.py", 1002: "top.py"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_bus_factor_equals_ranking(spark):
    from graphloom.operators import history as H

    rng = random.Random(6)
    for _ in range(3):
        owners = [rng.choice("abcdefghij"[: rng.randint(1, 10)]) for _ in range(rng.randint(1, 40))]
        counts, covered, want = sorted((owners.count(a) for a in set(owners)), reverse=True), 0, 0
        while covered * 2 <= len(owners):
            covered, want = covered + counts[want], want + 1
        assert H.bus_factor(spark.createDataFrame([(a,) for a in owners], "top_author string")).first()[0] == want
