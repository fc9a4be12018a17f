"""Repairs of a ledger against a plain simulation, trends, workspaces, incomplete paths."""

from __future__ import annotations

import json
import random
import re

from pyspark.sql import functions as F

from graphloom.operators.imports import folder_regex, workspace_packages
from graphloom.sources.store import still_incomplete
from graphloom.streaming import ledger as L


def simulated(runs):
    """``runs``: {session: [{key: value}, ...]} to (session, run, key, attempts, values)."""
    out = set()
    for session, found in runs.items():
        known: dict[str, list[float]] = {}
        for i, now in enumerate(found):
            out |= {(session, i, k, len(vs), tuple(vs[-8:])) for k, vs in known.items() if k not in now}
            known = {k: [*known.get(k, []), v] for k, v in now.items()}
    return out


def test_repairs(spark):
    r = random.Random(9)
    runs = {s: [{k: float(r.randrange(30)) for k in "abc" if r.random() < 0.8} for _ in range(40)] for s in ("x", "y", None)}
    rows = [(s, i, k, v, 1) for s, found in runs.items() for i, now in enumerate(found) for k, v in ({None: None} | now).items()]
    rows += [("x", None, "a", 1.0, 1), ("x", 0, *next(iter(runs["x"][0].items()), (None, None)), 1)]
    df = spark.createDataFrame(rows, "session string, run int, key string, value double, attempts int")
    got = L.repairs_at_once(df, ["session"])
    assert {(q.session, q.run, q.key, q.attempts, tuple(q["values"])) for q in got.collect()} == simulated(runs)
    assert any(len(q) == 8 for *_, q in simulated(runs)) and got.count() == len(simulated(runs))
    assert L.repairs_at_once(df.limit(0), ["session"]).count() == 0


def test_repair_log(spark, tmp_path):
    values = spark.createDataFrame([([27.0, 19.5, 19.0],), ([1e7, None, 0.1],), ([],), (None,)], "v array<double>")
    assert [q[0] for q in values.select(L.trend(F.col("v"))).collect()] == ["27 -> 19.5 -> 19", "1e+07 -> 0.1", "", None]
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    spark.createDataFrame([("s", "p", "rule|p|e", 3, [3.0, 2.0], False, True), ("s", "p", "other|p", 1, [1.0], False, False)], L.OUTPUT).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(L.OUTPUT).parquet(source)
        L.log_repairs(stream, log, str(tmp_path / "state"), availableNow=True).awaitTermination(60)
    assert [(q.rule, q.attempts, q["values"]) for q in spark.read.json(log).collect()] == [("rule", 3, [3.0, 2.0])]


def test_workspaces(spark):
    def found(*files):
        return {q.package: q.folder for q in workspace_packages(spark.createDataFrame([*files, (None, "{}"), ("x/package.json", None)], "path string, value string")).collect()}

    own = [(f"{at}/package.json", json.dumps({"name": name})) for at, name in (("packages/a", "@n/a"), ("packages/b", "b"), ("packages/b/deep", "deep"), ("tools/c", "b"), ("other", "o"), ("tools/d", ""))]
    npm, old = ("package.json", '{"workspaces": ["tools/*", "./packages/*/"]}'), ("package.json", '{"workspaces": {"packages": ["packages/**"]}}')
    pnpm, lerna = ("pnpm-workspace.yaml", "packages:\n  - 'packages/*'  # all\n  - other\nother: 1\n"), ("lerna.json", '{"packages": ["other"]}')
    assert found(npm, pnpm, lerna, *own) == {"@n/a": "packages/a", "b": "tools/c"}
    assert found(old, ("packages/package.json", '{"name": "all"}')) == {"all": "packages"}
    assert found(old, *own) == {"@n/a": "packages/a", "b": "packages/b", "deep": "packages/b/deep"}
    assert found(("package.json", "{}"), pnpm, lerna, *own) == {"@n/a": "packages/a", "b": "packages/b", "o": "other"}
    assert found(lerna, *own) == {"o": "other"} and found(*own) == {} and found() == {}
    for glob, hits, misses in (("a.b/*", ["a.b/c/"], ["axb/c/", "a.b/", "a.b/c/d/"]), ("**", ["a/", "a/b/"], [""]), ("a/**/z", ["a/z/", "a/b/c/z/"], ["a/b/", "z/"]), ("./p?/", ["pa/"], ["p/"])):
        assert all(re.search(folder_regex(glob), x) for x in hits) and not any(re.search(folder_regex(glob), x) for x in misses)


def test_incomplete(spark):
    a, b = (spark.createDataFrame([(x, 1) for x in xs], "path string, z int") for xs in (["p", "p", "q", None], ["p", None, "r"]))
    assert sorted(map(str, (q.path for q in still_incomplete(a, b).collect()))) == ["None", "p"]
