"""The name ladder against its rules written as plain steps."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest

from graphloom.operators import resolve as R


def _frames(spark, sites, declarations, imports, external, republished):
    return (
        spark.createDataFrame(sites, "site long, path string, name string, qualifier string"),
        spark.createDataFrame(declarations, "entity long, path string, name string, qualified_name string, top boolean"),
        spark.createDataFrame(imports, "path string, name string, file string, at int"),
        spark.createDataFrame(external, "path string, name string"),
        spark.createDataFrame(republished, "file string, target string, at int"),
    )


def _plain(sites, declarations, imports, external, republished):
    local, everywhere, bound, files, again = (defaultdict(list) for _ in range(5))
    for entity, path, name, qualified, top in sorted(set(declarations)):
        everywhere[name].append((entity, path, qualified))
        if top:
            local[path, name].append(entity)
    for path, name, file, at in sorted(set(imports), key=lambda x: (x[3], str(x[2]))):
        if name is not None:
            bound[path, name].append(file)
        if file is not None:
            files[path].append(file)
    for file, target, _ in sorted(set(republished), key=lambda x: (x[2], x[1])):
        again[file].append(target)
    out = set()
    for site, path, name, qualifier in set(sites):
        def answer(found, file, rung):
            out.add((site, found[0], file, rung, len(found)))  # noqa: B023

        if name is None:
            continue
        if qualifier is None and local[path, name]:
            answer(local[path, name], path, 1)
            continue
        governing = qualifier or name
        if (path, governing) in external:
            continue
        done = False
        if qualifier is None or (path, qualifier) in bound:
            placed = [f for f in bound.get((path, governing), []) if f is not None]
            members = [e for e in everywhere[name] if qualifier and e[1] in placed and (e[2] or "").endswith(f".{qualifier}.{name}")]
            if members:
                answer([e[0] for e in members], members[0][1], 2)
                continue
            queue, seen = list(placed), set()
            while queue and not done:
                file = queue.pop(0)
                if file in seen:
                    continue
                seen.add(file)
                if local[file, name]:
                    answer(local[file, name], file, 2)
                    done = True
                queue += again[file]
            for file in sorted(set(files[path])):
                if not done and local[file, name]:
                    answer(local[file, name], file, 3)
                    done = True
        if not done and everywhere[name]:
            answer([e[0] for e in everywhere[name]], everywhere[name][0][1], 4)
    return out


def _got(frames):
    return {tuple(r) for r in R.name_ladder(*frames).select("site", "entity", "file", "rung", "candidates").collect()}


def test_ladder_cases(spark):
    """Two declarations of one file, a republished name that its file declares too, the first imported file, receivers, externals."""
    declarations = [(1, "a", "twice", "a.twice", True), (2, "a", "twice", "a.twice", True), (3, "b", "own", "b.own", True), (4, "c", "own", "c.own", True), (5, "c", "both", None, True), (6, "d", "both", None, True), (7, "d", "run", "d.K.run", False), (8, "d", "run", "d.run", True)]
    imports = [("x", "own", "b", 0), ("x", None, "d", 0), ("x", None, "c", 0), ("x", "K", "d", 0), ("x", "np", None, 0)]
    sites = [(1, "a", "twice", None), (2, "x", "own", None), (3, "x", "both", None), (4, "x", "run", "K"), (5, "x", "own", "np"), (6, "x", "own", "it"), (7, "x", "twice", None), (8, "x", None, None), (9, "x", "nowhere", None), (9, "x", "nowhere", None)]
    frames = _frames(spark, sites, declarations, imports, [("x", "np")], [("b", "c", 0)])
    assert _got(frames) == {(1, 1, "a", 1, 2), (2, 3, "b", 2, 1), (3, 5, "c", 3, 1), (4, 7, "d", 2, 1), (6, 3, "b", 4, 2), (7, 1, "a", 4, 2)}
    assert {tuple(r)[-1] for r in R.name_ladder(*frames).where("rung = 1").collect()} == {0.5}


def test_ladder_brute(spark):
    for seed in (1, 2):
        rng = random.Random(seed)
        paths, names = [f"f{i}" for i in range(12)], [f"n{i}" for i in range(9)]
        declarations = [(i, rng.choice(paths), n := rng.choice(names), rng.choice([f"p.{n}", f"p.q1.{n}", f"p.q2.{n}", None]), rng.random() < 0.6) for i in range(25)]
        imports = [(rng.choice(paths), rng.choice([*names, "q1", "q2", None]), rng.choice([*paths, None]), rng.randint(0, 3)) for _ in range(60)]
        external = [(rng.choice(paths), rng.choice([*names, "q2"])) for _ in range(8)]
        republished = [(rng.choice(paths), rng.choice(paths), rng.randint(0, 3)) for _ in range(14)]
        sites = [(i, rng.choice(paths), rng.choice([*names, None]), rng.choice([None, None, "q1", "q2", "q3"])) for i in range(200)]
        rows = (sites, declarations, imports, external, republished)
        assert _got(_frames(spark, *rows)) == _plain(*rows)


@pytest.mark.parametrize("hops", [18])
def test_republished_names_are_found_however_far(spark, hops):
    again = [(f"b{i}", f"b{i + 1}", 0) for i in range(hops)] + [(f"b{hops}", "b0", 0)]
    frames = _frames(spark, [(1, "x", "far", None)], [(7, f"b{hops}", "far", None, True), (9, "z", "far", None, True)], [("x", "far", "b0", 0)], [], again)
    assert _got(frames) == {(1, 7, f"b{hops}", 2, 1)}
    targets = spark.createDataFrame([(1, "b0")], "site long, file string")
    assert R.reexports(targets, frames[4]).count() == hops + 1


def test_ladder_without_rows(spark):
    assert not _got(_frames(spark, [], [], [], [], []))
    sites, declarations, *rest = _frames(spark, [(1, "a", "n", None)], [(1, "a", "n", None, None)], [], [], [])
    assert R.name_ladder(sites.drop("qualifier"), declarations.drop("top", "qualified_name"), rest[0].drop("at"), rest[1]).count() == 1
