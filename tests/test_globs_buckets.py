"""Globs by automaton against ``fnmatch``; a table in buckets against the plain replace."""

from __future__ import annotations

import os
import random
from fnmatch import fnmatchcase

import pytest

from graphloom.plans.gate import scope_paths
from graphloom.plans.globs import Automaton, matching
from graphloom.sources import buckets as B


def test_automaton_is_fnmatch():
    r = random.Random(5)
    alphabet = "ab/."
    globs = sorted({"".join(r.choice([*alphabet, "*", "?", "[ab]", "[!a]", "[a-c.]", "[", "**"]) for _ in range(r.randrange(7))) for _ in range(600)})
    automaton = Automaton(globs)
    for _ in range(400):
        path = "".join(r.choice(alphabet + "c\n") for _ in range(r.randrange(9)))
        assert sorted(automaton.matches(path)) == [g for g in globs if fnmatchcase(path, g)]


def test_matching_in_blocks(spark):
    paths = [f"{a}/{b}{i}.{x}" for a in ("src", "lib/gen", "") for b in "fg" for i in range(12) for x in ("py", "go")]
    globs = ["*.py", "*/f1?.go", "*gen*", "src/*", "?rc/f[0-3].py", "*.py", "", "nothing", None]
    p, g = spark.createDataFrame([(x, 1) for x in [*paths, None]], "path string, glob int"), spark.createDataFrame([(x,) for x in globs], "glob string")
    want = sorted((x, y) for x in paths for y in set(globs) - {None} if fnmatchcase(x, y))
    assert sorted(map(tuple, matching(p, g).collect())) == want
    assert sorted(map(tuple, matching(p, g, block=2).collect())) == want
    assert matching(p, g.limit(0)).count() == 0 and matching(p.limit(0), g).count() == 0
    decisions = spark.createDataFrame([("d1", ["*.py", "src/*"]), ("d2", ["lib/*"]), ("d3", []), ("d4", None)], "decision string, globs array<string>")
    want = {(d, x) for d, gs in (("d1", ["*.py", "src/*"]), ("d2", ["lib/*"])) for x in paths for y in gs if fnmatchcase(x, y)}
    got = [tuple(r) for r in scope_paths(decisions, p).collect()]
    assert set(got) == want and len(got) == len(want)


def _files(root):
    return {os.path.join(at, f) for at, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_buckets(spark, tmp_path):
    root = str(tmp_path / "t")
    old = [(f"p{i % 40}" if i % 41 else None, i, "x") for i in range(400)]
    df = spark.createDataFrame(old, "path string, v int, bucket string")
    assert B.create(df, root, buckets=16) == 0
    assert sorted(map(tuple, B.read(spark, root).collect()), key=str) == sorted(old, key=str)
    first, held = _files(root), B.read(spark, root)
    new = [("p3", -1, "y"), ("p3", -2, "y"), ("new", -3, "y"), (None, -4, "y")]
    assert B.replace(spark.createDataFrame([(b, v, p) for p, v, b in new], "bucket string, v long, path string"), root) == 1
    want = [r for r in old if r[0] not in ("p3", "new")] + new
    assert sorted(map(tuple, B.read(spark, root).collect()), key=str) == sorted(want, key=str)
    # an earlier version, and a reader that has begun, see what they saw; untouched buckets keep their files
    assert sorted(map(tuple, B.read(spark, root, 0).collect()), key=str) == sorted(map(tuple, held.collect()), key=str) == sorted(old, key=str)
    assert first <= _files(root)
    shared = {f.removeprefix("file://") for f in B.read(spark, root).inputFiles()} & first
    touched = {f"{B.BUCKET}={r[0]}" for r in B._dealt(spark.createDataFrame([(p,) for p, *_ in new], "path string"), "path", 16).select(B.BUCKET).collect()}
    assert shared == {f for f in first if f.split("/")[-2] not in touched} and len(shared) > 5
    assert B.replace(df.limit(0), root) == 2 and B.read(spark, root).count() == len(want)
    seen = spark.createDataFrame([(f"p{i}",) for i in range(40) if i != 7], "path string")
    assert B.prune_unseen(seen, root) == 3
    assert sorted(map(tuple, B.read(spark, root).collect())) == sorted(r for r in want if r[0] not in (None, "new", "p7"))
    assert B.prune_unseen(seen.limit(0), root) == 4 and B.read(spark, root).count() == 0 and B.read(spark, root, 3).count() > 0
    with pytest.raises(B.VersionTaken):
        B._commit(spark, root, 4, {})
    with pytest.raises(B.VersionTaken):
        B.create(df, root)
    assert B.versions(spark, root) == [0, 1, 2, 3, 4]
    with pytest.raises(ValueError):
        B.read(spark, str(tmp_path / "none"))
    empty = str(tmp_path / "e")
    B.create(df.limit(0), empty)
    assert B.read(spark, empty).count() == 0
    B.replace(df, empty)
    assert B.read(spark, empty).count() == 400
