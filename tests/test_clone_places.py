"""Places of repeated windows against brute force."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from graphloom.operators.clones import places_of_repeats


def _files():
    rng = random.Random(7)
    word = lambda n, m: [f"w{rng.randrange(m)}" for _ in range(n)]
    shared = word(300, 10_000)
    files = {i: word(20, 10_000) + shared + word(20, 10_000) for i in range(3)}
    files |= {10: word(80, 2), 11: word(80, 2), 12: ["a"] * 60, 13: ["a", "b", "c"] * 15, 14: shared[50:120] + word(9, 99) + shared[40:130], 15: word(200, 10_000), 16: ["x"] * 9, 17: []}
    return files


@pytest.mark.parametrize("most", [1 << 19, 16])
@pytest.mark.parametrize("k", [10, 7, 2])
def test_places_are_runs_of_windows_that_stand_side_by_side(spark, most, k):
    """Each window of each run, with all its places; a text of 300 tokens in three files takes a row for some windows, not one for each."""
    files = _files()
    docs = spark.createDataFrame(list(files.items()), "path long, tokens array<string>").repartition(3)
    rows = places_of_repeats(docs, k, most).collect()
    text = lambda path, pos: tuple(files[path][pos : pos + k])
    all_ = Counter(text(p, i) for p, ts in files.items() for i in range(len(ts) - k + 1))
    got = [(r.path, r.pos + j, r.n) for r in rows for j in range(r.length)]
    want = [(p, i, all_[text(p, i)]) for p, ts in files.items() for i in range(len(ts) - k + 1) if all_[text(p, i)] > 1]
    assert sorted(got) == sorted(want)
    by = {}
    for r in rows:
        by.setdefault((r.hi, r.lo), []).append(r)
    for same in by.values():  # a row's windows beside it are the same at all places
        assert len(same) == same[0].n and len({(r.n, r.length, tuple(files[r.path][r.pos : r.pos + r.length + k - 1])) for r in same}) == 1
    if most > 16 and k > 2:
        assert len(rows) < len(want) / 2


def test_places_in_files_of_one_path_count_once(spark):
    shared = [f"s{i}" for i in range(40)]
    rows = [(1, shared), (1, shared), (2, shared), (2, ["z"] * 5), (3, ["q"] * 5)]
    got = places_of_repeats(spark.createDataFrame(rows, "path long, tokens array<string>"), 10).collect()
    assert sorted((r.path, r.pos + j, r.n) for r in got for j in range(r.length)) == [(p, i, 2) for p in (1, 2) for i in range(31)]
