"""Operators on hand-made inputs, and iterative ones against naive versions on seeded random graphs."""

from __future__ import annotations

import re
import itertools
import random

import numpy as np
import pytest

from graphloom.functions.picks import ranked_pick
from graphloom.operators import classes as C
from graphloom.operators import distribution as D
from graphloom.operators import graph as G
from graphloom.operators import history as H
from graphloom.operators import resolve as R
from graphloom.operators import text as X
from graphloom.operators.clones import Spans, clone_classes, clones_of_files, pieces
from graphloom.operators.context import bundle, declarations
from graphloom.operators.seams import seam
from graphloom.operators.small_graphs import minimum_cut
from graphloom.parse import python_source as P
from graphloom.plans import gate
from graphloom.plans.rules import Atom, Compare, Rule, RuleError, V, evaluate
from graphloom.sources import readers as S


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def random_graph(seed, n=14, m=26):
    r = random.Random(seed)
    return [(r.randrange(n), r.randrange(n)) for _ in range(m)], list(range(n + 2))


def naive_reach(edges, nodes):
    reach = set(edges)
    while True:
        more = {(a, d) for a, b in reach for c, d in edges if b == c} - reach
        if not more:
            return reach
        reach |= more


@pytest.mark.parametrize("seed", [1, 7])
@pytest.mark.parametrize("small", [True, False])
def test_scc_closure_levels(spark, seed, small, monkeypatch):
    if not small:  # the distributed rounds
        monkeypatch.setattr(G, "SMALL", 0), monkeypatch.setattr(G, "SMALL_CLOSURE", 0)
    edges, nodes = random_graph(seed)
    e, n = frame(spark, edges, "src long, dst long"), frame(spark, [(x,) for x in nodes], "node long")
    reach = naive_reach(edges, nodes)
    assert {tuple(r) for r in G.closure(e).collect()} == reach
    comp = {x: min([x, *(y for y in nodes if (x, y) in reach and (y, x) in reach)]) for x in nodes}
    found = G.scc(e, n)
    assert dict(found.collect()) == comp
    dag = {(comp[a], comp[b]) for a, b in edges if comp[a] != comp[b]}
    height = {}

    def up(x):
        if x not in height:
            height[x] = max((1 + up(b) for a, b in dag if a == x), default=0)
        return height[x]

    got = dict(G.levels(G.condense(e, found), frame(spark, [(x,) for x in set(comp.values())], "node long")).collect())
    assert got == {x: up(x) for x in set(comp.values())}
    around = reach | {(b, a) for a, b in reach}
    label = {x: x for x in nodes}
    for _ in nodes:
        for a, b in around:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(G.connected_components(e, n).collect()) == label
    first = min(a for a, _ in edges)
    best = {first: [first]}
    front = [first]
    while front:
        front = [(b, [*best[a], b]) for a in front for c, b in edges if c == a and b not in best]
        for b, path in sorted(front, key=lambda x: x[1]):
            best.setdefault(b, path)
        front = list(dict.fromkeys(b for b, _ in front))
    assert {r.node: (r.distance, list(r.path)) for r in G.shortest_paths(e, first).collect()} == {x: (len(p) - 1, p) for x, p in best.items()}
    assert {r.node for r in G.reachable(e, frame(spark, [(first,)], "node long")).collect()} == set(best)
    with_null = e.union(frame(spark, [(None, 1), (2, None)], "src long, dst long"))
    assert dict(G.scc(with_null, n).collect()) == comp


def test_levels_refuse_a_ring(spark, monkeypatch):
    ring, nodes = frame(spark, [(1, 2), (2, 1)], "src long, dst long"), frame(spark, [(1,), (2,)], "node long")
    with pytest.raises(Exception, match="cycle"):
        G.levels(ring, nodes).count()
    monkeypatch.setattr(G, "SMALL", 0)
    with pytest.raises(RuntimeError, match="cycle"):
        G.levels(ring, nodes, max_rounds=4)


def test_empty_graph(spark):
    e, n = frame(spark, [], "src long, dst long"), frame(spark, [(1,), (2,)], "node long")
    assert G.closure(e).count() == 0 and dict(G.scc(e, n).collect()) == {1: 1, 2: 2}
    assert dict(G.connected_components(e, n).collect()) == {1: 1, 2: 2}
    assert {(r.ca, r.ce, r.instability) for r in G.martin(e, n).collect()} == {(0, 0, 0.0)}


def test_minimum_cut_brute():
    for seed in range(6):
        edges, _ = random_graph(seed, 5, 10)
        edges = set(edges)
        cut = minimum_cut(sorted({x for e in edges for x in e}), edges)
        acyclic = lambda left: not any(a == b for a, b in naive_reach(left, [])) if left else True
        assert acyclic(edges - set(cut))
        assert not any(acyclic(edges - set(c)) for k in range(len(cut)) for c in itertools.combinations(edges, k))
    assert minimum_cut(list(range(21)), {(i, (i + 1) % 21) for i in range(21)}) is None


def chain(folder, n, *more):
    files = [f"{folder}/{i}.py" for i in range(n)]
    return list(zip(files, files[1:], strict=False)) + [(files[0], x) for x in more]


def split(edges, **more):
    return seam(edges, {x for e in edges for x in e}, **more)


def test_seam():
    two = chain("a", 5) + chain("b", 5)
    got = split(two)
    assert got["verdict"] == "fan_out" and [x["globs"] for x in got["lanes"]] == [["a/**"], ["b/**"]] and got["cross_lane_edges"] == 0
    got = split(chain("a", 5, "core.py") + chain("b", 5, "core.py"))
    assert got["hubs"] == [("core.py", 2)] and got["contracts"] == [("core.py", "hub")] and got["lanes"][0]["depends_on"] == ["contract"]
    assert split(chain("a", 5))["reasons"] == ["lanes: 1, a split needs 2"] and seam([], [])["verdict"] == "solo"
    assert len(split(two, unresolved_share=0.06, unparsed=("go",))["reasons"]) == 2
    ring = split(chain("a", 3, "t1.py") + chain("b", 3, "t1.py") + [("t1.py", "t2.py"), ("t2.py", "t1.py")])
    assert ring["reasons"] == ["a hub belongs to an import ring"] and ring["hubs"] == [("t1.py", 2), ("t2.py", 2)]
    common = split(chain("a", 3, "shared/u.py") + chain("b", 3, "shared/u.py"), commons=("shared/*",))
    assert common["contracts"] == [] and [x["name"] for x in common["lanes"]] == ["a", "b"]
    assert split(chain("core", 20) + chain("tiny", 3))["reasons"] == ["one lane has 87% of the files, 80% at most"]


def test_seam_folds_lanes():
    lonely = {f"p{k}/sub/{i}.py" for k in range(5) for i in range(3)}
    got = seam([], lonely, lanes_max=2)
    assert len(got["lanes"]) == 2 and sum(len(x["files"]) for x in got["lanes"]) == 15
    tied = seam(chain("a", 3, "b/0.py") + chain("b", 3) + chain("c", 3), {f"{k}/{i}.py" for k in "abc" for i in range(3)}, lanes_max=1, min_lane=1)
    assert len(tied["lanes"]) == 1
    go = [(f"{k}/{i}.go", f"event/{j}.go") for k in ("api", "web") for i in range(3) for j in range(3)]
    got = split(go)
    assert [x for x, _ in got["contracts"]] == [f"event/{j}.go" for j in range(3)] and [x["name"] for x in got["lanes"]] == ["api", "web"] and got["verdict"] == "fan_out"
    nested = seam(chain("x/one", 3) + chain("x/two", 3) + chain("y/one", 3), {f"{k}/{i}.py" for k in ("x/one", "x/two", "y/one") for i in range(3)})
    assert [(x["name"], x["globs"]) for x in nested["lanes"]] == [("one", ["x/one/**"]), ("two", ["x/two/**"]), ("one-2", ["y/**"])]


def naive_hubs(edges, nodes, unit):
    gone: set = set()
    while True:
        new = set()
        for u in set(unit.values()) - gone:
            rest = {x for x in nodes if unit[x] not in gone | {u}}
            users = {a for a, b in edges if unit[b] == u and unit[a] != u and a in rest}
            up = {x: x for x in rest}
            for _ in rest:
                for a, b in [*edges, *((x, y) for x in rest for y in rest if unit[x] == unit[y])]:
                    if a in up and b in up:
                        up[a] = up[b] = min(up[a], up[b])
            if len({up[x] for x in users}) > 1:
                new.add(u)
        if not new:
            return {x for x in nodes if unit[x] in gone}
        gone |= new


def test_seam_on_random_graphs():
    r = random.Random(5)
    for _ in range(60):
        files = [f"p{r.randrange(4)}/f{i}.py" for i in range(r.randrange(4, 14))]
        edges = {(a, b) for a in files for b in r.choices(files, k=r.randrange(3)) if a != b}
        got = seam(edges, files)
        assert got == seam(list(edges)[::-1], set(files))
        reach = naive_reach(edges, files) if edges else set()
        unit = {x: min([x, *(y for y in files if (x, y) in reach and (y, x) in reach)]) for x in files}
        assert {x for x, _ in got["hubs"]} == naive_hubs(edges, files, unit)
        contracts = {x for x, _ in got["contracts"]}
        lane = {}
        for k, x in enumerate(got["lanes"]):
            for f in files:
                if f not in contracts and any(f == g or g.endswith("/**") and f.startswith(g[:-2]) for g in x["globs"]):
                    assert f not in lane
                    lane[f] = k
            assert {f for f in lane if lane[f] == k} == set(x["files"])
        assert all(lane[a] == lane[b] for a, b in edges if a in lane and b in lane)
        assert set(lane) | contracts == set(files)


def test_rules(spark):
    facts = {"edge": frame(spark, [(1, 2), (2, 2), (2, 3), (2, 3)], "a int, b int"), "bad": frame(spark, [(3,)], "a int")}
    rows = evaluate([Rule("loop", {"x": V("X")}, (Atom("edge", (V("X"), V("X"))),)), Rule("ok", {"x": V("X"), "y": V("Y")}, (Atom("edge", (V("X"), V("Y"))), Atom("bad", (V("Y"),), negated=True), Compare(V("X"), "<", V("Y"))))], facts).collect()
    assert sorted((r.rule, r.x, r.y) for r in rows) == [("loop", "2", None), ("ok", "1", "2")]
    for body in ((Compare(V("X"), ">", 1),), (Atom("edge", (V("X"),)),), (Atom("edge", (V("X"), V("Y"))), Atom("bad", (V("Z"),), negated=True)), (Atom("none", (V("X"),)),)):
        with pytest.raises(RuleError):
            evaluate([Rule("r", {"x": V("X")}, body)], facts)
    with pytest.raises(RuleError):
        evaluate([Rule("r", {"x": V("Q")}, (Atom("bad", (V("X"),)),))], facts)


def test_globs():
    import re

    for glob, text, hit in (("src/*", "src/a/b.py", True), ("*.py", "a/b.py", True), ("a?c", "abc", True), ("a[!b]c", "abc", False), ("a.c", "abc", False), ("[a-c]x", "bx", True), ("a[", "a[", True)):
        assert bool(re.search(gate.glob_regex(glob), text)) == hit


def test_ratchet(spark):
    f = frame(spark, [("a", "r", 5.0), ("b", "r", 5.0), ("c", "r", 5.0), ("d", "unparseable", 1.0)], "key string, rule string, value double")
    b = frame(spark, [("a", 5.0), ("b", 4.0), ("d", 1.0)], "key string, value double")
    assert {r.key: r.state for r in gate.ratchet(f, b).collect()} == {"a": "forgiven", "b": "regressed", "c": "new", "d": "new"}
    assert gate.review_counts(gate.introduced(gate.ratchet(f, b), None)).first().introduced is None
    assert gate.baseline_of(f).count() == 3


def test_picks(spark):
    assert ranked_pick(frame(spark, [(i,) for i in range(10)], "v int"), "v", 0.9).first().pick == 9
    assert ranked_pick(frame(spark, [], "v int"), "v", 0.9).count() == 0
    g = D.gini(frame(spark, [("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 4.0)], "k string, v double"), "v", ["k"])
    assert {r.k: round(r.gini, 6) for r in g.collect()} == {"a": 0.0, "b": 0.5}
    assert D.god_cutoff(frame(spark, [(9000,)] * 3, "size int"), "size").first().cutoff == 5000


def test_global_ranks(spark):
    """Ranks over range partitions are those of one sorted list."""
    r = random.Random(8)
    values = [float(r.randrange(40)) for _ in range(500)] + [None] * 5
    df = frame(spark, [(v,) for v in values], "v double").repartition(7)
    known = sorted(v for v in values if v is not None)
    for q in (0.0, 0.5, 0.9, 1.0):
        assert ranked_pick(df, "v", q).first().pick == known[min(len(known) - 1, int(len(known) * q))] == ranked_pick(df, "v", q, few=True).first().pick
    n, total = len(known), sum(known)
    want = 2 * sum(i * x for i, x in enumerate(known, 1)) / (n * total) - (n + 1) / n
    got = D.gini(df, "v").first()
    assert got.gini == pytest.approx(want) and got.n == n
    top = sorted(known, reverse=True)[:50]
    assert D.erosion(df, "v").first().erosion == pytest.approx(sum(top) / total)
    assert ranked_pick(df.limit(0), "v", 0.5).count() == 0 and D.gini(df.limit(0), "v").first().gini == 0.0


def test_history(spark):
    rows = [("c1", "a", "x"), ("c1", "b", "x"), ("c2", "a", "y"), ("c2", "b", "x"), ("c3", "a", "x"), ("c3", "z", "x")] + [("big", f"f{i}", "x") for i in range(9)] + [("big", "a", "x"), ("big", "b", "x")]
    df = frame(spark, rows, "commit string, path string, author string")
    got = H.change_coupling(df, max_files=5, min_support=2, min_confidence=0.1).collect()
    assert [(r.a, r.b, r.support, r.confidence) for r in got] == [("a", "b", 2, 1.0)] and abs(got[0].jaccard - 2 / 3) < 1e-9
    own = {r.path: r for r in H.ownership(df).collect()}
    assert own["a"].top_author == "x" and own["a"].authors == 2 and H.bus_factor(H.ownership(df)).first()[0] == 1
    ring = frame(spark, [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old string, new string")
    assert {r.old: r.last for r in H.rename_chain(ring).collect()} == {"a": "c", "b": "c", "x": "x", "y": "x"}
    assert H.bus_factor(H.ownership(df.limit(0))).first()[0] == 0


def test_bm25(spark):
    docs = frame(spark, [(1, "parseHTTPResponse quickly"), (2, "parse parse parse"), (10, "parse"), (3, "nothing"), (4, None)], "id int, text string")
    q = frame(spark, [(0, "parse")], "qid int, text string")
    got = [r.id for r in X.bm25(docs, q, 10).orderBy("rank").collect()]
    assert got == [2, 10, 1]
    assert docs.select(X.tokens(docs.text).alias("t")).first().t == ["parse", "http", "response", "quickly"]
    assert X.bm25(docs, q.limit(0), 5).count() == 0


def test_bm25_of_equal_documents_is_equal(spark, tmp_path):
    """The same words in other orders: one score, so that ranks go by the id as a string. Small files make joins that keep the rows' order."""
    rng = random.Random(6)
    words = [f"w{chr(97 + i)}x" for i in range(26)]
    bag = [w for i, w in enumerate(words) for _ in range(1 + i % 5)]
    rows = [(i, " ".join(rng.sample(bag, len(bag)))) for i in range(300)] + [(1000 + i, " ".join(rng.sample(words, 1 + i % 20))) for i in range(100)]
    frame(spark, rows, "id int, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    frame(spark, [(0, " ".join(words))], "qid int, text string").write.parquet(f"{tmp_path}/asked")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = X.bm25(spark.read.parquet(f"{tmp_path}/docs"), spark.read.parquet(f"{tmp_path}/asked"), 1000).where("id < 1000").orderBy("rank").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len({r.score for r in got}) == 1 and [r.id for r in got] == sorted(range(300), key=str)


@pytest.mark.parametrize("chunk", [1 << 19, 40])
def test_repeated_windows_equal_naive_counts(spark, monkeypatch, chunk):
    """Few different words, a header in every file, repeated and null paths; small chunks tear the windows of one key apart."""
    monkeypatch.setattr(X, "CHUNK", chunk)
    rng, k = random.Random(7), 6
    header = [f"h{i}" for i in range(9)]
    files = [(f"f{i % 57:02}", (header if i % 2 else []) + [rng.choice("ab") if i % 3 else f"w{rng.randrange(40)}" for _ in range(rng.randrange(0, 60))]) for i in range(60)]
    files += [("z", ["q"] * 80), ("y", ["q"] * 30), ("x", None)]
    places: dict = {}
    for path, words in files:
        for i in range(len(words or []) - k + 1):
            places.setdefault(tuple(words[i : i + k]), []).append((path, i))
    want = sorted((*min(v), len(v), len({p for p, _ in v})) for v in places.values() if len(v) > 1)
    got = X.repeated_windows(frame(spark, files, "path string, tokens array<string>").repartition(3), k)
    assert sorted(tuple(r) for r in got.select("path", "pos", "places", "paths").collect()) == want
    assert X.repeated_windows(frame(spark, files[:0], "path string, tokens array<string>"), k).count() == 0


def naive_clones(files, lines, k, min_lines):
    """Token by token, over plain lists."""
    names = sorted(files)
    seen: dict = {}
    for p in names:
        for i in range(len(files[p]) - k + 1):
            seen.setdefault(tuple(files[p][i : i + k]), []).append((p, i))
    token = lambda p, i: files[p][i] if 0 <= i < len(files[p]) else None
    grown = {}
    for starts in seen.values():
        limit = min((b - a for p, a in starts for q, b in starts if p == q and b > a), default=10**9)
        if len(starts) < 2 or limit < k:
            continue
        n = k
        while n < limit and len(v := {token(p, i - 1) for p, i in starts}) == 1 and None not in v:
            starts, n = [(p, i - 1) for p, i in starts], n + 1
        while n < limit and len(v := {token(p, i + n) for p, i in starts}) == 1 and None not in v:
            n += 1
        grown.setdefault(tuple(starts), n)
    out, taken = set(), set()
    for starts, n in sorted(grown.items(), key=lambda x: (-x[1], -len(x[0]), x[0])):
        free = [(p, i) for p, i in starts if not taken & {(p, j) for j in range(i, i + n)}]
        if len(free) > 1 and all(lines[p][i + n - 1] - lines[p][i] + 1 >= min_lines for p, i in free):
            taken |= {(p, j) for p, i in free for j in range(i, i + n)}
            out |= {(f"{free[0][0]}:{free[0][1]}", p, i, n, lines[p][i], lines[p][i + n - 1]) for p, i in free}
    return out


def found_clones(spark, files, lines, k, min_lines):
    rows = [(p, i, t, lines[p][i]) for p, ts in files.items() for i, t in enumerate(ts)]
    got = clone_classes(frame(spark, rows, "path string, pos int, norm string, line int"), k, min_lines)
    return got, {tuple(r) for r in got.collect()}


def test_clones(spark):
    """Places that join inside a class don't stop its growth; the longest class is found whole."""
    a = [f"t{i}" for i in range(20)]
    files = {"p": a, "q": list(a), "r": a[5:15]}
    got, found = found_clones(spark, files, {p: list(range(len(ts))) for p, ts in files.items()}, 8, 4)
    assert found == {("p:0", "p", 0, 20, 0, 19), ("p:0", "q", 0, 20, 0, 19)}
    assert {r.path: r.lines for r in X.duplicate_lines(got).collect()} == {"p": 20, "q": 20}
    assert tuple(X.duplication(got, 50).first()) == (20, 0.4)
    near = {"p": (a + ["x"]) * 3, "q": ["z", *a[3:14]]}
    assert found_clones(spark, near, {p: list(range(len(ts))) for p, ts in near.items()}, 8, 4)[1] == naive_clones(near, {p: list(range(len(ts))) for p, ts in near.items()}, 8, 4)
    assert found_clones(spark, {"p": a[:5]}, {"p": list(range(5))}, 8, 4)[1] == set()


def test_clones_on_random_files(spark):
    r = random.Random(11)
    files, lines = {}, {}
    for g in range(12):
        block = [f"g{g}w{r.randrange(4)}" for _ in range(24)]
        for i in range(3):
            ts = []
            for _ in range(r.randrange(1, 5)):
                cut = r.randrange(len(block))
                ts += block[cut : cut + r.randrange(2, 18)] + [f"own{r.randrange(3)}"] * r.randrange(2)
            files[f"{g:02d}/{i}"] = ts
            lines[f"{g:02d}/{i}"] = [j // 2 for j in range(len(ts))]
    for k, min_lines in ((4, 1), (6, 3)):
        want = set()
        for g in range(12):
            own = {p: ts for p, ts in files.items() if p.startswith(f"{g:02d}/")}
            want |= naive_clones(own, lines, k, min_lines)
        assert found_clones(spark, files, lines, k, min_lines)[1] == want and len(want) > 20


def test_cohesion(spark):
    m = [("A", f"m{i}", f"f{i}") for i in range(5)] + [("B", f"m{i}", f) for i in range(4) for f in ("x", "y")] + [("C", "only", None)]
    got = {r.cls: r for r in C.cohesion(frame(spark, m, "cls string, method string, field string")).collect()}
    assert (got["A"].lcom4, got["A"].lcom1, got["A"].lcom2) == (5, 10, 10) and (got["B"].lcom4, got["B"].lcom1, got["B"].lcom_star) == (1, 0, 0.0)
    assert got["C"].lcom_star is None and got["C"].connectivity is None and got["C"].fields == 0


def naive_cohesion(name, touches, calls, fields, setup):
    """One class, method by method."""
    ms, own = sorted(touches), set(fields) | set().union(*touches.values())
    share = {(a, b) for a, b in itertools.combinations(ms, 2) if touches[a] & touches[b]}
    call = {tuple(sorted(c)) for c in calls if c[0] != c[1] and set(c) <= set(ms)}
    some = [m for m in ms if m not in setup and m != name] or ms
    parts = []
    for edges in (share, share | call):
        up = {m: m for m in some}
        for _ in some:
            for a, b in edges:
                if a in up and b in up:
                    up[a] = up[b] = min(up[a], up[b])
        parts.append(len(set(up.values())))
    n, pairs = len(ms), len(ms) * (len(ms) - 1) // 2
    star = (sum(len([m for m in ms if f in touches[m]]) for f in own) / len(own) - n) / (1 - n) if n > 1 and own else None
    links = 2 * (len(share | call) - (n - 1)) / ((n - 1) * (n - 2)) if n > 2 else None
    return (n, len(own), pairs - len(share), max(0, pairs - 2 * len(share)), *parts, star, links)


def test_cohesion_on_random_classes(spark):
    r = random.Random(3)
    classes, members, methods, calls, fields = {}, [], [], [], []
    for k in range(30):
        ms = r.sample(["__init__", f"K{k}", "a", "b", "c", "d", "e"], r.randrange(1, 7))
        touches = {m: set(r.choices("uvwxyz", k=r.randrange(3))) for m in ms}
        called = [(r.choice(ms), r.choice([*ms, "elsewhere"])) for _ in range(r.randrange(4))]
        declared = r.sample("stuv", r.randrange(3))
        classes[f"K{k}"] = naive_cohesion(f"K{k}", touches, called, declared, {"__init__"})
        members += [(f"K{k}", m, f) for m in ms for f in touches[m]] * 2
        methods += [(f"K{k}", m) for m in ms]
        calls += [(f"K{k}", *c) for c in called]
        fields += [(f"K{k}", f) for f in declared]
    got = C.cohesion(frame(spark, members, "cls string, method string, field string"), frame(spark, methods, "cls string, method string"), frame(spark, calls, "cls string, method string, callee string"), frame(spark, fields, "cls string, field string"))
    rows = {x[0]: tuple(x)[1:] for x in got.collect()}
    assert rows.keys() == classes.keys()
    for k, want in classes.items():
        assert rows[k] == pytest.approx(want) if None not in want else [round(a, 9) if a is not None else a for a in rows[k]] == [round(a, 9) if a is not None else a for a in want], k
        assert rows[k][5] <= rows[k][4]


def test_inheritance(spark):
    bases = frame(spark, [("B", "A"), ("C", "B"), ("D", "B"), ("D", "C"), ("E", "Ext"), ("R", "S"), ("S", "R")], "cls string, base string")
    known = frame(spark, [(x,) for x in "ABCDERS"], "cls string")
    got = {r.cls: (r.dit, r.external) for r in C.inheritance_depth(bases, known).collect()}
    assert got == {"A": (0, False), "B": (1, False), "C": (2, False), "D": (3, False), "E": (1, True), "R": (0, False), "S": (0, False)}


def test_inheritance_raises_when_rounds_end(spark):
    bases = frame(spark, [(i, i - 1) for i in range(1, 7)], "cls int, base int")
    known = frame(spark, [(i,) for i in range(7)], "cls int")
    assert {r.cls: r.dit for r in C.inheritance_depth(bases, known).collect()} == {i: i for i in range(7)}
    assert C.inheritance_depth(bases.limit(0), known.limit(0)).count() == 0
    with pytest.raises(RuntimeError):
        C.inheritance_depth(bases, known, max_rounds=3)


def test_innermost(spark):
    spans = frame(spark, [("f", 0, 100, "outer"), ("f", 10, 20, "inner"), ("g", 0, 5, "g")], "path string, start int, end int, name string")
    points = frame(spark, [(1, "f", 15), (2, "f", 20), (3, "f", 100), (4, "g", 4)], "id int, path string, at int")
    for bucket in (None, 8):
        assert {r.id: r.name for r in R.innermost(points, spans, "path", bucket).collect()} == {1: "inner", 2: "outer", 4: "g"}
    s = frame(spark, [("pkg mod/Cls#meth().",), ("pkg `odd name`/",), ("local 3",)], "s string")
    assert [r[0] for r in s.select(R.symbol_tail(s.s)).collect()][:2] == ["meth", "odd name"]


def test_bundle(spark):
    rows = [(i, f"c{i}", i < 5, f"limit complexity of module {i}", ["src/*"] if i % 2 else ["src/a/*"], "r", float(i)) for i in range(10)]
    cons = frame(spark, rows, "id int, name string, enforced boolean, text string, globs array<string>, rule string, limit double")
    files = frame(spark, [("src/a/x",), ("src/b/y",)], "path string")
    got = bundle(cons, files, "complexity").orderBy("position").collect()
    assert len(got) == 7 and got[0].omitted == 3 and sum(r.enforced for r in got) == 4 and got[0].governs == 2
    assert [r.limit for r in declarations(cons, "r", "src/b/y").collect()] == [1.0, 3.0, 5.0, 7.0, 9.0]


def test_log_and_diff(spark):
    log = "\x1esha1\x00An Author\x00a@x\x002024-01-02T03:04:05+00:00\x00fix a => b | c\n\n1\t2\tsrc/{old => new}/f.py\n-\t-\timg.png\n\x1ebroken\x00x\n\x1esha2\x00B\x00b@x\x00never\x00s\n\n3\t0\ta.py => b.py\n"
    got = {(r.commit, r.path): r for r in S.parse_log(frame(spark, [(log,)], "value string")).collect()}
    assert got["sha1", "src/new/f.py"].old_path == "src/old/f.py" and got["sha1", "img.png"].added == 0 and got["sha2", "b.py"].old_path == "a.py"
    assert got["sha2", "b.py"].ts.year == 1970 and got["sha1", "img.png"].subject == "fix a => b | c"
    diff = ["+++ b/x.py", "@@ -1,2 +3,2 @@ def", "+a", "@@ -9 +12 @@", "@@ -9,1 +20,0 @@", "+++ b/y.py", "@@ -0,0 +1 @@"]
    rows = [("d", i, v) for i, v in enumerate(diff)]
    assert sorted((r.path, r.line) for r in S.diff_lines(frame(spark, rows, "file string, pos int, value string")).collect()) == [("x.py", 3), ("x.py", 4), ("x.py", 12), ("y.py", 1)]


def test_wire(spark):
    assert list(S.wire_fields(b"\x08\x96\x01\x12\x02hi")) == [(1, 0, 150), (2, 2, b"hi")] and S.packed(b"\x01\x96\x01") == [1, 150]
    for bad in (b"\x08\xff", b"\x12\x05a", b"\x08" + b"\xff" * 11):
        with pytest.raises(ValueError):
            list(S.wire_fields(bad))
    occurrence = b"\x0a\x03\x01\x02\x05" + b"\x12\x01s" + b"\x18\x01"
    doc = b"\x0a\x01p" + b"\x12" + bytes([len(occurrence)]) + occurrence
    data = b"\x12" + bytes([len(doc)]) + doc
    got = S.index_occurrences(frame(spark, [(bytearray(data + data),)], "content binary")).collect()
    assert [tuple(r) for r in got] == [("p", "s", 1, 2, 1, 5, 1)]


def test_tree_and_decisions(spark, tmp_path):
    for name, text in (("a.py", "x = 1\n"), ("node_modules/b.py", "y"), ("doc.txt", "z"), (".hid/c.py", "w"), ("gen/d.py", "v")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = S.source_tree(spark, str(tmp_path), ["gen/*"]).collect()
    assert [(r.path, r.language) for r in got] == [("a.py", "python")]
    d = frame(spark, [("adr/0001-x.md", "---\ntitle: Use joins\nstatus: Accepted\n---\nBody"), ("adr/2.md", "# Old style\n\n## Status\n\nProposed\n"), ("adr/3.md", "nothing")], "path string, value string")
    assert sorted((r.decision, r.title, r.status) for r in S.decisions(d).collect()) == [("0001-x", "Use joins", "accepted"), ("2", "Old style", "proposed")]


def test_python_source(spark):
    src = 'def f(a, b=1):\n    if a and b or a:\n        for x in a:\n            if x: return 1\n            elif b: pass\n            else: raise X\n    return [y for y in a if y]\n'
    got = {r.metric_key: r for r in P.measure_files(frame(spark, [("p.py", src), ("bad.py", "def (")], "path string, text string")).collect() if r.entity != "p.py"}
    assert {k: got[k].value for k in ("cyclomatic", "cognitive", "params", "nesting", "exits")} == {"cyclomatic": 9.0, "cognitive": 13.0, "params": 2.0, "nesting": 3.0, "exits": 3.0}
    assert len(got["cognitive"].explanation) == 9 and got["parse_incomplete"].entity == "bad.py"
    renamed = re.sub(r"\ba\b", "q9", src)
    assert P.cyclomatic(P.ast.parse(renamed).body[0]) == 9


def test_python_rows(spark):
    src = """
import a.b, c as d
from x import y
G = 1
def outer(p, *rest, k=lambda q: q):
    global G
    G = 2
    v = [(w := i) for i in rest]
    def inner():
        nonlocal v
        v = 3
        with open(p) as f, g() as (h, j): pass
    try: pass
    except ValueError as e: del v
    return inner
class K(Base):
    field: int = 0
    @staticmethod
    def s(z): return z
    def m(self, z):
        for self.a, t in z: self.run(self.a)
"""
    files = frame(spark, [("p.py", src), ("bad.py", "def ("), ("none.py", None)], "path string, text string")
    scopes = {r.scope: (r.kind, r.name, r.parent) for r in P.scope_rows(files).collect()}
    assert [scopes[i] for i in sorted(scopes)] == [("module", "", None), ("function", "outer", 0), ("lambda", "", 0), ("comprehension", "", 1), ("function", "inner", 1), ("class", "K", 0), ("function", "s", 5), ("function", "m", 5)]
    got = {(r.scope, r.name, r.kind) for r in P.binding_rows(files).collect()}
    assert got == {
        (0, "a", "import"), (0, "d", "import"), (0, "y", "import"), (0, "G", "assignment"), (0, "outer", "definition"), (0, "K", "definition"),
        (1, "p", "parameter"), (1, "rest", "parameter"), (1, "k", "parameter"), (1, "v", "assignment"), (1, "w", "assignment"), (1, "inner", "definition"), (1, "e", "assignment"),
        (2, "q", "parameter"), (3, "i", "assignment"), (4, "f", "assignment"), (4, "h", "assignment"), (4, "j", "assignment"),
        (5, "field", "assignment"), (5, "s", "definition"), (5, "m", "definition"), (6, "z", "parameter"), (7, "self", "receiver"), (7, "z", "parameter"), (7, "t", "assignment"),
    }
    assert {(r.method, r.member, r.access) for r in P.member_rows(files).collect()} == {("m", "a", "read"), ("m", "a", "write"), ("m", "run", "call"), ("s", None, None)}
    assert {(r.entity, r.callee) for r in P.call_rows(files).collect()} == {("outer.inner", "open"), ("outer.inner", "g"), ("K.m", "run")}
    assert sorted((r.specifier, r.line) for r in P.import_rows(files).collect()) == [("a.b", 2), ("c", 2), ("x", 3)]
    tokens = [r.norm for r in P.token_rows(frame(spark, [("t.py", "x = f(1) # c")], "path string, text string")).orderBy("pos").collect()]
    assert tokens[:5] == ["$ID", "=", "$ID", "(", "$LIT"]


def test_ledger_at_once_is_the_stream(spark, tmp_path):
    from graphloom.streaming.ledger import ledger_at_once, retry_ledger

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the time to live would ask for one more batch forever
    rows = [("s", f"p{k}", i, "k", float(10 * k + i)) for k, n in enumerate((1, 3, 4, 12)) for i in range(n)]
    schema = "session string, path string, run_id long, key string, value double"
    frame(spark, rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    q = retry_ledger(spark.readStream.schema(schema).json(str(tmp_path / "in"))).writeStream.format("memory").queryName("ledger2").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    last = {}
    for r in spark.sql("select * from ledger2 order by attempts").collect():
        last[r.session, r.path, r.key] = (r.attempts, list(r["values"]), r.exhausted)
    got = ledger_at_once(frame(spark, rows, schema), ["session", "path", "key"], ["run_id"], "value")
    assert {(r.session, r.path, r.key): (r.attempts, list(r["values"]), r.exhausted) for r in got.collect()} == last


def test_retry_ledger(spark, tmp_path):
    from graphloom.streaming.ledger import retry_ledger

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # the time to live would ask for one more batch forever
    runs = [[("k", 1.0)], [("k", 2.0)], [("k", 3.0)], [("k", 4.0), ("j", 1.0)], [(None, None)]]
    rows = [("s", "p.py", i, k, v) for i, fs in enumerate(runs) for k, v in fs]
    schema = "session string, path string, run_id long, key string, value double"
    frame(spark, rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).json(str(tmp_path / "in"))
    q = retry_ledger(stream).writeStream.format("memory").queryName("ledger").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = [tuple(r) for r in spark.sql("select key, attempts, exhausted, repaired, size(values) from ledger order by key, repaired, attempts").collect()]
    assert got == [("j", 1, False, False, 1), ("j", 1, False, True, 1), ("k", 1, False, False, 1), ("k", 2, False, False, 2), ("k", 3, False, False, 3), ("k", 4, True, False, 4), ("k", 4, False, True, 4)]


def test_clones_with_a_header_in_every_file(spark):
    """A shared header, a chain of overlapping passages, repeats within a file, files without a path and further columns."""
    head = [f"h{i}" for i in range(12)]
    files = {f"f{i:03d}": head + [f"own{i}x{j}" for j in range(i % 5)] for i in range(60)}
    chain = [f"c{i}" for i in range(60)]
    for i in range(10):
        files[f"a{i}"] = chain[5 * i : 5 * i + 14] + [f"a{i}"] + chain[5 * i : 5 * i + 8]
    files["z"] = ["s", "t"] * 20 + ["u"] + ["s", "t"] * 20
    lines = {p: list(range(len(ts))) for p, ts in files.items()}
    rows = [(p, i, t, lines[p][i], "x", "y") for p, ts in files.items() for i, t in enumerate(ts)] + [(None, i, t, i, "x", "y") for i, t in enumerate(head * 2)]
    got = clone_classes(frame(spark, rows, "path string, pos int, norm string, line int, class string, z string"), 6, 2)
    assert {tuple(r) for r in got.collect()} == naive_clones(files, lines, 6, 2)


def test_clones_of_repeated_paths(spark):
    """Rows that repeat a path whole change nothing; rows that share a path but not a text still come to an end."""
    a = [f"t{i}" for i in range(20)]
    rows = [("p", a, list(range(20))), ("p", a, list(range(20))), ("q", a[4:], list(range(16))), (None, a, list(range(20)))]
    docs = spark.createDataFrame(rows, "path string, tokens array<string>, lines array<long>")
    got = {tuple(r) for r in clones_of_files(docs, 8, 2).select("path", "start").collect()}
    assert {p for p, _ in got} <= {"p", "q"}
    mixed = docs.unionByName(spark.createDataFrame([("q", a[:9] * 2, list(range(18)))], docs.schema))
    assert clones_of_files(mixed, 8, 2).count() >= 0


def test_spans_and_pieces():
    r = random.Random(3)
    for _ in range(50):
        spans, marked = Spans(), set()
        for _ in range(30):
            a = r.randrange(100)
            b = a + r.randrange(1, 12)
            assert spans.meets(a, b) == bool(marked & set(range(a, b)))
            if r.random() < 0.5:
                spans.add(a, b)
                marked |= set(range(a, b))
    z = np.arange(100, dtype=np.uint64)
    assert len(pieces(z, 2)) == 32 and len(pieces(z, 8)) == 12 and len(pieces(z, 101)) == 0
    assert pieces(z, 4)[0] == pieces(z[:4], 4)[0] != pieces(z[:4][::-1], 4)[0]
