"""The distributed loops of the graph operators, without the one-task path."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import graph as G
from graphloom.operators import in_task


@pytest.fixture
def tables(monkeypatch):
    """Counts the tables that loops write."""
    written = []
    for name in ("checkpointed", "counted"):
        real = getattr(G, name)
        monkeypatch.setattr(G, name, lambda df, *a, real=real: written.append(1) or real(df, *a))
    return written


def _edges(spark, pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_long_chains_and_rings_cost_their_logarithm(spark, tables):
    """An ascending chain of 5,000, a ring of 700, a ring of 300 through a hub, beside a random graph."""
    rng = random.Random(1)
    pairs = {(rng.randrange(100_000, 100_600), rng.randrange(100_000, 100_600)) for _ in range(1500)}
    pairs |= {(i, i + 1) for i in range(5000)} | {(10_000 + i, 10_000 + (i + 1) % 700) for i in range(700)}
    pairs |= {(20_000 + i, 20_000 + (i + 1) % 300) for i in range(300)} | {(20_000, 30_000), (30_000, 20_000), (30_000, 20_007)}
    pairs |= {(4999, 100_000), (100_001, 20_000)}
    got = dict(G.scc(_edges(spark, pairs), small=0).collect())
    assert got == dict(in_task.scc(sorted(pairs), sorted({x for p in pairs for x in p})))
    assert len(tables) < 70


def test_levels_of_long_chains_and_trees(spark, tables):
    rng = random.Random(2)
    pairs = {(i, i + 1) for i in range(2000)} | {(10_000 + i, 10_000 + rng.randrange(i)) for i in range(1, 500)} | {(10_499, 0), (10_400, 1000)}
    pairs |= {(20_000 + i, 20_000 + j) for i in range(60) for j in rng.sample(range(i), min(i, 3))}
    nodes = sorted({x for p in pairs for x in p} | {77_777})
    got = dict(G.levels(_edges(spark, pairs), spark.createDataFrame([(x,) for x in nodes], "node long"), small=0).collect())
    assert got == dict(in_task.levels(sorted(pairs), nodes))


@pytest.mark.parametrize("ring", [[(i, (i + 1) % 600) for i in range(600)], [(0, 1), (1, 2), (2, 0), (0, 2), (1, 0), (2, 1), (3, 0)]])
def test_rings_have_no_levels(spark, tables, ring):
    with pytest.raises(RuntimeError, match="cycle"):
        G.levels(_edges(spark, ring), spark.createDataFrame([(0,)], "node long"), small=0)
    assert len(tables) < 25


def test_reach_by_words_equals_floods(spark, tables):
    """20,000 nodes in eight layers, with rings among them; rows are words, never pairs of all nodes."""
    rng = random.Random(3)
    layer = 2500
    pairs = {(i, (i // layer + 1) * layer + rng.randrange(layer)) for i in range(7 * layer) for _ in range(rng.choice([0, 1, 1, 2]))}
    for k in range(40):
        ring = [k * 400 + j for j in range(rng.randint(2, 5))]
        pairs |= set(zip(ring, ring[1:] + ring[:1], strict=True))
    pairs |= {(5, 9), (9, 4000), (4000, 5)}
    nodes = list(range(8 * layer))
    got = {r.node: (r.fan_out, r.fan_in) for r in G.reach_counts(_edges(spark, pairs), spark.range(len(nodes)).withColumnRenamed("id", "node"), small=0).collect()}
    ahead, back = in_task._out(list(pairs)), in_task._out([(b, a) for a, b in pairs])
    some = rng.sample(nodes, 1500) + [4, 5, 9, 400, 401, 4000]
    assert {x: got[x] for x in some} == {x: (len(in_task._flood([x], ahead, set())), len(in_task._flood([x], back, set()))) for x in some}
    assert sum(o for o, _ in got.values()) == sum(i for _, i in got.values()) and len(got) == len(nodes)


def test_components_of_long_shuffled_paths_settle(spark, tables, monkeypatch):
    """Paths whose numbers are in no order, a star, a ring: rounds follow the number of nodes, not the paths' length."""
    monkeypatch.setattr(G, "SMALL", 0)
    rng = random.Random(4)
    names = rng.sample(range(1_000_000), 6000)
    pairs = set(zip(names[:3999], names[1:4000], strict=True)) | {(names[4000], x) for x in names[4001:5000]} | {(names[5000 + i], names[5000 + (i + 1) % 900]) for i in range(900)}
    pairs |= {(names[5950], names[5950]), (names[5951], names[5952]), (names[5952], names[5951])}
    got = G.connected_components(_edges(spark, pairs), spark.createDataFrame([(x,) for x in names], "node long")).collect()
    assert len(got) == len(names) and dict(got) == dict(in_task.components(sorted(pairs), sorted(names)))
    assert len(tables) < 80


def test_components_of_nothing_and_of_lone_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "SMALL", 0)
    none = spark.createDataFrame([], "src long, dst long")
    assert G.connected_components(none).count() == 0
    assert G.connected_components(spark.createDataFrame([(3, 3), (4, None)], "src long, dst long"), spark.createDataFrame([(1,), (None,)], "node long")).orderBy("node").collect() == [(1, 1), (3, 3)]


def test_reach_of_deep_trees_costs_their_logarithm(spark, tables):
    """A path of 1,500 with twigs into rings, trees into and out of a middle whose nodes have several successors."""
    rng = random.Random(5)
    pairs = {(i, i + 1) for i in range(1500)} | {(2000 + i, rng.randrange(1500)) for i in range(500)} | {(1500, 3000), (3000, 3001), (3001, 3002), (3002, 3000)}
    pairs |= {(4000 + i, 4000 + rng.randrange(i)) for i in range(1, 300)} | {(5000 + rng.randrange(i), 5000 + i) for i in range(1, 300)}
    pairs |= {(6000 + i, 6000 + j) for i in range(30) for j in rng.sample(range(i), min(i, 2))} | {(4000, 6029), (4007, 6020), (6000, 5000), (6001, 5000), (6003, 5002)}
    pairs |= {(7000, 6011), (7001, 7000), (5299, 7010), (7010, 7011), (7011, 7010)}
    nodes = sorted({x for p in pairs for x in p} | {9999})
    got = {r.node: (r.fan_out, r.fan_in) for r in G.reach_counts(_edges(spark, pairs), spark.createDataFrame([(x,) for x in nodes], "node long"), small=0).collect()}
    ahead, back = in_task._out(list(pairs)), in_task._out([(b, a) for a, b in pairs])
    assert got == {x: (len(in_task._flood([x], ahead, set())), len(in_task._flood([x], back, set()))) for x in nodes}
    assert len(tables) < 200


def test_reach_where_every_node_has_one_edge(spark, tables):
    """A random function: tails of some dozen nodes lead to rings, a path of 300 to one of 40; some nodes end. Trees and rings take a pass each."""
    rng = random.Random(6)
    pairs = {(i, rng.randrange(3000)) for i in range(3000) if rng.random() < 0.999} | {(4000 + i, 4001 + i) for i in range(340)} | {(4340, 4301), (5000, 5001), (5001, 5000), (5002, 5002), (5003, 5002)}
    nodes = sorted({x for p in pairs for x in p} | {9999})
    frame = spark.createDataFrame([(x,) for x in nodes], "node long")
    got = {r.node: (r.component, r.fan_out, r.fan_in) for r in G.reach_counts(_edges(spark, pairs), frame, small=0).collect()}
    ahead, back = in_task._out(list(pairs)), in_task._out([(b, a) for a, b in pairs])
    comp = dict(in_task.scc(sorted(pairs), nodes))
    assert got == {x: (comp[x], len(in_task._flood([x], ahead, set())), len(in_task._flood([x], back, set()))) for x in nodes}
    assert len(tables) < 40


def test_components_between_trees_and_forks(spark, monkeypatch):
    """Random graphs with some forks, so that rings run through trees that hang on them; against the depth-first form."""
    monkeypatch.setattr(G, "FEW_FORKS", 0)
    for seed in range(3):
        rng = random.Random(seed)
        pairs = {(i, rng.randrange(120)) for i in range(120)} | {(rng.randrange(120), rng.randrange(120)) for _ in range(8 * seed)}
        pairs |= {(b + 200, a + 200) for a, b in pairs} | {(7, 207), (230, 311)}
        assert dict(G.scc(_edges(spark, pairs), small=0).collect()) == dict(in_task.scc(sorted(pairs), sorted({x for p in pairs for x in p})))
