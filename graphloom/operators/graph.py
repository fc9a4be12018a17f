"""Graph operators over edge tables (G1, G3-G8, G12-G14, G18-G23, A19-A22, A24-A29): loops of ordinary joins, each round cut by a table.

Edges are ``(src, dst)``, nodes ``(node)``; isolated nodes are kept wherever nodes are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.picks import ranked_pick
from ..runtime import checkpointed, counted, release
from . import in_task

#: Edges and nodes up to which a graph is taken to one task (for closures, whose result is a square, fewer).
SMALL, SMALL_CLOSURE = 200_000, 2_000
#: Edges for each node of several edges out from which on pointers along only edges double before nodes are trimmed.
FEW_FORKS = 100


def _all_nodes(edges: DataFrame, nodes: DataFrame | None) -> DataFrame:
    ends = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    return (ends if nodes is None else ends.union(nodes.select("node"))).distinct()


def _table(edges: DataFrame, nodes: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None, int]:
    """Distinct edges and nodes as tables, and how many rows both have."""
    edges, n = counted(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    if nodes is None:
        return edges, None, n
    nodes, m = counted(nodes.select("node").where("node is not null").distinct())
    return edges, nodes, n + m


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def closure(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """G6 without reflexive pairs: ``(src, dst)`` where ``dst`` is reached over one edge or more.

    Squares the reach relation (``reach + reach join reach``), so the rounds are the logarithm of the longest path; cycles
    end it by themselves as pairs are distinct. The result is as large as the relation is: condense first
    where components are large (see ``reach_counts``). Null ends are ignored, repeated edges count once, no edges give no rows.
    """
    reach, _, size = _table(edges)
    if size <= SMALL_CLOSURE:
        return checkpointed(in_task.in_one_task(reach, None, in_task.closure, "src NODE, dst NODE"))
    for _ in range(max_rounds):
        step = reach.withColumnRenamed("dst", "mid").join(reach.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        old, (reach, now) = reach, counted(reach.union(step).distinct())
        release(old)
        if now == size:
            return reach
        size = now
    raise RuntimeError("closure did not settle")


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """``(node, component)``, the least node joined with each node, edges taken as undirected.

    Every node points to its least neighbour. Ways of such pointers end in two nodes that are each other's least neighbour, the
    lesser of which is the least of all that lead there; pointers that double find it, all nodes of a way become that one,
    and the edges between different ones are left. That halves the nodes with edges at least, so rounds are the logarithm of
    their number whatever the graph's shape. When ``small`` rows are left (SMALL, 0: never), one task ends it. Null ends are
    ignored, a node without edges is its own component; nothing gives no rows.
    """
    small = SMALL if small is None else small
    edges, nodes, size = _table(edges, nodes)
    if size <= small:
        return checkpointed(in_task.in_one_task(edges, nodes, in_task.components, "node NODE, component NODE"))
    everyone = checkpointed(_all_nodes(edges, nodes))
    live, left = counted(symmetric(edges.where("src <> dst")))
    merged = []
    while left:
        if left <= small:
            merged.append(checkpointed(in_task.in_one_task(live, None, in_task.components, "node NODE, component NODE")))
            release(live)
            break
        least = checkpointed(live.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("to")))
        mutual = (F.col("back") == F.col("node")) & (F.col("node") < F.col("to"))
        step = least.join(least.select(F.col("node").alias("to"), F.col("to").alias("back")), "to").select("node", F.when(mutual, F.col("node")).otherwise(F.col("to")).alias("component"))
        roots = _rooted(step)
        release(least)
        merged.append(roots)
        side = lambda end: roots.select(F.col("node").alias(end), F.col("component").alias(f"_{end}"))  # noqa: B023, E731
        before = live
        live, left = counted(live.join(side("src"), "src").join(side("dst"), "dst").where("_src <> _dst").select(F.col("_src").alias("src"), F.col("_dst").alias("dst")).distinct())
        release(before)
    known = everyone.select("node", F.col("node").alias("component"))
    if merged:
        found = merged[-1]
        for roots in reversed(merged[:-1]):
            after = found.select(F.col("node").alias("component"), F.col("component").alias("_c"))
            old, found = (roots, found), checkpointed(roots.join(after, "component", "left").select("node", F.coalesce("_c", "component").alias("component")))
            release(*old)
        known = everyone.join(found.withColumnRenamed("component", "_c"), "node", "left").select("node", F.coalesce("_c", "node").alias("component"))
    return checkpointed(known)


def _rooted(step: DataFrame) -> DataFrame:
    """``(node, component)`` with ``component``, at first the next node, carried to the end of the way, which points to itself; pointers double."""
    at, moved = counted(step, F.col("component") != F.col("node"))
    while moved:
        ahead = at.select(F.col("node").alias("component"), F.col("component").alias("c2"))
        old, (at, moved) = at, counted(at.join(ahead, "component").select("node", F.col("c2").alias("component"), (F.col("c2") != F.col("component")).alias("_moved")), F.col("_moved"))
        release(old)
        at = _kept(at, "_moved")
    return at


def _kept(table: DataFrame, *dropped: str) -> DataFrame:
    """The table without columns, still known as one that ``release`` may delete."""
    out = table.drop(*dropped)
    out._table = table._table
    return out


def scc(edges: DataFrame, nodes: DataFrame | None = None, small: int | None = None) -> DataFrame:
    """G1: ``(node, component)``, the least node of each strongly connected component.

    Until no edge is left: where few nodes have several edges out, trees that hang on the rest and rings that nothing leaves are
    taken off by pointers that double (``_untied``), all of the graph if there are none; nodes that nothing enters, or that enter
    nothing, are trimmed as long as that takes a tenth of the edges; ways through nodes of one edge in and one out become one
    edge each, by such pointers too; then every node is a pivot with a hashed rank, and the best rank that reaches a node spreads
    forward, the best that it reaches spreads back, at once. Where both are one pivot's, the node is in its component; edges between nodes of different ranks join no component and go. So rows a round are those of
    the edges, and a long way costs the logarithm of its length. When ``small`` rows are left (SMALL, 0: never), one task ends
    it. Null ends are ignored; nothing gives no rows.
    """
    return _scc(*_table(edges, nodes), SMALL if small is None else small)


def _scc(edges: DataFrame, nodes: DataFrame | None, size: int, small: int) -> DataFrame:
    """``scc`` of what ``_table`` gives."""
    if size <= small:
        return checkpointed(in_task.in_one_task(edges, nodes, in_task.scc, "node NODE, component NODE"))
    everyone = checkpointed(_all_nodes(edges, nodes))
    live, left = counted(edges.where("src <> dst"))
    labelled, ways, turn = [], [], 0
    while left:
        single, several = counted(live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), F.min("dst").alias("to")), F.col("k") > 1)
        if several * FEW_FORKS <= left:
            live, left, rings = _untied(live, single, several)
            labelled.append(rings)
        release(single)
        taken = left
        while left and taken * 10 >= left + taken:
            before = live
            sources, sinks = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
            live, now = counted(live.join(sources, "src", "left_semi").join(sinks, "dst", "left_semi").select("src", "dst"))
            release(before)
            taken, left = left - now, now
        if not left:
            break
        if left <= small:
            labelled.append(checkpointed(in_task.in_one_task(live, None, in_task.scc, "node NODE, component NODE")).select("node", F.col("component").alias("label")))
            break
        live, left, way, rings = _shortened(live)
        ways.append(way)
        labelled.append(rings)
        if not left:
            break
        turn += 1
        ranks = checkpointed(_best_ranks(live, turn))
        labelled.append(checkpointed(ranks.where("f = b").select("node", F.col("f.node").alias("label"))))
        side = lambda end: ranks.where("f <> b").select(F.col("node").alias(end), F.struct("f", "b").alias(f"_{end}"))  # noqa: B023, E731
        before = live
        live, left = counted(live.join(side("src"), "src").join(side("dst"), "dst").where("_src = _dst").select("src", "dst"))
        release(before, ranks)
    known = everyone.select("node", F.col("node").alias("label"))
    if labelled:
        found = labelled[0]
        for more in labelled[1:]:
            found = found.union(more)
        known = checkpointed(everyone.join(found.withColumnRenamed("label", "_l"), "node", "left").select("node", F.coalesce("_l", "node").alias("label")))
    for way in reversed(ways):  # a way is in a component if both its ends are in that one
        ends = [known.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("u", "w")]
        inner = way.join(ends[0], "u").join(ends[1], "w").where("_u = _w").select("node", F.col("_u").alias("_l"))
        known = checkpointed(known.join(inner, "node", "left").select("node", F.coalesce("_l", "label").alias("label")))
    least = known.groupBy("label").agg(F.min("node").alias("component"))
    return checkpointed(known.join(least, "label").select("node", "component"))


def _untied(live: DataFrame, single: DataFrame, several: int) -> tuple[DataFrame, int, DataFrame]:
    """Edges, and their number, between nodes that may be in a component still: forks, which are nodes of several edges out, and nodes
    between them; ``(node, label)``, the nodes of rings that nothing leaves. ``single(node, k, to)`` has the number of edges out of
    each node and the least one's end, ``several`` is the number of forks.

    Pointers along only edges double. What ends at a node without edges, or at a fork but isn't reached from one (``held``), is in
    no ring, nor is a tree that hangs on a ring whose nodes have one edge each. Of the nodes of such pointers that never end, those
    of the ring alone are still pointed at when none falls out any more (``hit``), and ``low`` is the least of as many nodes ahead.
    """
    forked = live.join(single.where("k > 1").select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().withColumn("_held", F.lit(True))
    start = single.where("k = 1")
    start = start.join(forked, "node", "left") if several else start.withColumn("_held", F.lit(None).cast("boolean"))
    at, moved = counted(start.select("node", "to", F.col("node").alias("low"), F.coalesce("_held", F.lit(False)).alias("held"), F.lit(True).alias("hit"), F.lit(False).alias("done")))
    while moved:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"), F.col("done").alias("done2"))
        come = at.where("not done").groupBy(F.col("to").alias("node")).agg(F.bool_or("held").alias("_held"))
        low, hit, done = F.least("low", "low2"), F.col("_held").isNotNull(), F.col("done") | F.coalesce("done2", F.lit(True))  # nulls are left out
        moves = (done != F.col("done")) | (hit != F.col("hit")) | (hit & (low != F.col("low")))
        step = at.join(ahead, "to", "left").join(come, "node", "left").select("node", F.coalesce("to2", "to").alias("to"), low.alias("low"), (F.col("held") | F.coalesce("_held", F.lit(False))).alias("held"), hit.alias("hit"), done.alias("done"), moves.alias("_moved"))
        old, (at, moved) = at, counted(step, F.col("_moved"))
        release(old)
        at = _kept(at, "_moved")
    rings = at.where("hit and not done").select("node", F.col("low").alias("label"))
    if not several:
        return live, 0, rings
    forks = single.where("k > 1").select("node")
    stay = checkpointed(at.where("done and held").join(forks.withColumnRenamed("node", "to"), "to", "left_semi").select("node").union(forks))
    rest, left = counted(live.join(stay.withColumnRenamed("node", "src"), "src", "left_semi").join(stay.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst"))
    release(live, stay)
    return rest, left, rings


def _shortened(live: DataFrame) -> tuple[DataFrame, int, DataFrame, DataFrame]:
    """Edges, and their number, without nodes of one edge in and one out; ``(node, u, w)``: these with the ends of their way;
    ``(node, label)``: those of rings that have no other nodes. Edges from an end to itself are left out."""
    out = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n"), F.min("dst").alias("fwd")).where("n = 1")
    into = live.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("n"), F.min("src").alias("bwd")).where("n = 1")
    inner = checkpointed(out.select("node", "fwd").join(into.select("node", "bwd"), "node"))
    mark = lambda c: inner.select(F.col("node").alias(c), F.lit(False).alias(f"{c}_done"))
    at = checkpointed(inner.join(mark("fwd"), "fwd", "left").join(mark("bwd"), "bwd", "left").select("node", "fwd", "bwd", *(F.coalesce(f"{c}_done", F.lit(True)).alias(f"{c}_done") for c in ("fwd", "bwd")), F.col("node").alias("low")))
    moved = 1
    while moved:
        ahead = at.select(F.col("node").alias("fwd"), F.col("fwd").alias("f2"), F.col("fwd_done").alias("fd2"), F.col("low").alias("l2"))
        behind = at.select(F.col("node").alias("bwd"), F.col("bwd").alias("b2"), F.col("bwd_done").alias("bd2"))
        step = at.join(ahead, "fwd", "left").join(behind, "bwd", "left")
        low = F.when(F.col("fwd_done"), F.col("low")).otherwise(F.least("low", "l2"))
        moves = (F.col("fd2") & ~F.col("fwd_done")) | (F.col("bd2") & ~F.col("bwd_done")) | (low < F.col("low"))
        fwd, bwd = F.when(F.col("fwd_done"), F.col("fwd")).otherwise(F.col("f2")), F.when(F.col("bwd_done"), F.col("bwd")).otherwise(F.col("b2"))
        step = step.select("node", fwd.alias("fwd"), bwd.alias("bwd"), (F.col("fwd_done") | F.coalesce("fd2", F.lit(False))).alias("fwd_done"), (F.col("bwd_done") | F.coalesce("bd2", F.lit(False))).alias("bwd_done"), low.alias("low"), F.coalesce(moves, F.lit(False)).alias("_moved"))
        old, (at, moved) = at, counted(step, F.col("_moved"))
        release(old)
        at = at.drop("_moved")
    way = at.where("fwd_done").select("node", F.col("bwd").alias("u"), F.col("fwd").alias("w"))
    rings = at.where("not fwd_done").select("node", F.col("low").alias("label"))
    kept = live.join(inner.select(F.col("node").alias("src")), "src", "left_anti").join(inner.select(F.col("node").alias("dst")), "dst", "left_anti")
    short, left = counted(kept.select("src", "dst").union(way.where("u <> w").select("u", "w")).distinct())
    return short, left, way, rings


def _best_ranks(edges: DataFrame, turn: int) -> DataFrame:
    """``(node, f, b)``: the best-ranked pivot that reaches each node and the best that it reaches, itself included; ranks are hashes of node and turn."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    own = F.struct(F.xxhash64("node", F.lit(turn)).alias("rank"), "node")
    best, moved = counted(nodes.select("node", own.alias("f"), own.alias("b")))
    while moved:
        into = edges.join(best.select(F.col("node").alias("src"), "f"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("f").alias("_f"))
        out = edges.join(best.select(F.col("node").alias("dst"), "b"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("b").alias("_b"))
        f, b = F.least("f", F.coalesce("_f", "f")), F.least("b", F.coalesce("_b", "b"))
        step = best.join(into, "node", "left").join(out, "node", "left").select("node", f.alias("f"), b.alias("b"), ((f < F.col("f")) | (b < F.col("b"))).alias("_moved"))
        old, (best, moved) = best, counted(step, F.col("_moved"))
        release(old)
        best = best.drop("_moved")
    return best


def cycles(edges: DataFrame, components: DataFrame) -> DataFrame:
    """``(component, node, size)`` of rings: components of several nodes, or one with a self-loop."""
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct().withColumn("self_loop", F.lit(True))
    sized = components.withColumn("size", F.count("*").over(Window.partitionBy("component")))
    return sized.join(loops, "node", "left").where((F.col("size") > 1) | F.col("self_loop")).select("component", "node", "size")


def condense(edges: DataFrame, components: DataFrame) -> DataFrame:
    """The edges between components, distinct, without self edges."""
    a = components.select(F.col("node").alias("src"), F.col("component").alias("c1"))
    b = components.select(F.col("node").alias("dst"), F.col("component").alias("c2"))
    return edges.join(a, "src").join(b, "dst").where("c1 <> c2").select(F.col("c1").alias("src"), F.col("c2").alias("dst")).distinct()


def levels(dag: DataFrame, nodes: DataFrame, max_rounds: int = 10_000, small: int | None = None) -> DataFrame:
    """Lakos levels of an acyclic graph: 0 without outgoing edges, else one more than the highest successor. A cycle raises.

    A large graph is taken down until no edge is left. Nodes that have no edge any more have their level, the highest that
    was passed to them, and pass it on. A node with one edge left has the level ``max(b, a + its successor's)``; such steps
    are closed under composition, so pointers that double carry each to the first node that isn't one, and the edges
    into it lead there. Chains, and trees towards their root, cost the logarithm of their height; in others a round takes the
    lowest level at least. A ring shows as a round that finds neither, or as pointers that never end. Null ends are ignored.
    """
    small = SMALL if small is None else small
    dag, nodes, size = _table(dag, nodes)
    if size <= small:
        return checkpointed(in_task.in_one_task(dag, nodes, in_task.levels, "node NODE, level long"))
    open_ = checkpointed(_all_nodes(dag, nodes).select("node", F.lit(0).cast("long").alias("base")))
    live, left = counted(dag.select("src", "dst", F.lit(1).cast("long").alias("w")))
    known, steps = [], []
    while left:
        if len(known) == max_rounds:
            raise RuntimeError(f"levels still grow after {max_rounds} rounds")
        done, n = counted(open_.join(live.select(F.col("src").alias("node")), "node", "left_anti"))
        known.append(done.select("node", F.col("base").alias("level")))
        into = live.join(done.select(F.col("node").alias("dst"), "base"), "dst").groupBy(F.col("src").alias("node")).agg(F.max(F.col("w") + F.col("base")).alias("_b"))
        higher = lambda nodes, more: nodes.join(more, "node", "left").select("node", F.greatest("base", "_b").alias("base"))
        old = open_, live
        open_ = checkpointed(higher(open_, into).join(done.select("node"), "node", "left_anti"))
        live = checkpointed(live.join(done.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst", "w"))
        release(*old)
        one = live.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("_n"), F.min("dst").alias("to"), F.max("w").alias("a")).where("_n = 1")
        step, singles = counted(one.join(open_.withColumnRenamed("base", "b"), "node").select("node", "to", "a", "b"))
        if not n and not singles:
            raise RuntimeError("the graph has a cycle")
        if singles:
            step = _composed(step, singles)
            steps.append(step)
            reached = live.join(step.select(F.col("node").alias("src")), "src", "left_anti").join(step.select(F.col("node").alias("dst"), "to", "a", "b"), "dst", "left")
            old = open_, live
            reached = checkpointed(reached)
            passed = reached.where("to is not null").groupBy(F.col("src").alias("node")).agg(F.max(F.col("w") + F.col("b")).alias("_b"))
            open_ = checkpointed(higher(open_, passed).join(step.select("node"), "node", "left_anti"))
            release(*old)
            live = reached.groupBy("src", F.coalesce("to", "dst").alias("dst")).agg(F.max(F.col("w") + F.coalesce("a", F.lit(0))).alias("w"))
        live, left = counted(live)
    out = open_.select("node", F.col("base").alias("level"))
    for part in known:
        out = out.union(part)
    for step in reversed(steps):
        above = checkpointed(out)
        out = above.union(step.join(above.select(F.col("node").alias("to"), "level"), "to").select("node", F.greatest("b", F.col("a") + F.col("level")).alias("level")))
    return checkpointed(out)


def _composed(step: DataFrame, n: int) -> DataFrame:
    """``(node, to, a, b)`` carried on until ``to`` is no node of ``step``; raises where it never is."""
    waiting = n
    while waiting:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("a").alias("a2"), F.col("b").alias("b2"))
        joined = step.join(ahead, "to", "left")
        b = F.greatest("b", F.col("a") + F.col("b2"))  # leaves nulls out
        joined = joined.select("node", F.coalesce("to2", "to").alias("to"), (F.col("a") + F.coalesce("a2", F.lit(0))).alias("a"), b.alias("b"), F.col("to2").isNotNull().alias("_open"))
        old, (step, now) = step, counted(joined, F.col("_open"))
        release(old)
        step = step.drop("_open")
        if now == waiting and now:
            raise RuntimeError("the graph has a cycle")
        waiting = now
    return step


def shortest_paths(edges: DataFrame, source, max_rounds: int = 10_000) -> DataFrame:
    """``(node, distance, path)`` from ``source`` by breadth-first search; of equal paths the least. Unreached nodes are absent."""
    kind = edges.schema["src"].dataType
    edges, _, size = _table(edges)
    if size <= SMALL:
        start = edges.sparkSession.range(1).select(F.lit(source).cast(kind).alias("node"))
        return checkpointed(in_task.in_one_task(edges, start, in_task.paths(source), "node NODE, distance long, path array<NODE>"))
    start = F.lit(source).cast(kind)
    seen = front = checkpointed(edges.sparkSession.range(1).select(start.alias("node"), F.lit(0).cast("long").alias("distance"), F.array(start).alias("path")))
    for _ in range(max_rounds):
        step = front.join(edges.withColumnRenamed("src", "node"), "node").select(F.col("dst").alias("node"), (F.col("distance") + 1).alias("distance"), F.concat("path", F.array("dst")).alias("path"))
        front, n = counted(step.groupBy("node").agg(F.min("distance").alias("distance"), F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"))
        if not n:
            return seen
        seen = seen.union(front)
    raise RuntimeError("search did not end")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes reached from ``roots(node)``, roots included; the front of each round alone meets the edges."""
    edges = checkpointed(edges.select("src", "dst").distinct())
    seen = front = checkpointed(roots.select("node").distinct())
    while True:
        step = edges.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct()
        front, n = counted(step.join(seen, "node", "left_anti"))
        if not n:
            return seen
        seen = seen.union(front)


def degrees(edges: DataFrame) -> DataFrame:
    """Ends of edges at each node; a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def martin(edges: DataFrame, nodes: DataFrame, types: DataFrame | None = None) -> DataFrame:
    """Per node Ca, Ce (distinct others), instability (0 if isolated), abstractness (null without types), distance (null then)."""
    links = edges.where("src <> dst").select("src", "dst").distinct()
    ca = links.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("ca"))
    ce = links.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("ce"))
    out = nodes.select("node").join(ca, "node", "left").join(ce, "node", "left").select("node", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))
    out = out.withColumn("instability", F.coalesce(F.try_divide(F.col("ce"), F.col("ca") + F.col("ce")), F.lit(0.0)))
    if types is None:
        return out
    out = out.join(types.select("node", "n_abstract", "n_types"), "node", "left")
    a = F.try_divide(F.col("n_abstract"), F.col("n_types"))
    return out.withColumn("abstractness", a).withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1)).drop("n_abstract", "n_types")


def reach_counts(edges: DataFrame, nodes: DataFrame, small: int | None = None) -> DataFrame:
    """``(node, component, fan_out, fan_in)``, how many nodes each reaches and is reached by, itself included.

    From the condensation: a small one's closure is taken in one task. Of a larger one, trees that hang on the rest are taken off
    by pointers that double, the logarithm of their height (``_fans``); in what is left the components are numbered by level, and
    what each reaches is passed up from its successors, level by level, as words of 64 components, of which a row holds one that
    isn't empty. No pair of nodes is ever a row. There a round is a level: deep graphs that are no trees have many. Null ends are
    ignored.
    """
    edges, nodes, size = _table(edges, nodes)
    comp = _scc(edges, nodes, size, SMALL if small is None else small)
    size = comp.groupBy("component").agg(F.count("*").alias("n"))
    dag, left = counted(condense(edges, comp))
    if left > (SMALL_CLOSURE if small is None else small):
        weights = checkpointed(size.select(F.col("component").alias("node"), F.col("n").alias("n_out"), F.col("n").alias("n_in")))
        return comp.join(_fans(dag, left, weights, small).withColumnRenamed("node", "component"), "component").select("node", "component", "fan_out", "fan_in")
    pairs = closure(dag)
    pairs = pairs.union(size.select("component", F.col("component").alias("dst")))
    out = pairs.join(size.select(F.col("component").alias("dst"), "n"), "dst").groupBy(F.col("src").alias("component")).agg(F.sum("n").alias("fan_out"))
    into = pairs.join(size.select(F.col("component").alias("src"), "n"), "src").groupBy(F.col("dst").alias("component")).agg(F.sum("n").alias("fan_in"))
    return comp.join(out, "component").join(into, "component").select("node", "component", "fan_out", "fan_in")


def _fans(dag: DataFrame, left: int, size: DataFrame, small: int | None, idle: int = 0) -> DataFrame:
    """``(node, fan_out, fan_in)`` of an acyclic graph of ``left`` edges, whose nodes ``size(node, n_out, n_in)`` count for those that
    reach them, and that they reach. Trees are taken off towards their roots, then those away from them, by turns, until two turns
    running take less than a tenth of the edges."""
    if not left:
        return size.select("node", F.col("n_out").alias("fan_out"), F.col("n_in").alias("fan_in"))
    if idle == 2:
        return _fans_by_words(dag, size, small)
    trees, dag, now, size = _without_trees(dag, size)
    if size is None:
        return trees.select("node", F.col("path").alias("fan_out"), F.col("below").alias("fan_in"))
    turned = dag.select(F.col("dst").alias("src"), F.col("src").alias("dst")), size.select("node", F.col("n_in").alias("n_out"), F.col("n_out").alias("n_in"))
    rest = _fans(turned[0], now, turned[1], small, 0 if (left - now) * 10 >= left else idle + 1)
    rest = checkpointed(rest.select("node", F.col("fan_in").alias("fan_out"), F.col("fan_out").alias("fan_in")))
    ended = trees.where("not forked").select("node", F.col("path").alias("fan_out"), F.col("below").alias("fan_in"))
    forked = trees.where("forked").join(rest.select(F.col("node").alias("to"), "fan_out"), "to").select("node", (F.col("path") + F.col("fan_out")).alias("fan_out"), F.col("below").alias("fan_in"))
    return checkpointed(ended.union(forked).union(rest))


def _without_trees(dag: DataFrame, size: DataFrame) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    """Nodes that neither have several successors nor are reached by one that has: ``(node, to, path, below, forked)``; what is left
    of the graph, its number of edges, and its nodes (None if there are none).

    Each such node reaches what its only successor does, and those that reach it are the tree above it. Pointers along only
    successors double until they end at a node of none, or of several (``forked``); ``path`` is the sum of ``n_out`` up to there, the last
    one's included unless it is forked, and ``below`` that of ``n_in`` over the nodes that point here within as many steps. What a tree
    brings is added to ``n_in`` of the node that it hangs on.
    """
    single = dag.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"), F.min("dst").alias("next"))
    forks, several = counted(single.where("k > 1").select("node"))
    marked = dag.join(forks.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node")).union(forks).distinct().withColumn("_held", F.lit(True))
    one, many = F.coalesce(F.col("k") == 1, F.lit(False)), F.coalesce(F.col("k") > 1, F.lit(False))
    start = size.join(single, "node", "left").join(marked, "node", "left").select(
        "node", F.when(one, F.col("next")).otherwise(F.col("node")).alias("to"), F.when(many, F.lit(0)).otherwise(F.col("n_out")).alias("path"), F.col("n_in").alias("below"), F.coalesce("_held", F.lit(False)).alias("held"), many.alias("forked"), one.alias("open")
    )
    at, left = counted(start, F.col("open"))
    while left:
        ahead = at.select(F.col("node").alias("to"), F.col("to").alias("to2"), F.col("path").alias("path2"), F.col("forked").alias("forked2"), F.col("open").alias("open2"))
        on = at.where("open").join(ahead, "to").select("node", F.col("to2").alias("to"), (F.col("path") + F.col("path2")).alias("path"), "below", "held", F.col("forked2").alias("forked"), F.col("open2").alias("open"))
        come = at.where("open").groupBy(F.col("to").alias("node")).agg(F.sum("below").alias("_b"), F.bool_or("held").alias("_h"))
        step = on.union(at.where("not open")).join(come, "node", "left").select("node", "to", "path", (F.col("below") + F.coalesce("_b", F.lit(0))).alias("below"), (F.col("held") | F.coalesce("_h", F.lit(False))).alias("held"), "forked", "open")
        old, (at, left) = at, counted(step, F.col("open"))
        release(old)
    if not several:
        release(forks)
        return at, dag, 0, None
    trees = at.where("not held")
    core = at.where("held").select("node")
    rest, now = counted(dag.join(core.withColumnRenamed("node", "src"), "src", "left_semi").select("src", "dst"))
    hung = dag.join(trees.select(F.col("node").alias("src"), "below"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("below").alias("_b"))
    kept = checkpointed(size.join(core, "node", "left_semi").join(hung, "node", "left").select("node", "n_out", (F.col("n_in") + F.coalesce("_b", F.lit(0))).alias("n_in")))
    release(forks)
    return trees, rest, now, kept


def _numbered(nodes: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """``nodes`` with ``idx`` from 0 on in their order; one number a partition reaches the driver."""
    dealt = checkpointed(nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    before, rows = 0, []
    for row in sorted(dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()):
        rows.append((row["_part"], before))
        before += row["n"]
    base = nodes.sparkSession.createDataFrame(rows, "_part long, _before long")
    idx = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)
    return checkpointed(dealt.withColumn("_part", part).join(F.broadcast(base), "_part").select(*nodes.columns, idx.alias("idx")))


def _fans_by_words(dag: DataFrame, size: DataFrame, small: int | None) -> DataFrame:
    """``_fans``, level by level."""
    placed = _numbered(size.join(levels(dag, size.select("node"), small=small), "node").select("level", "node", "n_out", "n_in"), ("level", "node"))
    end = lambda c, i, lv: placed.select(F.col("node").alias(c), F.col("idx").alias(i), F.col("level").alias(lv))
    e = checkpointed(dag.join(end("src", "s", "ls"), "src").join(end("dst", "d", "ld"), "dst").select("s", "ls", "d", "ld"))
    lowest = {r.ls: r.ld for r in e.groupBy("ls").agg(F.min("ld").alias("ld")).collect()}  # a row for each level
    own = placed.select("level", F.col("idx").alias("s"), F.shiftright("idx", 6).alias("block"), F.expr("shiftleft(1L, cast(idx & 63 AS int))").alias("word"))
    words = [checkpointed(own.where("level = 0").drop("level"))]
    for lv in range(1, max(lowest) + 1):
        below = words[lowest[lv]]
        for more in words[lowest[lv] + 1 : lv]:
            below = below.union(more)
        passed = e.where(F.col("ls") == lv).select("s", "d").join(below.withColumnRenamed("s", "d"), "d").select("s", "block", "word")
        words.append(checkpointed(own.where(F.col("level") == lv).drop("level").unionByName(passed).groupBy("s", "block").agg(F.bit_or("word").alias("word"))))
    every = words[0]
    for more in words[1:]:
        every = every.union(more)
    # a component counts once in its word's bits; what it has beyond one node is added from those that have
    large = placed.where("n_out > 1").groupBy(F.shiftright("idx", 6).alias("block")).agg(F.collect_list(F.struct(F.expr("shiftleft(1L, cast(idx & 63 AS int))").alias("bit"), (F.col("n_out") - 1).alias("more"))).alias("large"))
    more = F.aggregate("large", F.lit(0).cast("long"), lambda sum_, x: sum_ + F.when(F.col("word").bitwiseAND(x["bit"]) != 0, x["more"]).otherwise(F.lit(0)))
    beyond = every.join(large, "block").groupBy("s").agg(F.sum(more).alias("more"))
    out = every.groupBy("s").agg(F.sum(F.bit_count("word")).alias("k")).join(beyond, "s", "left").select(F.col("s").alias("idx"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("fan_out"))
    weighed = every.join(placed.select(F.col("idx").alias("s"), "n_in"), "s")
    bits = [F.sum(F.when(F.col("word").bitwiseAND(F.lit(1 << i if i < 63 else -(1 << 63))) != 0, F.col("n_in"))).alias(f"_{i}") for i in range(64)]
    columns = weighed.groupBy("block").agg(*bits).select("block", F.posexplode(F.array(*(f"_{i}" for i in range(64)))).alias("i", "fan_in"))
    into = columns.where("fan_in is not null").select((F.col("block") * 64 + F.col("i")).alias("idx"), "fan_in")
    return placed.select("node", "idx").join(out, "idx").join(into, "idx").select("node", "fan_out", "fan_in")


def propagation(reach: DataFrame) -> DataFrame:
    """N, CCD, ACD, NCCD (null below two nodes), propagation cost."""
    n, ccd = F.count("*"), F.sum("fan_out")
    full = (n + 1) * F.log2(n + 1) - n
    return reach.agg(n.alias("n"), ccd.alias("ccd"), F.try_divide(ccd, n).alias("acd"), F.when(n > 1, F.try_divide(ccd, full)).alias("nccd"), F.try_divide(ccd, n * n).alias("propagation_cost"))


def visibility_roles(reach: DataFrame) -> DataFrame:
    """Core, shared, control or peripheral, from ten nodes on (else null).

    Thresholds are the fan-in and fan-out of the largest ring (ties: least component), or the medians if there is none.
    """
    ring = reach.groupBy("component").agg(F.count("*").alias("size"), F.max("fan_in").alias("ti"), F.max("fan_out").alias("to")).where("size > 1").agg(F.min_by(F.struct("ti", "to"), F.struct(-F.col("size"), F.col("component"))).alias("t"))
    mid = reach.agg(F.count("*").alias("n"), F.median("fan_in").alias("mi"), F.median("fan_out").alias("mo"))
    bounds = mid.crossJoin(ring).select("n", F.coalesce("t.ti", "mi").alias("ti"), F.coalesce("t.to", "mo").alias("to"))
    hi_in, hi_out = F.col("fan_in") >= F.col("ti"), F.col("fan_out") >= F.col("to")
    role = F.when(F.col("n") < 10, None).when(hi_in & hi_out, "core").when(hi_in, "shared").when(hi_out, "control").otherwise("peripheral")
    return reach.crossJoin(F.broadcast(bounds)).select("node", "fan_in", "fan_out", role.alias("role"))


def modularity(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """A28 as the reference has it: over directed edges inside one part, ``sum(1 - ku * kv / 2m) / 2m``; 0 without edges."""
    deg = degrees(edges)
    side = lambda c, d, p: deg.join(partition, "node").select(F.col("node").alias(c), F.col("degree").alias(d), F.col("part").alias(p))
    inside = edges.join(side("src", "ku", "p1"), "src").join(side("dst", "kv", "p2"), "dst").where("p1 = p2")
    m2 = edges.agg((2 * F.count("*")).alias("m2"))
    return inside.crossJoin(F.broadcast(m2)).agg(F.coalesce(F.try_divide(F.sum(1 - F.col("ku") * F.col("kv") / F.col("m2")), F.max("m2")), F.lit(0.0)).alias("modularity"))


def smells(edges: DataFrame, nodes: DataFrame, sizes: DataFrame, hub_degree: int = 5, hub_balance: float = 0.5, unstable: float = 0.30, god: int = 5000) -> DataFrame:
    """``(kind, component, severity)``: cyclic, hub_like, unstable_dependency, god_component."""
    from .distribution import god_cutoff

    comp = checkpointed(scc(edges, nodes))
    rings = cycles(edges, comp).select("component", "size").distinct()
    cyclic = rings.select(F.lit("cyclic").alias("kind"), "component", F.col("size").cast("double").alias("severity"))
    m = checkpointed(martin(edges, nodes))
    total = m.withColumn("total", F.col("ca") + F.col("ce"))
    cut = ranked_pick(total, "total", 0.9, name="cut")
    hub = total.crossJoin(F.broadcast(cut)).where((F.col("total") > F.col("cut")) & (F.least("ca", "ce") >= hub_degree) & (F.least("ca", "ce") >= hub_balance * F.greatest("ca", "ce")))
    hub = hub.select(F.lit("hub_like").alias("kind"), F.col("node").alias("component"), F.col("total").cast("double").alias("severity"))
    links = edges.where("src <> dst").select("src", "dst").distinct()
    i1, i2 = m.select(F.col("node").alias("src"), F.col("instability").alias("i1")), m.select(F.col("node").alias("dst"), F.col("instability").alias("i2"))
    bad = links.join(i1, "src").join(i2, "dst").groupBy("src").agg(F.avg(F.when(F.col("i2") > F.col("i1"), 1.0).otherwise(0.0)).alias("share")).where(F.col("share") >= unstable)
    bad = bad.select(F.lit("unstable_dependency").alias("kind"), F.col("src").alias("component"), F.col("share").alias("severity"))
    big = sizes.crossJoin(F.broadcast(god_cutoff(sizes, "size", god))).where("size > cutoff").select(F.lit("god_component").alias("kind"), F.col("node").alias("component"), F.col("size").cast("double").alias("severity"))
    return cyclic.unionByName(hub).unionByName(bad).unionByName(big).orderBy("kind", F.desc("severity"), "component")


def component_edges(imports: DataFrame, component: Column, component_of_dst: Column) -> DataFrame:
    """Weights of edges between components, given as columns over ``imports(src, dst)``."""
    return imports.select(component.alias("src"), component_of_dst.alias("dst")).where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
