"""Classes and calls: cohesion, coupling, inheritance, call graph, shredding.

Null members and bases join nothing; a class without rows in a table has zeros or nulls as each function says; empty tables give no rows; ties go to the least name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import checkpointed
from .graph import levels, reachable, scc


#: Methods that set a class up; a method of the class's own name is one too.
CONSTRUCTORS = ("__init__", "__new__", "constructor")


def cohesion(members: DataFrame, methods: DataFrame | None = None, calls: DataFrame | None = None, fields: DataFrame | None = None, constructors: Sequence[str] = CONSTRUCTORS) -> DataFrame:
    """Cohesion of classes: one row for each class with a method.

    ``members(cls, method, field)`` are the fields that methods touch (null: none), ``methods(cls, method)`` adds methods,
    ``calls(cls, method, callee)`` calls between methods of a class, ``fields(cls, field)`` declared fields, touched or not.
    ``lcom1`` pairs of methods without a shared field, ``lcom2`` those less the sharing pairs (not below 0); ``lcom3``
    components of methods by shared fields, ``lcom4`` by calls too, both without constructors unless a class has no other
    method; ``lcom_star`` (mean methods per field - m) / (1 - m), null if m <= 1 or there are no fields, above 1 with unused
    ones; ``connectivity`` 2 * (E - (n - 1)) / ((n - 1) * (n - 2)) over pairs that share a field or call each other, null below
    three methods.

    Pairs are counted between groups of methods that touch the same fields, and components are those of the graph of methods
    and fields, so a field that all methods touch makes no pairs of them. Calls of oneself or of what isn't a method of the
    class don't count; repeated rows count once; no rows give no rows.
    """
    touch = checkpointed(members.where("field is not null").select("cls", "method", "field").distinct())
    every = members.select("cls", "method")
    every = checkpointed((every if methods is None else every.union(methods.select("cls", "method"))).where("method is not null").distinct())
    owned = touch.select("cls", "field") if fields is None else touch.select("cls", "field").union(fields.select("cls", "field")).distinct()
    alike = touch.groupBy("cls", "method").agg(F.sort_array(F.collect_list("field")).alias("fs")).groupBy("cls", "fs").agg(F.min("method").alias("rep"), F.collect_list("method").alias("ms"))
    alike = checkpointed(alike)
    by_field = alike.select("cls", "rep", F.size("ms").cast("long").alias("n"), F.explode("fs").alias("field"))
    meets = by_field.select("cls", "field", F.col("rep").alias("r1"), F.col("n").alias("n1")).join(by_field.select("cls", "field", F.col("rep").alias("r2"), F.col("n").alias("n2")), ["cls", "field"]).where("r1 < r2")
    meets = checkpointed(meets.select("cls", "r1", "r2", (F.col("n1") * F.col("n2")).alias("pairs")).distinct())
    within = alike.select("cls", (F.size("ms").cast("long") * (F.size("ms") - 1) / 2).cast("long").alias("pairs"))
    sharing = within.union(meets.select("cls", "pairs")).groupBy("cls").agg(F.sum("pairs").alias("sharing"))
    counts = every.groupBy("cls").agg(F.count("*").alias("methods")).join(sharing, "cls", "left")
    counts = counts.join(owned.where("field is not null").groupBy("cls").agg(F.countDistinct("field").alias("fields")), "cls", "left").join(touch.groupBy("cls").agg(F.count("*").alias("touches")), "cls", "left")
    if calls is None:
        linked = every.select("cls", F.col("method").alias("m1"), F.col("method").alias("m2")).limit(0)
    else:
        known = calls.where("method <> callee").select("cls", "method", "callee").join(every, ["cls", "method"], "left_semi").join(every.select("cls", F.col("method").alias("callee")), ["cls", "callee"], "left_semi")
        linked = known.select("cls", F.least("method", "callee").alias("m1"), F.greatest("method", "callee").alias("m2")).distinct()
    linked = checkpointed(linked)
    group = alike.select("cls", "rep", F.explode("ms").alias("m"))
    placed = linked.join(group.select("cls", F.col("m").alias("m1"), F.col("rep").alias("g1")), ["cls", "m1"], "left").join(group.select("cls", F.col("m").alias("m2"), F.col("rep").alias("g2")), ["cls", "m2"], "left")
    apart = placed.where(~F.coalesce(F.col("g1") == F.col("g2"), F.lit(False))).join(meets.select("cls", "r1", "r2"), (placed.cls == meets.cls) & (F.least("g1", "g2") == F.col("r1")) & (F.greatest("g1", "g2") == F.col("r2")) & F.col("g1").isNotNull() & F.col("g2").isNotNull(), "left_anti")
    counts = counts.join(apart.groupBy("cls").agg(F.count("*").alias("called")), "cls", "left").join(_components(every, touch, linked, constructors), "cls")
    n, share, c = F.col("methods"), F.coalesce("sharing", F.lit(0)), F.coalesce("called", F.lit(0))
    lacking = n * (n - 1) / 2 - share
    star = F.try_divide(F.try_divide(F.coalesce("touches", F.lit(0)), F.col("fields")) - n, 1 - n)
    return counts.select(
        "cls", "methods", F.coalesce("fields", F.lit(0)).alias("fields"), lacking.cast("long").alias("lcom1"), F.greatest(F.lit(0), lacking - share).cast("long").alias("lcom2"), "lcom3", "lcom4",
        F.when((n > 1) & (F.col("fields") > 0), star).alias("lcom_star"), F.when(n >= 3, 2 * (share + c - (n - 1)) / ((n - 1) * (n - 2))).alias("connectivity"),
    )


def _components(every: DataFrame, touch: DataFrame, linked: DataFrame, constructors: Sequence[str]) -> DataFrame:
    """(cls, lcom3, lcom4): parts of the graph of a class's methods and fields, for 4 with its calls.

    Rows come by class, and one class at a time is held, as disjoint sets: memory is that of the largest class's members.
    """
    setup = F.col("method").cast("string").isin(*constructors) | (F.col("method").cast("string") == F.col("cls").cast("string"))
    only = every.groupBy("cls").agg(F.bool_and(setup).alias("only"))
    taking = checkpointed(every.join(only, "cls").where(~setup | F.col("only")).select("cls", "method"))
    text = lambda c: F.col(c).cast("string")
    rows = taking.select("cls", text("method").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0).alias("kind"))
    rows = rows.union(touch.join(taking, ["cls", "method"], "left_semi").select("cls", text("method"), text("field"), F.lit(1)))
    calls = linked.join(taking.withColumnRenamed("method", "m1"), ["cls", "m1"], "left_semi").join(taking.withColumnRenamed("method", "m2"), ["cls", "m2"], "left_semi")
    rows = rows.union(calls.select("cls", text("m1"), text("m2"), F.lit(2)))
    schema = T.StructType([every.schema["cls"], *T._parse_datatype_string("lcom3 long, lcom4 long").fields])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, up, names, out = to_arrow_schema(schema), {}, set(), []

        def find(x: tuple) -> tuple:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        def count() -> int:
            return len({find((0, n)) for n in names})

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        at, three = None, None
        for batch in batches:
            for cls, a, b, kind in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != (cls,):
                    if at:
                        out.append((*at, count() if three is None else three, count()))
                    at, three = (cls,), None
                    up.clear(), names.clear()
                if kind == 2 and three is None:
                    three = count()
                if kind == 0:
                    names.add(a)
                elif find((0, a)) != find((2 - kind, b)):
                    up[find((0, a))] = find((2 - kind, b))
            if len(out) > 10_000:
                yield told()
                out = []
        if at:
            out.append((*at, count() if three is None else three, count()))
        if out:
            yield told()

    return rows.repartition("cls").sortWithinPartitions("cls", "kind").mapInArrow(parts, schema)


def settle_fields(declared: DataFrame, accesses: DataFrame) -> DataFrame:
    """``accesses(cls, method, member, access)``: fields are what is declared or written; a read of anything else is unresolved."""
    fields = declared.select("cls", F.col("field").alias("member")).union(accesses.where("access = 'write'").select("cls", "member")).distinct().withColumn("is_field", F.lit(True))
    return accesses.join(fields, ["cls", "member"], "left").withColumn("state", F.when(F.col("access") == "call", "call").when(F.col("is_field"), "field").otherwise("unresolved")).drop("is_field")


def size_of_classes(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """NOM and WMC; a class without methods has a row of zeros."""
    m = methods.groupBy("cls").agg(F.count("*").alias("nom"), F.sum("cyclomatic").alias("wmc"))
    return classes.join(m, "cls", "left").select("cls", F.coalesce("nom", F.lit(0)).alias("nom"), F.coalesce("wmc", F.lit(0)).alias("wmc"))


def owner_of(receiver: Column, container: Column, fragment: Column) -> Column:
    """Receiver type, else container, else the fragment's owner."""
    return F.coalesce(receiver, container, fragment)


def merge_split_types(parts: DataFrame) -> DataFrame:
    """Types split over files, folded into the home file: (directory, language, name, home, files). Home declares it; of several the least path."""
    return parts.groupBy("directory", "language", "name").agg(F.min_by("path", F.struct(~F.col("declares"), F.col("path"))).alias("home"), F.countDistinct("path").alias("files"))


def fed_classes(methods: DataFrame) -> DataFrame:
    """Types of sibling files that a file declares methods for."""
    return methods.where("owner_path <> path").select("path", "owner", "owner_path").distinct()


def inheritance_depth(bases: DataFrame, classes: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """``bases(cls, base)`` to (cls, dit, external). A base that isn't a known class counts 1 and flags it and all below;
    bases inside a ring don't count. Depths are levels towards the bases; one of over ``max_rounds`` raises. A null class or base is none."""
    ring = scc(bases.select(F.col("cls").alias("src"), F.col("base").alias("dst")))
    ends = [ring.select(F.col("node").alias(c), F.col("component").alias(k)) for c, k in (("cls", "_a"), ("base", "_b"))]
    up = checkpointed(bases.join(ends[0], "cls").join(ends[1], "base").where("_a <> _b").select(F.col("cls").alias("src"), F.col("base").alias("dst")).distinct())
    nodes = classes.select(F.col("cls").alias("node"))
    # what an unknown class has for bases doesn't count: it is outside
    own = up.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")
    depth = levels(own, nodes)
    if (depth.agg(F.max("level")).first()[0] or 0) > max_rounds:
        raise RuntimeError(f"a class lies deeper than {max_rounds}")
    outside = reachable(own.select(F.col("dst").alias("src"), F.col("src").alias("dst")), own.select(F.col("dst").alias("node")).join(nodes, "node", "left_anti"))
    flagged = outside.withColumn("_x", F.lit(True))
    return nodes.join(depth, "node").join(flagged, "node", "left").select(F.col("node").alias("cls"), F.col("level").alias("dit"), F.coalesce("_x", F.lit(False)).alias("external"))


def children(bases: DataFrame, classes: DataFrame) -> DataFrame:
    """NOC of A36: direct subclasses."""
    n = bases.select("cls", "base").distinct().groupBy(F.col("base").alias("cls")).agg(F.count("*").alias("noc"))
    return classes.select("cls").join(n, "cls", "left").select("cls", F.coalesce("noc", F.lit(0)).alias("noc"))


def ck_suite(classes: DataFrame, methods: DataFrame, bases: DataFrame, uses: DataFrame, calls: DataFrame) -> DataFrame:
    """WMC, NOM, DIT, NOC, CBO (distinct other classes used, either way), RFC (own methods and distinct callees)."""
    both = uses.where("cls <> used").select("cls", "used").union(uses.where("cls <> used").select("used", "cls")).distinct()
    cbo = both.groupBy("cls").agg(F.count("*").alias("cbo"))
    callees = calls.select("cls", "callee").distinct().groupBy("cls").agg(F.count("*").alias("remote"))
    out = size_of_classes(classes, methods).join(inheritance_depth(bases, classes), "cls").join(children(bases, classes), "cls").join(cbo, "cls", "left").join(callees, "cls", "left")
    return out.select("cls", "wmc", "nom", "dit", "noc", F.coalesce("cbo", F.lit(0)).alias("cbo"), (F.col("nom") + F.coalesce("remote", F.lit(0))).alias("rfc"), F.when(F.col("external"), "APPROX").otherwise("EXACT").alias("exactness"))


def fans(calls: DataFrame) -> DataFrame:
    """Distinct callers and callees of each entity, by their sum."""
    c = calls.select("src", "dst").distinct()
    i = c.groupBy(F.col("dst").alias("entity")).agg(F.count("*").alias("fan_in"))
    o = c.groupBy(F.col("src").alias("entity")).agg(F.count("*").alias("fan_out"))
    both = i.join(o, "entity", "full").select("entity", F.coalesce("fan_in", F.lit(0)).alias("fan_in"), F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    return both.orderBy(F.desc(F.col("fan_in") + F.col("fan_out")), "entity")


def roots(entities: DataFrame) -> DataFrame:
    """Module bodies, ``main``, tests, and all that isn't provably private (null counts as public)."""
    name, path = F.col("name"), F.col("path")
    test = name.startswith("test_") | path.contains("/test")
    return entities.where((F.col("kind") == "module") | (name == "main") | test | ~F.coalesce("private", F.lit(False))).select(F.col("entity").alias("node"))


def dispatch_edges(entities: DataFrame, overrides: DataFrame, members: DataFrame) -> DataFrame:
    """A reached class reaches its dispatched members, by name rule or by an override."""
    by_name = members.join(entities.where("dispatched").select(F.col("entity").alias("member")), "member", "left_semi")
    by_edge = members.join(overrides.select(F.col("src").alias("member")), "member", "left_semi")
    return by_name.union(by_edge).select(F.col("owner").alias("src"), F.col("member").alias("dst")).distinct()


def shredding(functions: DataFrame, calls: DataFrame, trivial: int = 2, many: int = 3) -> DataFrame:
    """``functions(entity, path, name, score, private)`` and ``calls(src, dst)``: roots cut into trivial helpers.

    A helper is private, its name is defined once, it is called from one place, and its score is ``trivial`` at most. Its root is the
    first caller that is no helper (null on a ring). Reported: roots with ``many`` helpers or more whose median score is
    ``trivial`` at most: (root, helpers, total).
    """
    unique = functions.withColumn("_n", F.count("*").over(Window.partitionBy("path", "name")))
    once = calls.select("src", "dst").distinct().groupBy("dst").agg(F.count("*").alias("c"), F.min("src").alias("up")).where("c = 1 and up <> dst")
    helper = checkpointed(unique.where(F.col("private") & (F.col("_n") == 1) & (F.col("score") <= trivial)).join(once.withColumnRenamed("dst", "entity"), "entity").select("entity", "score", "up"))
    names = checkpointed(helper.select("entity", F.col("up").alias("root"), F.lit(1).cast("long").alias("steps")))
    for _ in range(40):
        ahead = names.select(F.col("entity").alias("root"), F.col("root").alias("r2"), F.col("steps").alias("s2"))
        new = checkpointed(names.join(ahead, "root", "left").select("entity", F.coalesce("r2", "root").alias("root"), (F.col("steps") + F.coalesce("s2", F.lit(0))).alias("steps"), F.col("r2").isNotNull().alias("open")))
        names = new.drop("open")
        if new.where("open").limit(1).count() == 0 or new.where("open and steps < 1000000").limit(1).count() == 0:
            break
    ended = names.join(helper.select(F.col("entity").alias("root")), "root", "left_anti").join(helper.select("entity", "score"), "entity")
    group = ended.groupBy("root").agg(F.count("*").alias("helpers"), F.median("score").alias("mid"), F.sum("score").alias("helper_score")).where((F.col("helpers") >= many) & (F.col("mid") <= trivial))
    own = functions.select(F.col("entity").alias("root"), F.col("score").alias("own"))
    return group.join(own, "root").select("root", "helpers", (F.col("own") + F.col("helper_score")).alias("total"))
