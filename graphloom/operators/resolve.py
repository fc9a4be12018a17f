"""Name and position resolution.

A null position, name or symbol joins nothing; repeated rows count once where an answer is a set and are kept where sites are rows; empty tables give no answers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import checkpointed, counted

#: Rows of one key up to which its intervals are swept in one piece, and the pieces of a larger key.
WHOLE, PIECES = 1_000_000, 64


def innermost(points: DataFrame, spans: DataFrame, key: str | Sequence[str], bucket: int | None = None, whole: int | None = None) -> DataFrame:
    """The narrowest span ``[start, end)`` of one ``key`` (a column or several) that holds each point ``at``; ties by start, then
    name. Points outside all spans are absent, repeated points count once, null keys and places join nothing.

    One sorted pass: starts of spans and points come by place; open spans wait in a heap by width, from which ended ones are
    dropped when they come up. So cost is that of sorting, and a task holds the spans that are open at one place. A key of more
    than ``whole`` rows (WHOLE) is cut at quantiles of its places, a span then stands in each piece that it touches; with a
    ``bucket`` width all keys are cut at its multiples instead.
    """
    keys = [key] if isinstance(key, str) else list(key)
    whole = WHOLE if whole is None else whole
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    order = points.columns
    carried = [c for c in order if c not in (*keys, "at")]
    given = points.where(known & F.col("at").isNotNull())
    points = given.distinct()
    spans = spans.where(known & (F.col("start") < F.col("end"))).select(*keys, "start", "end", "name")
    if bucket:
        piece = lambda c: F.floor(F.col(c) / bucket)
    else:
        rows = given.select(*keys, "at").unionByName(spans.select(*keys, F.col("start").alias("at")))
        hot, n = counted(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > whole).drop("_n"))
        piece = lambda c: F.lit(0).cast("long")
        if n:
            cuts = F.percentile_approx("at", [i / PIECES for i in range(1, PIECES)], 1000)
            hot = checkpointed(rows.join(hot, keys, "left_semi").groupBy(*keys).agg(F.array_sort(F.array_distinct(cuts)).alias("_cuts")))
            points, spans = points.join(hot, keys, "left"), spans.join(hot, keys, "left")
            piece = lambda c: F.coalesce(F.size(F.filter("_cuts", lambda x: x <= F.col(c))), F.lit(0)).cast("long")
    points = points.withColumn("_piece", piece("at")).drop("_cuts")
    spans = spans.withColumn("_last", F.col("end") - 1).withColumn("_piece", F.explode(F.sequence(piece("start"), piece("_last"))))
    kinds = {**{c: points.schema[c].dataType for c in carried}, "name": spans.schema["name"].dataType, "start": spans.schema["start"].dataType, "end": spans.schema["end"].dataType}
    empty = lambda names: [F.lit(None).cast(kinds[c]).alias(f"_{c}") for c in names]
    begins = spans.select(*keys, "_piece", F.col("start").alias("at"), F.lit(0).alias("_kind"), *empty(carried), *(F.col(c).alias(f"_{c}") for c in ("name", "start", "end")))
    asked = points.select(*keys, "_piece", "at", F.lit(1).alias("_kind"), *(F.col(c).alias(f"_{c}") for c in carried), *empty(("name", "start", "end")))
    swept = begins.unionByName(asked).repartition(*keys, "_piece").sortWithinPartitions(*keys, "_piece", "at", "_kind")
    out = T.StructType([*(swept.schema[k] for k in keys), swept.schema["at"], *(T.StructField(c, kinds[c]) for c in (*carried, "name", "start"))])
    arrow = to_arrow_schema(out)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, open_ = None, []
        for batch in batches:
            groups = zip(*(batch.column(k).to_pylist() for k in (*keys, "_piece")), strict=True)
            rows, names, starts = [], [], []
            for i, (here, at, kind, name, start, end) in enumerate(zip(groups, *(batch.column(c).to_pylist() for c in ("at", "_kind", "_name", "_start", "_end")), strict=True)):
                if here != group:
                    group, open_ = here, []
                if kind == 0:
                    heapq.heappush(open_, (end - start, start, name, end))
                    continue
                while open_ and open_[0][3] <= at:
                    heapq.heappop(open_)
                if open_:
                    rows.append(i)
                    names.append(open_[0][2])
                    starts.append(open_[0][1])
            if rows:
                found = batch.take(pa.array(rows))
                columns = [found.column(c) for c in (*keys, "at", *(f"_{c}" for c in carried))] + [pa.array(names, arrow.field("name").type), pa.array(starts, arrow.field("start").type)]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return swept.mapInArrow(sweep, out).select(*order, "name", "start")


def scope_lookup(sites: DataFrame, scopes: DataFrame, bindings: DataFrame) -> DataFrame:
    """The scope that binds each site's name, looking outward: (site, scope).

    ``sites(site, path, at, name)``, ``scopes(scope, path, kind, start, end)``, ``bindings(scope, name)``. The innermost scope at the
    site is asked first, of whatever kind, then those around it, but for classes, whose names their functions don't see. A
    class is only asked where it is innermost; so the answer is that class, or else the narrowest scope of another kind that
    holds the site and binds the name: two sweeps by place, whatever the depth. Names that no scope binds are absent.
    """
    bound = bindings.select("scope", "name").distinct()
    spans = scopes.select("scope", "path", "kind", "start", "end")
    at = sites.select("site", "path", "at", F.col("name").alias("wanted"))
    inner = innermost(at, spans.withColumnRenamed("scope", "name"), "path").select("site", "path", "at", "wanted", F.col("name").alias("scope"))
    own = checkpointed(inner.join(spans.where("kind = 'class'").select("scope"), "scope", "left_semi").join(bound.withColumnRenamed("name", "wanted"), ["scope", "wanted"], "left_semi").select("site", "scope"))
    around = spans.where("kind <> 'class'").join(bound, "scope").select("path", F.col("name").alias("wanted"), "start", "end", F.col("scope").alias("name"))
    rest = at.where("wanted is not null").join(own.select("site"), "site", "left_anti")
    return own.unionByName(innermost(rest, around, ["path", "wanted"]).select("site", F.col("name").alias("scope")))


def accuracy(sites: DataFrame) -> DataFrame:
    """``sites(truth, answer, confidence)``: counts, precision, recall, f1, the same for sure answers, share without a truth."""
    known, said = F.col("truth").isNotNull(), F.col("answer").isNotNull()
    right, sure = known & said & (F.col("truth") == F.col("answer")), F.col("confidence") >= 1
    c = sites.agg(
        F.count_if(known).alias("total"), F.count_if(known & said).alias("answered"), F.count_if(right).alias("correct"), F.count_if(known & said & sure).alias("s_answered"), F.count_if(right & sure).alias("s_correct"), F.count("*").alias("n")
    )
    p, r = F.try_divide("correct", "answered"), F.try_divide("correct", "total")
    return c.select(
        "total", "answered", "correct", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"),
        F.round(F.try_divide("s_correct", "s_answered"), 6).alias("confident_precision"), F.round(F.try_divide("s_correct", "total"), 6).alias("confident_recall"), F.round(F.try_divide(F.col("n") - F.col("total"), F.col("n")), 6).alias("excluded"),
    )


def symbol_tail(symbol: Column) -> Column:
    """name of a symbol's last descriptor; back-ticks quote a name."""
    return F.regexp_replace(F.regexp_extract(symbol, r"(`(?:[^`]|``)+`|[^/#.:!()\[\]`\s]+)(?:\([^)]*\))?[/#.:!]?\]?\.?$", 1), "^`|`$", "")


def scoped_symbol(symbol: Column, path: Column) -> Column:
    """a document-local symbol gets its path."""
    return F.when(symbol.startswith("local "), F.concat(symbol, F.lit("@"), path)).otherwise(symbol)


def positional_join(sites: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Each site at ``(path, line, col)`` with the symbol of the occurrence that starts there (null if none)."""
    occ = occurrences.select("path", F.col("start_line").alias("line"), F.col("start_char").alias("col"), scoped_symbol(F.col("symbol"), F.col("path")).alias("symbol"), "roles")
    return sites.join(occ, ["path", "line", "col"], "left")


def definitions(sites: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Entities whose name stands at an occurrence with the definition role (bit 1)."""
    return positional_join(sites, occurrences).where(F.col("roles").bitwiseAND(1) != 0)


def calls(call_sites: DataFrame, occurrences: DataFrame, defined: DataFrame) -> DataFrame:
    """Call sites with callee entity; ``outcome`` is joined, no_target, unmatched or no_caller."""
    hit = positional_join(call_sites, occurrences).join(defined.select("symbol", F.col("entity").alias("callee")), "symbol", "left")
    outcome = F.when(F.col("caller").isNull(), "no_caller").when(F.col("symbol").isNull(), "unmatched").when(F.col("callee").isNull(), "no_target").otherwise("joined")
    return hit.withColumn("outcome", outcome)


def references(occurrences: DataFrame, consumed: DataFrame) -> DataFrame:
    """Occurrences that define nothing, import nothing (bit 2) and that no call has used."""
    rest = occurrences.where(F.col("roles").bitwiseAND(3) == 0)
    used = consumed.select("path", F.col("line").alias("start_line"), F.col("col").alias("start_char")).distinct()
    return rest.join(used, ["path", "start_line", "start_char"], "left_anti")


def relationships(symbols: DataFrame) -> DataFrame:
    """Implementation relations as OVERRIDES (of a method) or EXTENDS."""
    r = symbols.select("symbol", F.explode("relationships").alias("r")).where("r.is_implementation")
    return r.select("symbol", F.col("r.symbol").alias("target"), F.when(F.col("r.symbol").contains("()."), "OVERRIDES").otherwise("EXTENDS").alias("kind"))


def resolve_symbols(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Fill a null ``dst_id`` from the symbol table by ``dst_ref`` (least entity if several)."""
    s = symbols.groupBy(F.col("symbol").alias("dst_ref")).agg(F.min("entity_id").alias("_id"))
    return edges.join(s, "dst_ref", "left").withColumn("dst_id", F.coalesce("dst_id", "_id")).drop("_id")


def confident(edges: DataFrame) -> DataFrame:
    """P10: edges with a target, precise or unambiguous."""
    return edges.where(F.col("dst_id").isNotNull() & ((F.col("resolution") == "L2") | (F.col("confidence") >= 1)))


def reexports(targets: DataFrame, republished: DataFrame, max_hops: int | None = None) -> DataFrame:
    """Files whose declarations count for ``targets(site, file)``: those and what they republish, with the hops. Files that
    republish each other end the walk by themselves; ``max_hops`` may end it earlier."""
    seen = front = checkpointed(targets.select("site", "file", F.lit(0).alias("hops")).distinct())
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        step = front.join(republished.select("file", F.col("target").alias("_t")), "file").select("site", F.col("_t").alias("file"), F.lit(hop).alias("hops")).distinct()
        front, found = counted(step.join(seen.select("site", "file"), ["site", "file"], "left_anti"))
        if not found:
            break
        seen = seen.union(front)
    return seen


def _nearest(asks: DataFrame, placed: DataFrame, local: DataFrame, republished: DataFrame | None) -> DataFrame:
    """Of ``asks(ask, name)`` placed at ``placed(ask, file, at)``, the first file that declares the name, breadth first.

    All asks search at once. A round looks the front's files up; asks that one of them answers leave the front, the others
    go on to what their files republish and haven't met. Files of a round are tried in the order of the files that led to
    them, then of ``at``. Rounds are the hops of the farthest answer, or of the longest way without one.
    """
    order = F.row_number().over(Window.partitionBy("ask").orderBy("by", "at", "file"))
    front, n = counted(placed.groupBy("ask", "file").agg(F.min("at").alias("at")).withColumn("by", F.lit(0)).withColumn("rank", order).select("ask", "file", "rank"))
    seen, found = front.select("ask", "file"), []
    while n:
        hits = front.join(asks, "ask").join(local, ["file", "name"])
        answered = checkpointed(hits.groupBy("ask").agg(F.min_by(F.struct("file", "entity", "n"), "rank").alias("a")).select("ask", "a.file", "a.entity", "a.n"))
        found.append(answered)
        if republished is None:
            break
        going = front.join(answered.select("ask"), "ask", "left_anti")
        step = going.join(republished, "file").groupBy("ask", F.col("target").alias("file")).agg(F.min(F.struct(F.col("rank").alias("by"), "at")).alias("_o")).select("ask", "file", "_o.by", "_o.at")
        front, n = counted(step.join(seen, ["ask", "file"], "left_anti").withColumn("rank", order).select("ask", "file", "rank"))
        seen = seen.union(front.select("ask", "file"))
    return reduce(DataFrame.union, found) if found else asks.limit(0).select("ask", F.lit("").alias("file"), F.lit(0).alias("entity"), F.lit(0).cast("long").alias("n"))


def name_ladder(sites: DataFrame, declarations: DataFrame, imports: DataFrame, external: DataFrame, republished: DataFrame | None = None) -> DataFrame:
    """The answer of the first rung that has one: (site, entity, file, rung, candidates, confidence), a row for each answered site.

    ``sites(site, path, name[, qualifier])``; ``declarations(entity, path, name[, qualified_name, top])``, where ``top`` (default
    true) marks those of the file itself, not members; ``imports(path, name, file[, at])``, where ``name`` is the local name
    that an import binds (null: it binds none) and ``file`` where it was placed (null: nowhere), in the order of ``at``;
    ``external(path, name)``: local names whose import leads out of the tree; ``republished(file, target[, at])``.

    1. A bare name's declarations in the own file. 2. The file that the import of the name, or of its qualifier, was placed
    at: through a qualifier first members called ``qualifier.name`` there, then what the file declares, then breadth first what
    it republishes. 3. The first imported file, by name, that declares it. 4. The whole project, members too. A qualifier that
    no import binds is a receiver, which rungs 2 and 3 say nothing about; rungs 2 to 4 are closed to names and qualifiers that
    are external. Of n candidates on a rung (in one file, but for the members and the project) the least entity is given, with
    confidence 1 / n. Distinct questions are asked, not sites, and candidates are counted by file and name before any join.
    Sites without a name, and those that nothing answers, are absent; repeated sites, declarations and imports count once.
    """
    none = lambda df, name, kind: df if name in df.columns else df.withColumn(name, F.lit(None).cast(kind))
    sites = none(sites, "qualifier", "string").select("site", "path", "name", "qualifier").where("name is not null").distinct()
    d = none(none(declarations, "qualified_name", "string"), "top", "boolean").select("entity", F.col("path").alias("file"), "name", "qualified_name", F.coalesce("top", F.lit(True)).alias("top"))
    d = checkpointed(d.groupBy("entity", "file", "name").agg(F.max("qualified_name").alias("qualified_name"), F.max("top").alias("top")))
    local = checkpointed(d.where("top").groupBy("file", "name").agg(F.count("*").alias("n"), F.min("entity").alias("entity")))
    bound = none(imports, "at", "int").where("name is not null").select("path", F.col("name").alias("governing"), "file", F.coalesce(F.col("at"), F.lit(0)).alias("at"))
    bound = checkpointed(bound.distinct())
    again = None if republished is None else checkpointed(none(republished, "at", "int").select("file", "target", F.coalesce(F.col("at"), F.lit(0)).alias("at")).distinct())
    asks = sites.select("path", "name", "qualifier").distinct().withColumn("governing", F.coalesce("qualifier", "name"))
    asks = checkpointed(asks.withColumn("ask", F.monotonically_increasing_id()))
    answers = []

    def answer(found: DataFrame, rung: int) -> DataFrame:
        answers.append(checkpointed(found.select("ask", "file", "entity", "n", F.lit(rung).alias("rung"))))
        return answers[-1].select("ask")

    bare = asks.where("qualifier is null")
    left = asks.join(answer(bare.join(local.withColumnRenamed("file", "path").withColumn("file", F.col("path")), ["path", "name"]), 1), "ask", "left_anti")
    left = checkpointed(left.join(external.select("path", F.col("name").alias("governing")).distinct(), ["path", "governing"], "left_anti"))
    near = checkpointed(left.where("qualifier is null").unionByName(left.where("qualifier is not null").join(bound.select("path", "governing").distinct(), ["path", "governing"], "left_semi")))
    placed = near.join(bound.where("file is not null"), ["path", "governing"])
    tail = F.concat(F.lit("."), "qualifier", F.lit("."), "name")
    members = placed.where("qualifier is not null").select("ask", "qualifier", "name", "file").distinct().join(d, ["file", "name"]).where(F.endswith("qualified_name", tail))
    done = answer(members.groupBy("ask").agg(F.count_distinct("entity").alias("n"), F.min(F.struct("entity", "file")).alias("_e")).select("ask", "_e.entity", "_e.file", "n"), 2)
    near = near.join(done, "ask", "left_anti")
    done = answer(_nearest(near.select("ask", "name"), placed.join(done, "ask", "left_anti").select("ask", "file", "at"), local, again), 2)
    near = near.join(done, "ask", "left_anti")
    files = near.join(imports.where("file is not null").select("path", "file").distinct(), "path").join(local, ["file", "name"])
    answer(files.groupBy("ask").agg(F.min(F.struct("file", "entity", "n")).alias("_e")).select("ask", "_e.*"), 3)
    for found in answers[1:]:
        left = left.join(found.select("ask"), "ask", "left_anti")
    everywhere = d.groupBy("name").agg(F.count_distinct("entity").alias("n"), F.min(F.struct("entity", "file")).alias("_e")).select("name", "n", "_e.entity", "_e.file")
    answer(left.join(everywhere, "name"), 4)
    every = reduce(DataFrame.unionByName, answers).join(asks, "ask")
    same = (sites.path == every.path) & (sites.name == every.name) & sites.qualifier.eqNullSafe(every.qualifier)
    return sites.join(every.drop("ask", "governing"), same).select(sites.site, "entity", "file", "rung", F.col("n").alias("candidates"), (1 / F.col("n")).alias("confidence"))


def qualifier_members(sites: DataFrame, declarations: DataFrame) -> DataFrame:
    """Declarations whose qualified name ends with ``.qualifier.name``."""
    tail = F.concat(F.lit("."), F.col("qualifier"), F.lit("."), F.col("name"))
    return sites.join(declarations.select("entity", "name", "qualified_name"), "name").where(F.endswith(F.concat(F.lit("."), F.col("qualified_name")), tail)).select("site", "entity")


def alias_targets(locals_: DataFrame, bindings: DataFrame, assigned: DataFrame, imports: DataFrame) -> DataFrame:
    """Document-local call targets by the import that binds them: recovered, rebound, no_binding or no_import."""
    j = locals_.join(bindings, ["path", "symbol"], "left").join(assigned.select("path", "name").distinct().withColumn("_again", F.lit(True)), ["path", "name"], "left").join(imports.select("path", "name", F.col("file").alias("target")), ["path", "name"], "left")
    outcome = F.when(F.col("name").isNull(), "no_binding").when(F.col("_again"), "rebound").when(F.col("target").isNull(), "no_import").otherwise("recovered")
    return j.select("path", "symbol", "name", F.when(outcome == "recovered", F.col("target")).alias("target"), outcome.alias("outcome"))
