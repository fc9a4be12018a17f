"""Reports that join other operators' results: metrics, classes, architecture, health, volume, review.

Each is a DataFrame, or a few by name; nothing is rendered. Limits are those of the report, taken after narrowing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import facts as P
from ..plans import gate
from ..sources import statements as Q
from . import distribution as D
from . import graph as G
from . import imports as I
from .resolve import confident

#: Metrics of paths, not of entities.
FILE_METRICS = ("hotspot", "churn", "commits", "duplicate_lines", "authors")
#: Findings that are told in full.
SHOWN = 5


def metrics_report(key: str, metrics: DataFrame, entities: DataFrame, file_metrics: DataFrame, limit: int = 20, paths: DataFrame | None = None) -> DataFrame:
    """(scope, qualified_name, path, value) of the worst by one metric, of files or of entities as the metric is."""
    if key in FILE_METRICS:
        return Q.worst_files(file_metrics, key, limit, paths).select(F.lit("file").alias("scope"), F.col("path").alias("qualified_name"), "path", "value")
    return Q.worst_entities(metrics, entities, key, limit, paths).select(F.lit("entity").alias("scope"), "qualified_name", "path", "value")


def rank_classes(classes: DataFrame, by: str = "lcom_star", limit: int | None = 20) -> DataFrame:
    """Classes by a measure, the highest first, those without one last; ties by path and name."""
    ties = [c for c in ("path", "cls") if c in classes.columns]
    rows = classes.orderBy(F.desc_nulls_last(by), *ties)
    return rows if limit is None else rows.limit(limit)


def classes_report(cohesion: DataFrame, coupling: DataFrame, by: str = "lcom_star", limit: int | None = 20) -> DataFrame:
    """The ``classes`` report: cohesion and coupling of each class side by side, ranked."""
    return rank_classes(cohesion.join(coupling, "cls"), by, limit)


def shown(findings: DataFrame, order: Sequence[Column], n: int = SHOWN) -> DataFrame:
    """The first findings with their ``position``, and how many ``more`` there are."""
    total = findings.agg(F.greatest(F.count("*") - n, F.lit(0)).alias("more"))
    first = findings.orderBy(*order).limit(n)
    numbered = first.withColumn("position", F.row_number().over(Window.orderBy(*order)))  # of n rows
    return numbered.crossJoin(total)


def recursion(edges: DataFrame, min_size: int = 1) -> DataFrame:
    """Rings of the confident call graph of ``edges(src_id, kind, dst_id, resolution, confidence)``: (component, node, size)."""
    calls = confident(edges.where(F.col("kind") == "calls")).select(F.col("src_id").alias("src"), F.col("dst_id").alias("dst")).distinct()
    return G.cycles(calls, G.scc(calls)).where(F.col("size") >= min_size)


def entity_nodes(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entities with the syntax node of exactly their byte range: ``entities(path, start_byte, end_byte)``, ``nodes(path, start_byte, end_byte, node)``.

    Of several nodes of one range the least is taken; an entity without one has null.
    """
    one = nodes.groupBy("path", "start_byte", "end_byte").agg(F.min("node").alias("node"))
    return entities.join(one, ["path", "start_byte", "end_byte"], "left")


def architecture(imports: DataFrame, targets: DataFrame, own: Column, nodes: DataFrame, types: DataFrame | None = None, granularity: str = "directory") -> dict[str, DataFrame]:
    """The ``arch`` report over ``imports(path, line, specifier, kind, deferred)`` and their ``targets``.

    ``counts`` of imports (in all, inside, outside, unresolved), ``edges`` of components, ``martin``, ``cycles`` of the imports that
    run at load, the least ``cuts`` of small rings with the imports behind them, ``propagation`` and ``levels``.
    """
    from ..runtime import checkpointed
    from .small_graphs import ring_cuts

    run = checkpointed(I.runtime_imports(imports))
    hit = targets.select("path", "line", "specifier").distinct().withColumn("_t", F.lit(True))
    told = run.join(hit, ["path", "line", "specifier"], "left")
    counts = told.agg(F.count("*").alias("total"), F.count("_t").alias("internal"), F.count_if(F.col("_t").isNull() & ~own).alias("external"), F.count_if(F.col("_t").isNull() & own).alias("unresolved"))
    edges = checkpointed(I.dependency_edges(run, targets, granularity))
    hard = checkpointed(edges.where("hard").select("src", "dst"))
    every = edges.select("src", "dst")
    rings = checkpointed(G.cycles(hard, G.scc(hard, nodes)))
    cuts = checkpointed(ring_cuts(hard, rings.select("component", "node")))
    behind = I.imports_behind(cuts.where("src is not null").select("src", "dst"), run, targets, granularity)
    comp = G.scc(every, nodes)
    return {
        "counts": counts,
        "edges": edges,
        "martin": G.martin(every, nodes, types),
        "cycles": rings,
        "cuts": cuts.join(behind, ["src", "dst"], "left"),
        "propagation": G.propagation(G.reach_counts(every, nodes)),
        "levels": G.levels(G.condense(every, comp), comp.select(F.col("component").alias("node")).distinct()),
    }


def health(entities: DataFrame, metrics: DataFrame, settings: P.Settings, coupling: DataFrame | None = None, limit: int = 10) -> dict[str, DataFrame]:
    """The ``health`` report: of each rule with a ceiling of its own, how much code is above it, and which code.

    ``profiles`` (rule, entities, weight, weight_over, offenders, share_over), weighted by each entity's lines; ``offenders``
    (rule, name, path, value, position), the first ``limit`` of each; ``coupling``, the distribution of exact CBO.
    """
    gates = [(rule, metric, P.GUARDS[guard], float(settings.ceilings[rule])) for rule, metric, guard, _ in P.GATES if rule in settings.ceilings and rule not in P.FOLLOWS]
    table = entities.sparkSession.createDataFrame([(r, m, list(k), c) for r, m, k, c in gates], "rule string, metric_key string, kinds array<string>, ceiling double")
    lines = metrics.where("metric_key = 'sloc'").select("id", F.col("value").alias("lines"))
    measured = metrics.select("id", "metric_key", "value").join(table, "metric_key").join(entities.select("id", "path", "name", "kind"), "id").where(F.array_contains("kinds", F.col("kind"))).join(lines, "id", "left")
    w = F.greatest(F.coalesce(F.col("lines"), F.lit(0.0)), F.lit(1.0))
    over = F.col("value") > F.col("ceiling")
    profiles = measured.groupBy("rule", "ceiling").agg(F.count("*").alias("entities"), F.sum(w).alias("weight"), F.sum(F.when(over, w).otherwise(0.0)).alias("weight_over"), F.count_if(over).alias("offenders")).withColumn("share_over", F.try_divide("weight_over", "weight"))
    order = Window.partitionBy("rule").orderBy(F.desc("value"), "path", "name")
    worst = measured.where(over).withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit).select("rule", "name", "path", "value", "position")
    out = {"profiles": profiles, "offenders": worst}
    if coupling is not None:
        out["coupling"] = D.coupling_profile(coupling.withColumn("_all", F.lit(1)), ["_all"]).drop("_all")
    return out


def check_report(findings: DataFrame, baseline: DataFrame, broken: DataFrame | None = None) -> DataFrame:
    """The ``check`` report: findings with key and state against the baseline; unreadable files always fail.

    ``findings(rule, path, entity, line, value, ceiling, blocking)``, ``broken`` as ``plans.facts.unparseable`` gives them.
    """
    rows = findings if broken is None else findings.unionByName(broken)
    keyed = rows.withColumn("key", gate.finding_key(F.col("rule"), F.col("path"), F.col("entity")))
    state = gate.ratchet(keyed.select("key", "rule", "value").distinct(), baseline).select("key", "value", "state")
    return keyed.join(state, ["key", "value"])


def verdict(report: DataFrame) -> DataFrame:
    """The exit code of a check: 2 if a blocking finding is new or regressed, else 0, with the counts."""
    live = F.col("state").isin("new", "regressed")
    return report.agg(F.count_if(live & F.col("blocking")).alias("failing"), F.count_if(live & ~F.col("blocking")).alias("advisory"), F.count_if(~live).alias("forgiven")).withColumn("code", F.when(F.col("failing") > 0, 2).otherwise(0))


def review(report: DataFrame, changed: DataFrame, measurable: DataFrame, touched: DataFrame, base: DataFrame | None) -> dict[str, DataFrame]:
    """The payload of a review of ``changed(path)``: findings of the measurable files among them.

    ``findings`` tell whether the base had them (``introduced``, null without a base), ``comments`` are those on a
    ``touched(path, line)``, ``counts`` and ``files`` say how many there are.
    """
    paths = changed.select("path").distinct()
    scope = paths.join(measurable.select("path").distinct(), "path", "left_semi")
    tagged = gate.introduced(report.join(scope, "path", "left_semi"), base)
    n = paths.agg(F.count("*").alias("changed")).crossJoin(scope.agg(F.count("*").alias("measured"))).withColumn("excluded", F.col("changed") - F.col("measured"))
    return {"findings": tagged, "comments": gate.on_changed_lines(tagged, touched), "counts": gate.review_counts(tagged), "files": n}


def volume(clones: DataFrame, total_tokens: int, complexity: DataFrame, changes: DataFrame | None = None) -> dict[str, DataFrame]:
    """The ``volume`` report: duplication, erosion of ``complexity(entity, path, value)``, hotspots if there is a history."""
    from .history import file_history, hotspots
    from .text import duplicate_lines, duplication

    out = {
        "duplication": duplication(clones, total_tokens),
        "duplicate_lines": duplicate_lines(clones),
        "erosion": D.structural_erosion(complexity.withColumn("_all", F.lit(1)), "entity", "value", ["_all"]).drop("_all"),
    }
    if changes is not None:
        out["hotspots"] = hotspots(file_history(changes), complexity.groupBy("path").agg(F.sum("value").alias("complexity")))
    return out


def emit(payload: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """K8: each part of a payload as JSON lines, ``value`` a row; keys are sorted by name, nulls left out."""
    return {name: df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")) for name, df in payload.items()}
