"""Facts for the rules from a code graph's tables, and the gate over them.

A fact table is a plain projection; which rows it has decides which rules can fire. Files that are advisory have no facts.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.imports import cycle_facts
from .gate import effective_ceilings, layer_of, matches_any, scope_paths
from .rules import Rule, ceiling_rule, contract_rule, evaluate, rules_for_scope

#: Kinds of entities that a ceiling can be for.
GUARDS = {"callable": ("function", "method"), "file_kind": ("module",), "class_kind": ("class", "interface")}
#: Rule, its metric, the guard of its kinds and its default limit; the last follows the first's limit.
GATES = (
    ("cognitive_complexity", "cognitive_complexity", "callable", 12.0),
    ("cyclomatic_complexity", "cyclomatic_complexity", "callable", 10.0),
    ("max_nesting_depth", "max_nesting_depth", "callable", 4.0),
    ("parameter_count", "parameter_count", "callable", 5.0),
    ("function_sloc", "sloc", "callable", 60.0),
    ("file_sloc", "sloc", "file_kind", 500.0),
    ("methods_per_class", "nom", "class_kind", 12.0),
    ("weighted_methods_per_class", "wmc", "class_kind", 25.0),
    ("shredding", "shredding_cluster", "callable", 12.0),
)
FOLLOWS = {"shredding": "cognitive_complexity"}
CONTRACT_KINDS = {"layered": "layered", "forbidden": "forbidden", "independence": "independence", "deep_import": "deep", "acyclic": "acyclic"}


@dataclass(frozen=True)
class ContractOf:
    """A declared contract: ``names`` are the layers it orders, forbids or keeps apart, ``entries`` globs of entry points."""

    name: str
    kind: str
    names: tuple[str, ...] = ()
    source: str | None = None
    entries: tuple[str, ...] = ()
    deferred: bool = False


@dataclass(frozen=True)
class Settings:
    """What a project asks for; a rule without a ceiling is off."""

    ceilings: Mapping[str, float] = field(default_factory=lambda: {rule: limit for rule, _, _, limit in GATES})
    layer_ceilings: Mapping[str, Mapping[str, float]] = field(default_factory=dict)
    layers: Sequence[tuple[str, Sequence[str]]] = ()
    contracts: Sequence[ContractOf] = ()
    advisory: Sequence[str] = ()
    exclude: Sequence[str] = ()
    retry_budget: int = 3


def rows(spark: SparkSession, data: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def governed(files: DataFrame, settings: Settings) -> DataFrame:
    """The files that aren't advisory, with their layer (null: none): (path, layer)."""
    kept = files.select("path").distinct().where(~matches_any(F.col("path"), list(settings.advisory)))
    return kept.select("path", layer_of(F.col("path"), settings.layers).alias("layer"))


def file_facts(files: DataFrame, entities: DataFrame, metrics: DataFrame, settings: Settings, fed: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a rule about files can join.

    ``entities(id, path, kind, name, line)`` and ``metrics(id, metric_key, value, exactness, bound, explanation)`` of the governed
    ``files(path)``; ``fed(id)`` adds classes of other files that these files declare methods for. A measurement
    may block if it is exact, or a lower bound.
    """
    spark = files.sparkSession
    own = governed(files, settings)
    inside = entities.join(own.select("path"), "path", "left_semi")
    if fed is not None:
        inside = inside.unionByName(entities.join(fed.select("id"), "id", "left_semi")).distinct()
    inside = inside.join(metrics.select("id").distinct(), "id", "left_semi")
    known = metrics.join(inside.select("id"), "id", "left_semi")
    everywhere = inside.select("path").distinct().select("path", layer_of(F.col("path"), settings.layers).alias("layer"))
    project = rows(spark, [(r, float(settings.ceilings[FOLLOWS.get(r, r)])) for r, *_ in GATES if r in settings.ceilings and FOLLOWS.get(r, r) in settings.ceilings], "rule string, limit double")
    own_limits = [(layer, r, float(limits[FOLLOWS.get(r, r)])) for layer, limits in settings.layer_ceilings.items() for r, *_ in GATES if FOLLOWS.get(r, r) in limits]
    ceiling = effective_ceilings(project, rows(spark, own_limits, "layer string, rule string, limit double"), everywhere.unionByName(own).distinct())
    out = {
        "entity": inside.select("id", "path", "kind", "name", "line"),
        "metric": known.select("id", "metric_key", "value", "exactness", "bound"),
        "explanation": known.select("id", "metric_key", F.coalesce("explanation", F.array().cast("array<string>")).alias("explanation")),
        "blocking": known.select("exactness", "bound").distinct().withColumn("may", (F.col("exactness") == "EXACT") | (F.col("bound") == "lower")),
        "ceiling": ceiling,
        "layer": own.where("layer is not null").select("path", "layer"),
    }
    return out | {name: rows(spark, [(k,) for k in kinds], "kind string") for name, kinds in GUARDS.items()}


def graph_facts(imports: DataFrame, settings: Settings, rings: DataFrame | None = None, component_of: DataFrame | None = None, hard_rings: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a rule about imports can join, over both ends of every edge of ``imports(src, dst, deferred)``.

    ``rings(component, node)`` of all imports and ``hard_rings`` of those that run at load, by components of
    ``component_of(path, component)`` if that is given; a contract without rings to look at has no facts and can't fire.
    """
    spark = imports.sparkSession
    edges = imports.select("src", "dst").distinct()
    placed = edges.select(F.col("src").alias("path")).union(edges.select("dst")).distinct()
    kinds: dict[str, list] = {k: [] for k in ("in_contract", "allowed_edge", "forbidden_edge", "independent", "package")}
    entries = placed.select(F.lit("").alias("contract"), "path").limit(0)
    cycle = edges.select(F.lit("").alias("contract"), "src", "dst").limit(0)
    for c in settings.contracts:
        if c.kind == "layered":
            kinds["in_contract"] += [(c.name, n) for n in c.names]
            kinds["allowed_edge"] += [(c.name, a, b) for i, a in enumerate(c.names) for b in c.names[i + 1 :]]
        elif c.kind == "forbidden":
            kinds["forbidden_edge"] += [(c.name, c.source, n) for n in c.names]
        elif c.kind == "independence":
            kinds["independent"] += [(c.name, n) for n in c.names]
        elif c.kind == "deep_import":
            kinds["package"] += [(c.name, n) for n in c.names]
            entries = entries.union(placed.where(matches_any(F.col("path"), list(c.entries))).select(F.lit(c.name), "path"))
        elif c.kind == "acyclic":
            found = rings if c.deferred else hard_rings
            if found is not None:
                taken = edges if c.deferred else imports.where("not deferred").select("src", "dst")
                cycle = cycle.union(cycle_facts(c.name, taken, found, component_of))
        else:
            raise ValueError(f"{c.name}: no contract kind {c.kind}")
    schemas = {k: "contract string, a string, b string" if k.endswith("edge") else "contract string, a string" for k in kinds}
    return {
        "imports": edges,
        "layer": placed.select("path", layer_of(F.col("path"), settings.layers).alias("layer")).where("layer is not null"),
        "edge_label": edges.select("src", "dst", F.concat_ws(" -> ", "src", "dst").alias("label")),
        "entrypoint_match": entries,
        "cycle": cycle,
    } | {k: rows(spark, v, schemas[k]) for k, v in kinds.items()}


def settings_rules(settings: Settings) -> list[Rule]:
    """The rules of all ceilings that are on, and of all contracts."""
    ceilings = [ceiling_rule(rule, guard, metric) for rule, metric, guard, _ in GATES if rule in settings.ceilings]
    return ceilings + [contract_rule(CONTRACT_KINDS[c.kind], c.name) for c in settings.contracts]


def gate(facts: Mapping[str, DataFrame], settings: Settings, deep: bool = True) -> DataFrame:
    """Findings of the project's rules over its facts; without ``deep`` those that need the import graph are left out."""
    found = rules_for_scope(settings_rules(settings), {k for k in ("imports", "cycle") if deep and k in facts})
    return evaluate(found, facts)


def gate_by_hand(files: DataFrame, entities: DataFrame, metrics: DataFrame, settings: Settings) -> DataFrame:
    """The ceilings' findings without the rule compiler, one filter a rule: (rule, path, entity, line, value, ceiling, blocking)."""
    own = governed(files, settings)
    joined = entities.join(own, "path").join(metrics, "id")
    out = []
    for rule, metric, guard, _ in GATES:
        base = FOLLOWS.get(rule, rule)
        if rule not in settings.ceilings or base not in settings.ceilings:
            continue
        limit = F.lit(float(settings.ceilings[base]))
        for layer, limits in settings.layer_ceilings.items():
            if base in limits:
                limit = F.when(F.col("layer") == layer, F.lit(float(limits[base]))).otherwise(limit)
        hit = joined.where((F.col("metric_key") == metric) & F.col("kind").isin(*GUARDS[guard]) & (F.col("value") > limit))
        blocking = (F.col("exactness") == "EXACT") | (F.col("bound") == "lower")
        out.append(hit.select(F.lit(rule).alias("rule"), "path", F.col("name").alias("entity"), "line", "value", limit.alias("ceiling"), blocking.alias("blocking")).distinct())
    return reduce(DataFrame.unionByName, out) if out else joined.select(*[F.lit(None).cast(k).alias(c) for c, k in (("rule", "string"), ("path", "string"), ("entity", "string"), ("line", "int"), ("value", "double"), ("ceiling", "double"), ("blocking", "boolean"))]).limit(0)


def unscoped(decisions: DataFrame, files: DataFrame) -> DataFrame:
    """An advisory finding for each of ``decisions(decision, globs, document)`` whose globs match no file: (rule, path, entity, blocking)."""
    hit = scope_paths(decisions, files).select("decision").distinct()
    return decisions.join(hit, "decision", "left_anti").select(F.lit("decision:unscoped").alias("rule"), F.col("document").alias("path"), F.col("decision").cast("string").alias("entity"), F.lit(False).alias("blocking"))


def unparseable(files: DataFrame) -> DataFrame:
    """One blocking finding for each of ``files(path, parse_incomplete, error_line)`` that couldn't be read whole."""
    broken = files.where("parse_incomplete")
    return broken.select(F.lit("unparseable").alias("rule"), "path", F.col("path").alias("entity"), F.coalesce("error_line", F.lit(1)).alias("line"), F.lit(1.0).alias("value"), F.lit(0.0).alias("ceiling"), F.lit(True).alias("blocking"))
