"""Ranked constraint bundles and explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.gate import scope_paths
from .text import bm25


def contract_text(contract) -> str:
    """what a declared contract asks for, in one line."""
    names = contract.names
    return {
        "layered": f"imports go down only: {', then '.join(names)}",
        "forbidden": f"{contract.source} stays clear of {', '.join(names)}",
        "independence": f"no imports between {', '.join(names)}",
        "deep_import": f"{', '.join(names)} opens at {', '.join(contract.entries) or 'no file'}",
        "acyclic": "no import ring",
    }[contract.kind]


def candidates(settings, decisions: DataFrame) -> DataFrame:
    """The project's ceilings, those of layers, contracts and accepted decisions, as constraints.

    ``decisions(decision, title, status, body, globs, limits map<string,double>)``: an accepted one is prose, and each limit it sets
    an enforced constraint of its own. Ids are positions in that order.
    """
    layers = dict(settings.layers)
    made = [(rule, True, f"{rule} ceiling limit maximum {limit:g}", ["*"], rule, float(limit)) for rule, limit in sorted(settings.ceilings.items())]
    made += [(f"{rule} in {layer}", True, f"{rule} ceiling limit maximum {limit:g} layer {layer}", list(layers.get(layer, ())), rule, float(limit)) for layer, own in sorted(settings.layer_ceilings.items()) for rule, limit in sorted(own.items())]
    made += [(c.name, True, f"{c.name} {c.kind} {contract_text(c)}", [g for n in (*((c.source,) if c.source else ()), *c.names) for g in layers.get(n, ())], None, None) for c in settings.contracts]
    schema = "id long, name string, enforced boolean, text string, globs array<string>, rule string, limit double"
    fixed = decisions.sparkSession.createDataFrame([(i, *row) for i, row in enumerate(made)], schema)
    said = decisions.where("status = 'accepted'")
    text = F.concat_ws("\n", "title", "body")
    prose = said.select(F.col("title").alias("name"), F.lit(False).alias("enforced"), text.alias("text"), "globs", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("double").alias("limit"), "decision", F.lit("").alias("_r"))
    limits = said.select("decision", "globs", text.alias("text"), F.explode("limits").alias("rule", "limit"))
    tight = limits.select(F.concat("rule", F.lit(" ("), F.col("decision").cast("string"), F.lit(")")).alias("name"), F.lit(True).alias("enforced"), "text", "globs", "rule", "limit", "decision", F.col("rule").alias("_r"))
    order = Window.orderBy("decision", "_r")  # decisions are configuration: few rows
    rest = prose.unionByName(tight).withColumn("id", F.row_number().over(order) - 1 + len(made))
    return fixed.unionByName(rest.select(F.col("id").cast("long").alias("id"), "name", "enforced", "text", "globs", "rule", "limit"))


def annotate(constraints: DataFrame, files: DataFrame, task: str) -> DataFrame:
    """``governs`` (files that a constraint covers) and ``relevance`` (score of its text for the task).

    ``constraints(id, name, enforced, text, globs, rule, limit)``.
    """
    scope = constraints.select(F.col("id").alias("decision"), "globs")
    covered = scope_paths(scope, files).groupBy(F.col("decision").alias("id")).agg(F.count("*").alias("governs"))
    query = constraints.sparkSession.createDataFrame([(0, task)], "qid int, text string")
    scores = bm25(constraints.select(F.col("id").cast("string").alias("id"), "text"), query).select(F.col("id").alias("_k"), F.col("score").alias("relevance"))
    both = constraints.join(covered, "id", "left").join(scores, F.col("id").cast("string") == F.col("_k"), "left").drop("_k")
    return both.withColumn("governs", F.coalesce("governs", F.lit(0))).withColumn("relevance", F.coalesce("relevance", F.lit(0.0)))


def order(covers: Column, with_targets: bool) -> list[Column]:
    """T5: in scope first, then relevance, then breadth (narrow first with targets, wide first without), then name."""
    breadth = F.col("governs") if with_targets else -F.col("governs")
    return [(~covers).asc(), F.desc("relevance"), breadth.asc(), F.col("name").asc()]


def bundle(constraints: DataFrame, files: DataFrame, task: str, targets: DataFrame | None = None, limit: int = 7) -> DataFrame:
    """The best constraints: half of the budget to enforced ones, half to prose, what one side lacks to the other.

    Adds ``position`` (enforced first) and ``omitted``, the number that isn't shown.
    """
    rows = annotate(constraints, files, task)
    if targets is not None:
        hit = scope_paths(constraints.select(F.col("id").alias("decision"), "globs"), targets).select(F.col("decision").alias("id")).distinct().withColumn("_c", F.lit(True))
        rows = rows.join(hit, "id", "left").withColumn("_c", F.coalesce("_c", F.lit(False)))
    else:
        rows = rows.withColumn("_c", F.lit(False))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("enforced").orderBy(*order(F.col("_c"), targets is not None))))
    n = constraints.agg(F.count_if("enforced").alias("g"), F.count_if(~F.col("enforced")).alias("p"))
    prose = F.least(F.col("p"), F.greatest(F.lit(limit // 2), limit - F.col("g")))
    gated = F.least(F.col("g"), limit - prose)
    quota = n.select(gated.alias("q_gated"), F.least(F.col("p"), limit - gated).alias("q_prose"), (F.col("g") + F.col("p")).alias("n"))
    kept = ranked.crossJoin(F.broadcast(quota)).where(F.col("_r") <= F.when(F.col("enforced"), F.col("q_gated")).otherwise(F.col("q_prose")))
    position = F.when(F.col("enforced"), F.col("_r")).otherwise(F.col("q_gated") + F.col("_r"))
    return kept.select("id", "name", "enforced", "governs", "relevance", position.alias("position"), (F.col("n") - F.col("q_gated") - F.col("q_prose")).alias("omitted"))


def declarations(constraints: DataFrame, rule: str, path: str) -> DataFrame:
    """Declarations of a rule that cover a path, the tightest first."""
    spark = constraints.sparkSession
    hit = scope_paths(constraints.select(F.col("id").alias("decision"), "globs"), spark.createDataFrame([(path,)], "path string"))
    found = constraints.where((F.col("rule") == rule) & F.col("limit").isNotNull()).join(hit.select(F.col("decision").alias("id")), "id", "left_semi")
    return found.orderBy("limit", "name")
