"""Gate, contracts and ratchet around the rule compiler."""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``fnmatch`` as a regex over the whole string; ``*`` crosses ``/``."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        close = glob.find("]", i + 2) if c == "[" else -1
        if c == "[" and close > 0:
            inner = glob[i + 1 : close].replace("\\", "\\\\")
            out.append(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]")
            i = close
        else:
            out.append({"*": ".*", "?": "."}.get(c, re.escape(c)))
        i += 1
    return f"(?s)^(?:{''.join(out)})$"


def matches_any(path: Column, globs: Sequence[str]) -> Column:
    """Does any glob match?"""
    found = F.lit(False)
    for g in globs:
        found = found | path.rlike(glob_regex(g))
    return found


def layer_of(path: Column, layers: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Name of the first layer with a matching glob, else null."""
    out = F.lit(None).cast("string")
    for name, globs in reversed(layers):
        out = F.when(matches_any(path, globs), F.lit(name)).otherwise(out)
    return out


def path_under(path: Column, prefix: Column) -> Column:
    """The prefix itself or something below it."""
    return (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def finding_key(rule: Column, path: Column, entity: Column) -> Column:
    """identity of a finding."""
    return F.concat_ws("|", rule, path, F.coalesce(entity, F.lit("")))


def ratchet(findings: DataFrame, baseline: DataFrame, absolute: Sequence[str] = ("unparseable",)) -> DataFrame:
    """``findings(key, rule, value)`` against ``baseline(key, value)``: new, regressed (value above what was recorded) or forgiven.

    Rules of ``absolute`` are never forgiven.
    """
    b = baseline.select("key", F.col("value").alias("recorded"))
    state = F.when(F.col("recorded").isNull() | F.col("rule").isin(*absolute), "new").when(F.col("value") > F.col("recorded"), "regressed").otherwise("forgiven")
    return findings.join(b, "key", "left").withColumn("state", state)


def baseline_of(findings: DataFrame, absolute: Sequence[str] = ("unparseable",)) -> DataFrame:
    """K6: the worst value of each key, without absolute rules."""
    return findings.where(~F.col("rule").isin(*absolute)).groupBy("key").agg(F.max("value").alias("value"))


def introduced(findings: DataFrame, base: DataFrame | None) -> DataFrame:
    """Was the key absent at the base? Null if there is no base."""
    if base is None:
        return findings.withColumn("introduced", F.lit(None).cast("boolean"))
    known = base.select("key").distinct().withColumn("_there", F.lit(True))
    return findings.join(known, "key", "left").withColumn("introduced", F.col("_there").isNull()).drop("_there")


def on_changed_lines(findings: DataFrame, touched: DataFrame) -> DataFrame:
    """Findings on a touched ``(path, line)``."""
    return findings.join(touched.select("path", "line").distinct(), ["path", "line"], "left_semi")


def review_counts(findings: DataFrame) -> DataFrame:
    """New, regressed, forgiven; introduced is null if any is unknown."""
    unknown = F.bool_or(F.col("introduced").isNull())
    return findings.agg(
        F.count_if(F.col("state") == "new").alias("new"),
        F.count_if(F.col("state") == "regressed").alias("regressed"),
        F.count_if(F.col("state") == "forgiven").alias("forgiven"),
        F.when(~F.coalesce(unknown, F.lit(False)), F.count_if(F.col("introduced"))).alias("introduced"),
    )


def allowed_edges(contract: str, layers: Sequence[str], spark) -> DataFrame:
    """Every pair of a higher and a lower layer."""
    rows = [(contract, a, b) for i, a in enumerate(layers) for b in layers[i + 1 :]]
    return spark.createDataFrame(rows, "contract string, from_layer string, to_layer string")


def tightened(ceilings: DataFrame, decisions: DataFrame) -> DataFrame:
    """``ceilings(rule, path, limit)`` with the least limit of matching ``decisions(rule, path, limit, decision)``, and whose it is.

    A decision that isn't below the ceiling changes nothing.
    """
    least = decisions.groupBy("rule", "path").agg(F.min(F.struct("limit", "decision")).alias("d"))
    both = ceilings.join(least, ["rule", "path"], "left")
    lower = F.col("d.limit") < F.col("limit")
    return both.select("rule", "path", F.when(lower, F.col("d.limit")).otherwise(F.col("limit")).alias("limit"), F.when(lower, F.col("d.decision")).alias("decision"))


def effective_ceilings(project: DataFrame, layers: DataFrame, files: DataFrame) -> DataFrame:
    """The layer's limit where it has one, else the project's: (rule, path, limit)."""
    return files.select("path", "layer").crossJoin(project).join(layers.select("layer", "rule", F.col("limit").alias("own")), ["layer", "rule"], "left").select("rule", "path", F.coalesce("own", "limit").alias("limit"))


def glob_pattern(globs: DataFrame, glob: str = "glob") -> DataFrame:
    """``globs`` with ``pattern``, each glob's regex, and ``head``, its first folder if that has no wildcard (else null)."""
    @F.pandas_udf("string")
    def regex(found: pd.Series) -> pd.Series:
        return found.map(lambda g: None if g is None else glob_regex(g))

    return globs.withColumn("pattern", regex(F.col(glob))).withColumn("head", F.nullif(F.regexp_extract(glob, r"^([^*?\[/]+)/", 1), F.lit("")))


def scope_paths(decisions: DataFrame, files: DataFrame, globs: str = "globs") -> DataFrame:
    """Decisions by the files that any of their globs matches: (decision, path).

    Globs whose first folder is plain meet the files of that folder in an equi-join; for the others each file is walked once over
    an automaton of them all (``globs.matching``). Null and empty lists match nothing.
    """
    from .globs import matching

    patterns = glob_pattern(decisions.select("decision", F.explode(globs).alias("glob")).distinct())
    rows = files.select("path").distinct().withColumn("head", F.regexp_extract("path", r"^([^/]*)/", 1))
    plain = rows.join(patterns.where("head is not null").select("decision", "pattern", "head"), "head").where(F.expr("path rlike pattern"))
    wild = patterns.where("head is null").select("decision", "glob")
    walked = matching(rows, wild).join(wild, "glob")
    return plain.select("decision", "path").unionByName(walked.select("decision", "path")).distinct()


def reflexion(edges: DataFrame, layer: DataFrame, declared: DataFrame) -> DataFrame:
    """Layer pairs of ``edges(src, dst)`` as convergent, divergent or absent, with their number of edges.

    ``declared(from_layer, to_layer)`` are the pairs the architecture has; edges inside one layer or with an
    ungoverned end don't count.
    """
    a = layer.select(F.col("path").alias("src"), F.col("layer").alias("from_layer"))
    b = layer.select(F.col("path").alias("dst"), F.col("layer").alias("to_layer"))
    seen = edges.join(a, "src").join(b, "dst").where("from_layer <> to_layer").groupBy("from_layer", "to_layer").agg(F.count("*").alias("edges"))
    wanted = declared.select("from_layer", "to_layer").distinct().withColumn("declared", F.lit(True))
    both = seen.join(wanted, ["from_layer", "to_layer"], "full")
    kind = F.when(F.col("edges").isNull(), "absent").when(F.col("declared"), "convergent").otherwise("divergent")
    return both.select("from_layer", "to_layer", F.coalesce("edges", F.lit(0)).alias("edges"), kind.alias("kind"))


def ungoverned(files: DataFrame, in_contract: DataFrame) -> DataFrame:
    """Files without a layer, or whose layer is in no contract."""
    return files.join(in_contract.select("layer").distinct(), "layer", "left_anti")
