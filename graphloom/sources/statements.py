"""The statements that readers and writers of a code graph's tables run.

Tables: ``files(path, ...)``, ``entities(id, file_path, kind, qualified_name, start_byte, end_byte, attrs, ...)``,
``edges(src_id, kind, dst_id, dst_ref, resolution, confidence, attrs, ...)``, ``metrics(entity_id, file_path, metric_key, value,
explanation)``, ``file_metrics(path, metric_key, value)``. All are plain filters, joins and limits over whole tables, so that
Catalyst pushes them to the scan; a deletion is the table without its rows. Nulls match nothing.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def file_row(files: DataFrame, path: str) -> DataFrame:
    """Q1."""
    return files.where(F.col("path") == path)


def delete_path(tables: Mapping[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """Q2: every table without the rows of a path; what hangs on a file is told by its ``file_path`` or ``path``."""
    return {name: t.where(~F.col("file_path" if "file_path" in t.columns else "path").eqNullSafe(path)) for name, t in tables.items()}


def put_files(tables: Mapping[str, DataFrame], new: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Q3: the rows of ``new`` in place of all rows of the paths that its ``files`` have; other tables follow."""
    paths = new["files"].select(F.col("path").alias("_p")).distinct()
    out = {}
    for name, table in tables.items():
        key = "file_path" if "file_path" in table.columns else "path"
        kept = table.join(paths, F.col(key) == F.col("_p"), "left_anti")
        out[name] = kept.unionByName(new[name], allowMissingColumns=True) if name in new else kept
    return out


def measured_entities(metrics: DataFrame, entities: DataFrame) -> DataFrame:
    """Measurements with their entity's name and file."""
    named = entities.select(F.col("id").alias("entity_id"), "qualified_name", F.col("file_path").alias("path"), "kind")
    return metrics.drop("file_path").join(named, "entity_id")


def worst_entities(metrics: DataFrame, entities: DataFrame, key: str, limit: int | None, paths: DataFrame | None = None) -> DataFrame:
    """Q7, Q8, Q10: (qualified_name, path, value) of one metric, the highest first, then by name; narrowed before the limit."""
    rows = measured_entities(metrics.where(F.col("metric_key") == key), entities)
    return _highest(rows.select("qualified_name", "path", "value"), ["qualified_name", "path"], limit, paths)


def worst_files(file_metrics: DataFrame, key: str, limit: int | None, paths: DataFrame | None = None) -> DataFrame:
    """T2, Q7, Q8 for metrics of files: (path, value)."""
    return _highest(file_metrics.where(F.col("metric_key") == key).select("path", "value"), ["path"], limit, paths)


def _highest(rows: DataFrame, then: list[str], limit: int | None, paths: DataFrame | None) -> DataFrame:
    if paths is not None:
        rows = rows.join(paths.select("path").distinct(), "path", "left_semi")
    rows = rows.orderBy(F.desc_nulls_last("value"), *then)
    return rows if limit is None else rows.limit(limit)


def metric_values(metrics: DataFrame, key: str) -> DataFrame:
    """Q11: (entity_id, value) of one metric."""
    return metrics.where(F.col("metric_key") == key).select("entity_id", "value")


def entity_order() -> list[Column]:
    """By start, the enclosing entity first."""
    return [F.col("start_byte").asc(), F.col("end_byte").desc()]


def entities_of(entities: DataFrame, path: str) -> DataFrame:
    """Q12."""
    return entities.where(F.col("file_path") == path).orderBy(*entity_order())


def known_paths(files: DataFrame) -> DataFrame:
    """Q13."""
    return files.select("path")


def incomplete_paths(files: DataFrame) -> DataFrame:
    """Q15: files whose tree has an error node."""
    return files.where("parse_incomplete").select("path")


def has_measurements(metrics: DataFrame, entities: DataFrame) -> DataFrame:
    """Q16: the paths with a measured entity."""
    return entities.join(metrics.select(F.col("entity_id").alias("id")), "id", "left_semi").select(F.col("file_path").alias("path")).distinct()


def call_edges(edges: DataFrame) -> DataFrame:
    """Q17: all calls, those without a target too."""
    return edges.where(F.col("kind") == "calls").select("src_id", "dst_id", "resolution", "confidence")


def dispatch_sources(edges: DataFrame) -> DataFrame:
    """Q18: entities that override or implement something."""
    return edges.where(F.col("kind").isin("overrides", "implements")).select("src_id").distinct()


def reference_edges(edges: DataFrame) -> DataFrame:
    """Q19: distinct references that have a target."""
    return edges.where((F.col("kind") == "references") & F.col("dst_id").isNotNull()).select("src_id", "dst_id").distinct()


def without_lost_references(edges: DataFrame) -> DataFrame:
    """Q20: without the references that lead out of the tree; calls that do stay."""
    return edges.where(~((F.col("kind") == "references") & F.col("dst_id").isNull()))


def local_calls(edges: DataFrame) -> DataFrame:
    """Q21: calls without a target whose symbol is local to its document."""
    return edges.where((F.col("kind") == "calls") & F.col("dst_id").isNull() & F.col("dst_ref").startswith("local "))


def point_calls(edges: DataFrame, found: DataFrame) -> DataFrame:
    """Q22: edges with the target of ``found(edge_id, entity_id, confidence)``: resolved by name, with the way in ``attrs`` (a map)."""
    hit = found.select("edge_id", F.col("entity_id").alias("_to"), F.col("confidence").alias("_sure"))
    j = edges.join(hit, "edge_id", "left")
    new = F.col("_to").isNotNull()
    via = F.map_concat(F.map_filter(F.coalesce("attrs", F.create_map().cast("map<string,string>")), lambda k, v: k != "via"), F.create_map(F.lit("via"), F.lit("import_alias")))
    return (
        j.withColumn("attrs", F.when(new, via).otherwise(F.col("attrs")))
        .withColumn("dst_id", F.coalesce("_to", "dst_id"))
        .withColumn("resolution", F.when(new, "L1").otherwise(F.col("resolution")))
        .withColumn("confidence", F.when(new, F.col("_sure")).otherwise(F.col("confidence")))
        .drop("_to", "_sure")
    )


def trail_of(metrics: DataFrame, entities: DataFrame, name: str, path: str, key: str = "cognitive_complexity") -> DataFrame:
    """Q23: the increments of one entity's metric, one row each, in order."""
    rows = measured_entities(metrics.where(F.col("metric_key") == key), entities).where((F.col("qualified_name") == name) & (F.col("path") == path))
    return rows.select(F.posexplode("explanation").alias("at", "said")).orderBy("at")


def type_counts(entities: DataFrame, component: Column) -> DataFrame:
    """Types and abstract ones by component; interfaces are abstract, classes where their attributes say so."""
    types = entities.where(F.col("kind").isin("class", "interface"))
    abstract = (F.col("kind") == "interface") | (F.coalesce(F.get_json_object("attrs", "$.is_abstract"), F.lit("false")) == "true")
    return types.groupBy(component.alias("node")).agg(F.count_if(abstract).alias("n_abstract"), F.count("*").alias("n_types"))


def without_old(ledger: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """K7: rows of a ledger that were ``seen`` in the last days."""
    return ledger.where(F.col("seen") >= now - F.make_dt_interval(F.lit(days)))
