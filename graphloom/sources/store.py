"""Table sinks with replace-per-path semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_paths(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """K1-K4: all rows of the paths that ``new`` has are replaced by its rows. Rows of a null path are added and replace nothing;
    without new rows the old ones stay as they are."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """K4, Q4: one row for each key, the new ones before the old, of several the last by ``order`` (null first; of equal ones any).
    A null key is a key; either side may be empty."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc("_g"), F.desc(order))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_g", "_r")


def prune(table: DataFrame, seen: DataFrame, path: str = "path") -> DataFrame:
    """K5: without the paths that a whole scan no longer has; a null path goes, and an empty scan leaves nothing."""
    return table.join(seen.select(path).distinct(), path, "left_semi")


def still_incomplete(incomplete: DataFrame, seen: DataFrame, path: str = "path") -> DataFrame:
    """The paths that are both incomplete and part of the last scan, each once; a null path is a path."""
    return incomplete.select(path).intersect(seen.select(path))


def write_table(df: DataFrame, path: str, partition: str = "language") -> None:
    """K1: parquet by partition; only the partitions that ``df`` has are overwritten."""
    df.write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(partition).parquet(path)


def edge_stats(edges: DataFrame) -> DataFrame:
    """A1, Q6: edges of each kind, and those with a target."""
    return edges.groupBy("kind").agg(F.count("*").alias("n"), F.count("dst_id").alias("resolved"))


def complexity_by_file(metrics: DataFrame, key: str) -> DataFrame:
    """A2, Q9."""
    return metrics.where(F.col("metric_key") == key).groupBy("path").agg(F.sum("value").alias("value"))


def last_scores(rows: DataFrame, entity: str, score: str, order: list[str]) -> DataFrame:
    """A3: one score for each entity name, that of the last row by ``order``; rows without a name are left out."""
    return rows.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.max_by(score, F.struct(*order)).alias("score"))


def occurrence_numbers(entities: DataFrame) -> DataFrame:
    """Siblings of one (path, kind, qualified name), numbered by their start."""
    w = Window.partitionBy("path", "kind", "qualified_name").orderBy("start_byte")
    return entities.withColumn("occurrence", F.row_number().over(w) - 1)


def entity_id(entities: DataFrame) -> DataFrame:
    """A position-free id of path, kind, qualified name and occurrence."""
    return occurrence_numbers(entities).withColumn("id", F.sha2(F.concat_ws("\u0000", "path", "kind", "qualified_name", F.col("occurrence").cast("string")), 256))
