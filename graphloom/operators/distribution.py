"""Concentration and risk: Gini, erosion, risk profiles, coupling distributions.

Null values are left out; groups of null keys are groups; no rows give no groups, and without groups one row of zeros where a share is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.picks import ranked, ranked_pick


def gini(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """``2 * sum(i * x) / (n * sum(x)) - (n + 1) / n`` over ascending values, 0 if the sum isn't positive."""
    rows = ranked(df.select(*by, value), value, by)
    n, s = F.count("*"), F.sum(value)
    raw = F.try_divide(2 * F.sum(F.col("_i") * F.col(value)), n * s) - (n + 1) / n
    return rows.groupBy(*by).agg(F.when(s > 0, raw).otherwise(F.lit(0.0)).alias("gini"), n.alias("n"))


def erosion(df: DataFrame, value: str, by: Sequence[str] = (), k: float = 0.10, name: str = "erosion") -> DataFrame:
    """The share of the sum that the largest ``max(1, ceil(n * k))`` values hold, 0 if the sum isn't positive."""
    rows = ranked(df.select(*by, value), value, by, descending=True)
    top = F.greatest(F.lit(1), F.ceil(F.col("_n") * k))
    share = F.try_divide(F.sum(F.when(F.col("_i") <= top, F.col(value)).otherwise(0)), F.sum(value))
    return rows.groupBy(*by).agg(F.when(F.sum(value) > 0, share).otherwise(F.lit(0.0)).alias(name))


def structural_erosion(df: DataFrame, entity: str, value: str, by: Sequence[str], k: float = 0.10) -> DataFrame:
    """Count, total, Gini, erosion and the largest entity of each group."""
    basic = df.groupBy(*by).agg(F.count(value).alias("count"), F.sum(value).alias("total"), F.min_by(entity, F.struct(-F.col(value), F.col(entity))).alias("worst"))
    return basic.join(gini(df, value, by).drop("n"), list(by)).join(erosion(df, value, by, k), list(by))


def risk_profile(df: DataFrame, value: str, weight: str, ceiling: float, by: Sequence[str]) -> DataFrame:
    """Share of weight (at least 1 a row) whose value is above the ceiling, strictly."""
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0)), F.lit(1))
    over = F.col(value) > ceiling
    return df.groupBy(*by).agg(F.count("*").alias("entities"), F.sum(w).alias("weight"), F.sum(F.when(over, w).otherwise(0)).alias("weight_over"), F.count_if(over).alias("offenders")).withColumn("share_over", F.try_divide("weight_over", "weight"))


def distribution(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Count, upper median (``ordered[n // 2]``), 90th pick and maximum of each group."""
    out = df.groupBy(*by).agg(F.count(value).alias("n"), F.max(value).alias("max"))
    for name, q in (("median", 0.5), ("p90", 0.9)):
        out = out.join(ranked_pick(df, value, q, by, name), list(by), "left")
    return out


def coupling_profile(classes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Exact and bounded counts, the distribution of exact ``cbo`` and the worst class by (-cbo, -rfc, name)."""
    exact = classes.where("exactness = 'EXACT'")
    counts = classes.groupBy(*by).agg(
        F.count_if(F.col("exactness") == "EXACT").alias("exact"),
        F.count_if(F.col("exactness") != "EXACT").alias("bounded"),
        F.min_by("name", F.struct(-F.col("cbo"), -F.col("rfc"), F.col("name"))).alias("worst"),
    )
    return counts.join(distribution(exact, "cbo", by).drop("n"), list(by), "left")


def god_cutoff(sizes: DataFrame, size: str, floor: int = 5000, few: bool = False) -> DataFrame:
    """``floor`` below ten components, else the larger of the 90th pick and ``floor``: one row ``cutoff``."""
    pick = ranked_pick(sizes, size, 0.9, few=few)
    n = sizes.agg(F.count(size).alias("n"))
    return n.join(pick, F.lit(True), "left").select(F.when((F.col("n") < 10) | F.col("pick").isNull(), F.lit(floor)).otherwise(F.greatest("pick", F.lit(floor))).alias("cutoff"))


def share(numerator: Column, denominator: Column) -> Column:
    """A ratio that is null without a denominator."""
    return F.try_divide(numerator, denominator)
