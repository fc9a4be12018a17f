"""Ranked picks and window helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed


def ranked(df: DataFrame, value: str, by: Sequence[str] = (), descending: bool = False, few: bool = False) -> DataFrame:
    """``df`` with ``_i``, the rank of ``value`` from 1 on in its group, and ``_n``, the group's size; rows without a value are left out.

    Without groups, rows are dealt by ranges of the value and ranked inside their range; only the sizes of the ranges, one number
    a partition, are summed on the driver. ``few`` says that the caller's rows are few, so that one task may rank them.
    """
    known = df.where(F.col(value).isNotNull())
    order = F.col(value).desc() if descending else F.col(value).asc()
    if by or few:
        keys = list(by)
        return known.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    dealt = checkpointed(known.repartitionByRange(order).withColumn("_part", F.spark_partition_id()))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    before, rows = 0, []
    for part in sorted(sizes):
        rows.append((part, before))
        before += sizes[part]
    table = df.sparkSession.createDataFrame(rows, "_part int, _before long")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order))
    return dealt.withColumn("_i", inside).join(F.broadcast(table), "_part").withColumn("_i", F.col("_i") + F.col("_before")).withColumn("_n", F.lit(before)).drop("_part", "_before")


def ranked_pick(df: DataFrame, value: str, q: float, by: Sequence[str] = (), name: str = "pick", few: bool = False) -> DataFrame:
    """The value at sorted position ``min(n - 1, floor(n * q))`` of each group; no rows, no pick.

    Differs from ``percentile_disc``, whose rank is the ceiling. Nulls are left out; equal values share a pick.
    """
    rows = ranked(df.select(*by, value), value, by, few=few)
    at = F.least(F.col("_n"), F.floor(F.col("_n") * q) + 1)
    return rows.where(F.col("_i") == at).select(*by, F.col(value).alias(name))


def top_rows(df: DataFrame, order: Sequence[Column], limit: int | None) -> DataFrame:
    """Ordered rows with a limit (TakeOrderedAndProject)."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)
