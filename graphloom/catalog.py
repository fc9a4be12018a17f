"""Registered queries and their SQL oracles, by family."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import classes, code, distribution, graph, history, report, rules, store, text

_FAMILIES = (distribution, history, graph, rules, text, classes, store, code, report)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for f in _FAMILIES for k, v in f.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for f in _FAMILIES for k, v in f.ORACLES.items()}
