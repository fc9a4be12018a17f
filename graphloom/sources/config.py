"""A project's configuration and the thresholds behind it."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..plans.facts import CONTRACT_KINDS, FOLLOWS, GATES, ContractOf, Settings

#: What can be tuned besides the ceilings of ``plans.facts.GATES``, with its default.
PARAMETERS = {
    "trivial_helper": 2.0, "many_helpers": 3.0, "clone_tokens": 50.0, "clone_lines": 4.0, "erosion_share": 0.10, "co_change_support": 5.0, "commit_size": 30.0, "co_change_confidence": 0.3,
    "minor_author": 0.05, "hub_percentile": 0.90, "hub_degree": 5.0, "unstable_share": 0.30, "god_lines": 5000.0, "bm25_k1": 1.5, "bm25_b": 0.75, "bundle_size": 7.0, "retry_budget": 3.0,
}
KNOWN = ("ceilings", "layers", "layer_ceilings", "contracts", "advisory", "exclude", "retry_budget")
CONTRACT_KEYS = {"layered": ("order",), "forbidden": ("source", "forbidden"), "independence": ("modules",), "deep_import": ("package", "allowed_entrypoints"), "acyclic": ("deferred",)}


class ConfigError(ValueError):
    """Something in the configuration that can't be acted on."""


def _table(value: Any, where: str) -> Mapping[str, Any]:
    if value is None:
        return {}
    if not isinstance(value, Mapping):
        raise ConfigError(f"{where} must be a mapping")
    return value


def _list(value: Any, where: str) -> tuple[str, ...]:
    if value is None:
        return ()
    if isinstance(value, str) or not isinstance(value, (list, tuple)) or not all(isinstance(x, str) for x in value):
        raise ConfigError(f"{where} must be a list of names")
    return tuple(value)


def _limits(value: Any, where: str) -> tuple[dict[str, float], set[str]]:
    """Limits by rule, and the rules that are switched off (false)."""
    rules, limits, off = {r for r, *_ in GATES}, {}, set()
    for rule, limit in _table(value, where).items():
        if rule not in rules:
            raise ConfigError(f"{where}: no rule {rule}")
        if rule in FOLLOWS and limit not in (False, None, True):
            raise ConfigError(f"{where}: {rule} follows {FOLLOWS[rule]} and has no limit of its own")
        if limit is False:
            off.add(rule)
        elif limit is not True and limit is not None:
            if isinstance(limit, bool) or not isinstance(limit, (int, float)):
                raise ConfigError(f"{where}: {rule} needs a number")
            limits[rule] = float(limit)
    return limits, off


def read_config(text: str | None) -> Settings:
    """YAML to settings; no text gives the defaults. Unknown keys, rules, layers and contract kinds raise, none is passed over."""
    if text is None:
        return Settings()
    import yaml

    try:
        raw = _table(yaml.safe_load(text), "the configuration")
    except yaml.YAMLError as e:
        raise ConfigError(f"no YAML: {e}") from e
    if unknown := sorted(set(raw) - set(KNOWN)):
        raise ConfigError(f"unknown key {unknown[0]}")
    limits, off = _limits(raw.get("ceilings"), "ceilings")
    ceilings = {r: c for r, c in ({r: c for r, _, _, c in GATES} | limits).items() if r not in off}
    layers = tuple((name, _list(globs, f"layers.{name}")) for name, globs in _table(raw.get("layers"), "layers").items())
    names = {n for n, _ in layers}
    own = {}
    for layer, values in _table(raw.get("layer_ceilings"), "layer_ceilings").items():
        if layer not in names:
            raise ConfigError(f"layer_ceilings: no layer {layer}")
        own[layer], off_here = _limits(values, f"layer_ceilings.{layer}")
        if off_here:
            raise ConfigError(f"layer_ceilings.{layer}: rules are switched off for the whole project only")
    contracts = []
    listed = raw.get("contracts") or []
    if not isinstance(listed, list):
        raise ConfigError("contracts must be a list")
    for c in listed:
        c = _table(c, "a contract")
        name, kind = c.get("name"), c.get("kind")
        if kind not in CONTRACT_KINDS:
            raise ConfigError(f"contract {name}: no kind {kind}")
        if not name or (wrong := sorted(set(c) - {"name", "kind", *CONTRACT_KEYS[kind]})):
            raise ConfigError("a contract needs a name" if not name else f"contract {name}: unknown key {wrong[0]}")
        package = [c["package"]] if c.get("package") else []
        said = [*_list(c.get("order"), "order"), *_list(c.get("forbidden"), "forbidden"), *_list(c.get("modules"), "modules"), *package]
        source = c.get("source")
        if missing := sorted({*said, *([source] if source else [])} - names):
            raise ConfigError(f"contract {name}: no layer {missing[0]}")
        contracts.append(ContractOf(name, kind, tuple(said), source, _list(c.get("allowed_entrypoints"), "allowed_entrypoints"), bool(c.get("deferred", False))))
    budget = raw.get("retry_budget", 3)
    if isinstance(budget, bool) or not isinstance(budget, int) or budget < 0:
        raise ConfigError("retry_budget must be a whole number")
    return Settings(ceilings, own, layers, tuple(contracts), _list(raw.get("advisory"), "advisory"), _list(raw.get("exclude"), "exclude"), budget)


def calibration(spark: SparkSession, settings: Settings) -> DataFrame:
    """Every number that can be tuned: (parameter, value, standard, on); ``on`` is null where nothing can be switched off."""
    rows = [(r, float(settings.ceilings.get(r, c)), c, r in settings.ceilings) for r, _, _, c in GATES]
    rows += [(p, float(settings.retry_budget) if p == "retry_budget" else v, v, None) for p, v in PARAMETERS.items()]
    return spark.createDataFrame(rows, "parameter string, value double, standard double, on boolean")
