"""Conjunctive rules with negation, compiled to joins.

A rule reads given relations only: another rule's head isn't one, neither negated nor otherwise, and asking for it is an error.
Facts are sets (repeated rows count once); a null never joins; empty relations are no error.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RuleError(ValueError):
    """A rule that can't be evaluated; found before anything runs."""


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Atom:
    """``relation(terms)``, or its absence if ``negated``. A term is a Var or a constant; None matches anything."""

    relation: str
    terms: tuple[Any, ...]
    negated: bool = False


_OPERATORS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
}


@dataclass(frozen=True)
class Compare:
    """A comparison of bound terms."""

    left: Any
    operator: str
    right: Any


@dataclass(frozen=True)
class Rule:
    """``head`` maps output columns to terms; the body is read from left to right."""

    name: str
    head: Mapping[str, Any]
    body: Sequence[Atom | Compare] = field(default_factory=tuple)


def check(rules: Sequence[Rule], facts: Mapping[str, DataFrame]) -> None:
    """Ranges are restricted, relations exist with the right arity, no rule negates what rules derive."""
    derived = {r.name for r in rules}
    for rule in rules:
        bound: set[str] = set()
        for part in rule.body:
            if isinstance(part, Compare):
                if part.operator not in _OPERATORS:
                    raise RuleError(f"{rule.name}: operator {part.operator}")
                free = [t.name for t in (part.left, part.right) if isinstance(t, Var) and t.name not in bound]
                if free:
                    raise RuleError(f"{rule.name}: {free[0]} is compared before it is bound")
                continue
            if part.negated and part.relation in derived and part.relation not in facts:
                raise RuleError(f"{rule.name}: negates the derived relation {part.relation}")
            if part.relation not in facts:
                raise RuleError(f"{rule.name}: no relation {part.relation}")
            if len(part.terms) != len(facts[part.relation].columns):
                raise RuleError(f"{rule.name}: {part.relation} takes {len(facts[part.relation].columns)} terms")
            names = {t.name for t in part.terms if isinstance(t, Var)}
            if part.negated and names - bound:
                raise RuleError(f"{rule.name}: {sorted(names - bound)[0]} is bound in a negated atom only")
            bound |= set() if part.negated else names
        free = sorted(t.name for t in rule.head.values() if isinstance(t, Var) and t.name not in bound)
        if free:
            raise RuleError(f"{rule.name}: head needs {free[0]}")


def _relation(atom: Atom, fact: DataFrame) -> DataFrame:
    """Constants and repeated variables become filters below the join; columns take the variables' names."""
    renamed = fact.toDF(*[f"_{i}" for i in range(len(fact.columns))])
    names: dict[str, str] = {}
    for i, term in enumerate(atom.terms):
        if isinstance(term, Var):
            if term.name in names:
                renamed = renamed.where(F.col(f"_{i}").eqNullSafe(F.col(names[term.name])))
            else:
                names[term.name] = f"_{i}"
        elif term is not None:
            renamed = renamed.where(F.col(f"_{i}") == F.lit(term))
    out = renamed.select(*[F.col(c).alias(v) for v, c in names.items()])
    return out.distinct() if None in atom.terms else out  # else the body's distinct is enough


def solve(rule: Rule, facts: Mapping[str, DataFrame]) -> DataFrame:
    """Bindings of the body. Shared variables are the keys of an inner join or, negated, of an anti join."""
    bound: DataFrame | None = None
    for part in rule.body:
        if isinstance(part, Compare):
            if bound is None:
                raise RuleError(f"{rule.name}: a comparison can't come first")
            bound = bound.where(_OPERATORS[part.operator](_term(part.left), _term(part.right)))
            continue
        relation = _relation(part, facts[part.relation])
        if bound is None:
            if part.negated:
                raise RuleError(f"{rule.name}: a negated atom can't come first")
            bound = relation
            continue
        shared = [c for c in relation.columns if c in bound.columns]
        if not relation.columns or not shared:
            hit = relation.select(F.lit(1).alias("_hit")).limit(1) if part.negated or not relation.columns else relation
            bound = bound.join(hit, F.lit(True), "left_anti" if part.negated else "left_semi") if part.negated or not relation.columns else bound.crossJoin(hit)  # J5
        else:
            known = len(shared) == len(relation.columns)  # binds nothing new
            bound = bound.join(relation, shared, "left_anti" if part.negated else "left_semi" if known else "inner")
    if bound is None:
        raise RuleError(f"{rule.name}: empty body")
    return bound.distinct()


def _term(term: Any) -> Column:
    return F.col(term.name) if isinstance(term, Var) else F.lit(term)


def evaluate(rules: Sequence[Rule], facts: Mapping[str, DataFrame]) -> DataFrame:
    """Findings of all rules, one plan: ``rule`` and the head's columns (the same for every rule)."""
    check(rules, facts)
    columns = sorted({c for r in rules for c in r.head})
    found = [solve(r, facts).select(F.lit(r.name).alias("rule"), *[(_term(r.head[c]) if c in r.head else F.lit(None)).cast("string").alias(c) for c in columns]) for r in rules]
    return reduce(DataFrame.unionByName, found)


def rules_for_scope(rules: Sequence[Rule], populated: set[str], optional: set[str] = frozenset({"imports", "cycle"})) -> list[Rule]:  # type: ignore[assignment]
    """Without the rules that touch an optional relation which isn't populated."""
    return [r for r in rules if not any(isinstance(p, Atom) and p.relation in optional - populated for p in r.body)]


V = Var


def ceiling_rule(name: str, kind_relation: str, metric: str) -> Rule:
    """Entities of guarded kinds whose metric is above its ceiling, strictly; blocking is a column.

    The metric comes first, as its key leaves the fewest rows; then what the head tells of the entity.
    """
    measured = Atom("metric", (V("what"), metric, V("value"), V("how"), V("side")))
    told = {"path": V("file"), "entity": V("label"), "line": V("at"), "value": V("value"), "ceiling": V("most"), "blocking": V("stops")}
    limits = (Atom("ceiling", (name, V("file"), V("most"))), Compare(V("most"), "<", V("value")))
    return Rule(name, told, (measured, Atom("entity", (V("what"), V("file"), V("sort"), V("label"), V("at"))), *limits, Atom(kind_relation, (V("sort"),)), Atom("blocking", (V("how"), V("side"), V("stops")))))


@dataclass(frozen=True)
class Contract:
    """What a kind of contract says of an import from layer ``here`` to another layer ``there``.

    ``members``: a relation that must name both layers; ``pair``: one that must hold the pair; ``entered``: one that must name the
    second; ``allowed``: one whose match excuses the import, with what it is asked for; ``ring``: one of file pairs.
    """

    members: str | None = None
    pair: str | None = None
    entered: str | None = None
    allowed: tuple[str, tuple[Var, ...]] | None = None
    ring: str | None = None

    def rule(self, name: str, contract: str) -> Rule:
        body: list[Atom | Compare] = [Atom("imports", (V("importer"), V("imported")))]
        if self.ring:
            body.append(Atom(self.ring, (contract, V("importer"), V("imported"))))
        else:
            body += [Atom("layer", (V(end), V(layer))) for end, layer in (("importer", "here"), ("imported", "there"))]
            if self.pair:
                body.append(Atom(self.pair, (contract, V("here"), V("there"))))
            else:
                body.append(Compare(V("here"), "!=", V("there")))
            named = [(self.members, "here"), (self.members, "there"), (self.entered, "there")]
            body += [Atom(relation, (contract, V(layer))) for relation, layer in named if relation]
            if self.allowed:
                body.append(Atom(self.allowed[0], (contract, *self.allowed[1]), negated=True))
        return Rule(f"{name}:{contract}", {"path": V("importer"), "entity": V("imported")}, tuple(body))


#: Layers of the contract in no allowed direction; a pair it forbids; layers it keeps apart; a package entered past
#: its entry points; an import inside a ring.
CONTRACTS = {
    "layered": Contract(members="in_contract", allowed=("allowed_edge", (V("here"), V("there")))),
    "forbidden": Contract(pair="forbidden_edge"),
    "independence": Contract(members="independent"),
    "deep": Contract(entered="package", allowed=("entrypoint_match", (V("imported"),))),
    "acyclic": Contract(ring="cycle"),
}


def contract_rule(kind: str, contract: str) -> Rule:
    """The rule of one contract; unknown kinds raise."""
    if kind not in CONTRACTS:
        raise RuleError(f"no contract kind {kind}")
    return CONTRACTS[kind].rule(kind, contract)
