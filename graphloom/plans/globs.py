"""Many globs at once: one automaton of them all, over which each path is walked once."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed

#: Globs of one automaton; more are dealt to several, one after the other.
BLOCK = 20_000
#: Sets of places in the tree of globs that a task remembers, before it starts anew.
STATES = 50_000
ANY, STAR = "?", "*"


def signs(glob: str) -> list[str]:
    """The signs of a glob: ``*`` (runs of it are one), ``?``, a class in brackets, or a plain character, marked by ``=``."""
    out: list[str] = []
    i = 0
    while i < len(glob):
        close = glob.find("]", i + 2) if glob[i] == "[" else -1
        sign = glob[i : close + 1] if close > 0 else glob[i] if glob[i] in (ANY, STAR) else "=" + glob[i]
        i += len(sign) if close > 0 else 1
        if sign != STAR or out[-1:] != [STAR]:
            out.append(sign)
    return out


def _class(sign: str) -> re.Pattern:
    """A class of characters; one with a range that goes down holds none."""
    inner = sign[1:-1].replace("\\", "\\\\").replace("[", "\\[")
    try:
        return re.compile(f"[{'^' + inner[1:] if inner[0] == '!' else inner}]", re.DOTALL)
    except re.error:
        return re.compile("(?!)")


class Automaton:
    """Globs as a tree by signs; sets of its nodes become states, and steps between them are found when a path first takes them."""

    def __init__(self, globs: Sequence[str]) -> None:
        self.globs = list(globs)
        self.plain: list[dict[str, int]] = [{}]
        self.other: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.loops = [False]
        self.classes: dict[str, re.Pattern] = {}
        for number, glob in enumerate(self.globs):
            node = 0
            for sign in signs(glob):
                branch, key = (self.plain[node], sign[1:]) if sign[0] == "=" else (self.other[node], sign)
                if key not in branch:
                    branch[key] = len(self.plain)
                    self.plain.append({})
                    self.other.append({})
                    self.ends.append([])
                    self.loops.append(sign == STAR)
                if sign[0] == "[":
                    self.classes.setdefault(sign, _class(sign))
                node = branch[key]
            self.ends[node].append(number)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset[int], int] = {}
        self.sets: list[frozenset[int]] = []
        self.steps: list[dict[str, int]] = []
        self.found: list[list[str] | None] = []
        self._state({0})

    def _state(self, nodes: set[int]) -> int:
        whole = frozenset(nodes | {self.other[n][STAR] for n in nodes if STAR in self.other[n]})
        if whole not in self.states:
            self.states[whole] = len(self.sets)
            self.sets.append(whole)
            self.steps.append({})
            self.found.append(None)
        return self.states[whole]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for n in self.sets[state]:
            if self.loops[n]:
                to.add(n)
            if c in self.plain[n]:
                to.add(self.plain[n][c])
            to.update(m for sign, m in self.other[n].items() if sign == ANY or sign[0] == "[" and self.classes[sign].match(c))
        self.steps[state][c] = after = self._state(to)
        return after

    def matches(self, path: str) -> list[str]:
        """The globs that match the whole path."""
        if len(self.sets) > STATES:
            self._forget()
        state = 0
        for c in path:
            after = self.steps[state].get(c)
            state = self._step(state, c) if after is None else after
        if self.found[state] is None:
            self.found[state] = [self.globs[i] for n in self.sets[state] for i in self.ends[n]]
        return self.found[state]


def _walked(paths: DataFrame, globs: Sequence[str]) -> DataFrame:
    schema = T.StructType([paths.schema["path"], T.StructField("globs", T.ArrayType(T.StringType()))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(globs)
        for batch in batches:
            names = batch.column("path").to_pylist()
            hits = [automaton.matches(p) for p in names]
            keep = pa.array([bool(h) for h in hits], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("path").filter(keep), pa.array([h for h in hits if h], pa.list_(pa.string()))], names=["path", "globs"])

    return paths.mapInArrow(walk, schema).select("path", F.explode("globs").alias("glob"))


def matching(paths: DataFrame, globs: DataFrame, block: int = BLOCK) -> DataFrame:
    """``paths(path)`` by the ``globs(glob)`` that match the whole of them: (path, glob), as ``fnmatch`` would with case.

    A path is walked once a block of globs, character by character, whatever the number of globs in it; its cost is its length
    and its matches. Globs reach the tasks through the driver, about ``block`` at a time; with more, the matches of each block are
    written before the next is read. Repeated globs count once, repeated paths stay; null paths and globs, and no globs, match
    nothing; an empty glob matches the empty path.
    """
    rows, wanted = paths.select("path").where(F.col("path").isNotNull()), globs.select("glob").where(F.col("glob").isNotNull()).distinct()
    few = wanted.limit(block + 1).collect()
    if len(few) <= block:
        return _walked(rows, sorted(r.glob for r in few))
    blocks = -(-wanted.count() // block)
    dealt = F.pmod(F.xxhash64("glob"), F.lit(blocks))
    out = None
    for b in range(blocks):
        part = checkpointed(_walked(rows, sorted(r.glob for r in wanted.where(dealt == b).collect())))
        out = part if out is None else out.unionByName(part)
    return out
