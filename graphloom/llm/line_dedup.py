"""Line dedup with a log-template tree: token count, leading tokens, then templates with variable fields."""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_rows, materialise, maybe_in

#: Templates of a leaf up to which a line is compared with each (beyond, with those that an index finds).
SCAN = 64
#: Distinct lines that a task gathers before it passes them on.
GATHER = 100_000
WILD = "<*>"
_DIGITS = re.compile(r"(?<!\S)[^\s\d]*+\d\S*")


def masked(text: str) -> str:
    """``text`` with each token between white space that holds a decimal digit as a variable field."""
    return _DIGITS.sub(WILD, text)


def line_key(line: str) -> bytes:
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"))


def leaf_of(tokens: list[str], depth: int) -> int:
    """The leaf's number: token count and the ``depth`` leading tokens."""
    return xxhash.xxh3_64_intdigest(" ".join([str(len(tokens)), *tokens[:depth]]).encode("utf-8", "surrogatepass")) - (1 << 63)


class Leaf:
    """Templates of one leaf. A line joins the template that agrees with it in most places, if those are
    ``similarity`` of all at least (the first of equals); places that differ become variable fields.

    Beyond SCAN templates, an index finds all that can agree: the places behind the ``depth`` leading ones (which agree
    in the whole leaf) are cut into one segment more than places may differ, so that one segment is equal throughout.
    Segments of a template as it was stay in the index; they add candidates, which are compared like the others.
    """

    def __init__(self, similarity: float, depth: int) -> None:
        self.similarity, self.depth = similarity, depth
        self.words: dict[str, int] = {WILD: -1}
        self.table = np.zeros((0, 0), dtype=np.int32)
        self.n = 0
        self.members: list[list[bytes]] = []
        self.idents: list[set[int]] = []
        self.index: dict[tuple[int, bytes], list[int]] | None = None

    def segments(self, row: np.ndarray) -> list[tuple[int, bytes]]:
        lead = min(self.depth, len(row))
        n = max(1, len(row) - math.ceil(self.similarity * len(row)) + 1)
        cuts = [lead + i * (len(row) - lead) // n for i in range(n + 1)]
        return [(i, row[cuts[i] : cuts[i + 1]].tobytes()) for i in range(n)]

    def enter(self, at: int, old: list | None = None) -> None:
        for i, segment in enumerate(self.segments(self.table[at])):
            if old is None or old[i] != segment:
                self.index.setdefault(segment, []).append(at)

    def nearest(self, row: np.ndarray) -> int | None:
        if not self.n:
            return None
        if self.n <= SCAN:
            agree = (self.table[: self.n] == row).sum(axis=1)
            best = at = int(agree.argmax())
        else:
            if self.index is None:
                self.index = {}
                for i in range(self.n):
                    self.enter(i)
            near = sorted({i for segment in self.segments(row) for i in self.index.get(segment, ())})
            if not near:
                return None
            agree = (self.table[near] == row).sum(axis=1)
            best = int(agree.argmax())
            at = near[best]
        return at if agree[best] >= self.similarity * len(row) else None

    def add(self, tokens: list[str], key: bytes, idents: list[int], min_docs: int) -> None:
        row = np.array([self.words.setdefault(t, len(self.words)) for t in tokens], dtype=np.int32)
        at = self.nearest(row)
        if at is not None:
            differs = self.table[at] != row
            if differs.any():
                old = self.segments(self.table[at]) if self.index is not None else None
                self.table[at][differs] = -1
                if old is not None:
                    self.enter(at, old)
            self.members[at].append(key)
            self.idents[at] = set(sorted(self.idents[at].union(idents))[:min_docs])
            return
        if self.n == len(self.table):
            grown = np.zeros((max(8, 2 * self.n), len(row)), dtype=np.int32)
            if self.n:
                grown[: self.n] = self.table
            self.table = grown
        self.table[self.n] = row
        self.n += 1
        self.members.append([key])
        self.idents.append(set(idents))
        if self.index is not None:
            self.enter(self.n - 1)

    def recurring(self, min_docs: int):
        """(key, least id) of the lines whose template stands in ``min_docs`` documents; equal templates are one."""
        same: dict[bytes, list[int]] = {}
        for i in range(self.n):
            same.setdefault(self.table[i].tobytes(), []).append(i)
        for group in same.values():
            idents = set().union(*(self.idents[i] for i in group))
            if len(idents) >= min_docs:
                yield from ((key, min(idents)) for i in group for key in self.members[i])


def dedup_lines(docs: DataFrame, min_docs: int = 3, long_docs: int = 2, long_tokens: int = 50, min_tokens: int = 1, depth: int = 3, similarity: float = 0.7) -> DataFrame:
    """Drop lines whose template recurs across documents; the document of least id keeps its own.

    Lines end at newlines; their tokens lie between white space, tokens with a decimal digit are variable. The tree's path is
    the token count and the ``depth`` leading tokens; in a leaf, lines that agree in ``similarity`` of all places share a
    template. One that stands in ``min_docs`` documents or more (of ``long_tokens`` tokens or more: in ``long_docs``) is
    recurring. Lines of fewer than ``min_tokens`` tokens, blank ones at least, are left alone. Returns ``doc_id, n_lines,
    n_dropped, text`` (what is kept).

    1. One pass over the texts writes, for each line, its document, number and key, and, for each distinct masked line of a
       task, the line with the least ids of its documents (as many as make it recurring), so that a line in a third of all
       documents is a row per task.
    2. Lines of leaves that hold lines of enough documents (by a bitmap, which lets a few others through) are dealt by leaf. A
       leaf's distinct lines are clustered by one task, in their order, whatever tasks they come from; memory there is bound
       by the largest leaf.
    3. Recurring keys meet the lines' keys, and the line numbers their documents; the plan is the same at every size.

    Edge cases: null text stays null with 0 lines; an empty text is one empty line and is kept; a very long text is so many
    lines. Equal rows get equal results; rows with one id count as one document, rows with a null id as one for each text. Ties
    between templates go to the first in the order of the lines. An empty table gives no rows. Other columns are ignored,
    whatever their names.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    parts = materialise(_lines(docs, (min_docs, long_docs, long_tokens), max(1, min_tokens), depth), "lines")
    lines = parts.where("line is not null").select("leaf", "need", "line", "idents")
    full = lines.groupBy("leaf").agg(F.sum(F.size("idents")).alias("seen"), F.min("need").alias("need")).where("seen >= need")
    recurring = materialise(_cluster(maybe_in(lines, "leaf", full), similarity, depth), "recurring")
    places = maybe_in(parts.where("line is null").select("doc_id", "th", "at", "key"), "key", recurring)
    marked = places.join(recurring, "key").where(F.coalesce("doc_id", "th") != F.col("owner"))
    marked = materialise(marked.groupBy(F.col("doc_id").alias("m_id"), F.col("th").alias("m_th")).agg(F.collect_set("at").alias("drop")), "marked")
    discard(parts, recurring)
    joined = docs.join(marked.hint("merge"), docs.doc_id.eqNullSafe(F.col("m_id")) & (docs.th == F.col("m_th")), "left").select("doc_id", "text", "drop")
    return _rewrite(joined)


def _lines(docs: DataFrame, need: tuple[int, int, int], min_tokens: int, depth: int) -> DataFrame:
    """Rows (doc_id, th, at, key) of all lines, and (leaf, need, line, idents) of a task's distinct masked ones."""
    min_docs, long_docs, long_tokens = need

    def make():
        known: dict[str, tuple[int, int, bytes, set[int]]] = {}

        def flush():
            for line, (leaf, least, _, idents) in known.items():
                yield None, None, None, None, leaf, least, line, sorted(idents)
            known.clear()

        def each(c):
            for doc, th, text in zip(c["doc_id"], c["th"], c["text"], strict=True):
                ident = th if doc is None else doc
                for at, raw in enumerate(masked(text or "").split("\n")):
                    tokens = raw.split()
                    if len(tokens) < min_tokens:
                        continue
                    line = " ".join(tokens)
                    entry = known.get(line)
                    if entry is None:
                        entry = known[line] = leaf_of(tokens, depth), long_docs if len(tokens) >= long_tokens else min_docs, line_key(line), set()
                    idents = entry[3]
                    idents.add(ident)
                    if len(idents) > entry[1]:
                        idents.remove(max(idents))
                    yield doc, th, at, entry[2], None, None, None, None
                if len(known) >= GATHER:
                    yield from flush()

        each.close = flush
        return each

    return map_rows(docs, make, "doc_id long, th long, at int, key binary, leaf long, need int, line string, idents array<long>")


def _cluster(lines: DataFrame, similarity: float, depth: int) -> DataFrame:
    """Rows (key, owner) of the lines whose template recurs."""

    def make():
        state: dict = {"at": None, "leaf": None, "line": None, "need": 0}

        def put():
            if state["line"] is not None:
                state["leaf"].add(state["line"].split(" "), line_key(state["line"]), sorted(state["idents"])[: state["need"]], state["need"])
                state["line"] = None

        def flush():
            put()
            if state["leaf"] is not None:
                yield from state["leaf"].recurring(state["need"])
            state["leaf"] = None

        def each(c):
            for leaf, need, line, idents in zip(c["leaf"], c["need"], c["line"], c["idents"], strict=True):
                if leaf != state["at"]:
                    yield from flush()
                    state.update(at=leaf, leaf=Leaf(similarity, depth), need=need)
                if line != state["line"]:
                    put()
                    state.update(line=line, idents=set())
                state["idents"].update(idents)

        each.close = flush
        return each

    return map_rows(lines.repartition("leaf").sortWithinPartitions("leaf", "line"), make, "key binary, owner long")


def _rewrite(docs: DataFrame) -> DataFrame:
    def make():
        def each(c):
            for doc, text, drop in zip(c["doc_id"], c["text"], c["drop"], strict=True):
                if text is None or not drop:
                    yield doc, 0 if text is None else text.count("\n") + 1, 0, text
                    continue
                gone, lines = set(drop), text.split("\n")
                yield doc, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)

        return each

    return map_rows(docs, make, "doc_id long, n_lines long, n_dropped long, text string", flush=500)
