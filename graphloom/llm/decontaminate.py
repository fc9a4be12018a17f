"""Benchmark decontamination with a generalised suffix automaton over the words of the test items."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, materialise

#: A-Z to a-z, every other ASCII byte that isn't a letter or digit to a space, the rest kept.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_WORD = re.compile(rb"[^ ]+")
#: Words of test items in one automaton (about 400 bytes each on a worker); more items make more automata.
AUTOMATON_WORDS = 300_000


def fold(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the windows of every item marked in it.

    A window is ``window`` consecutive words of an item, or the whole of a shorter item. State ``v`` with
    match length ``l`` tells by ``top`` which state holds its last ``window`` words, and by ``short`` which
    shorter items end there.
    """

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(name, words) for name, words in items if words]
        coded = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items]
        for _, word_ids in coded:
            last = 0
            for c in word_ids:
                last = self._extend(last, c)
        self._mark(coded)

    def _new(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of length[p] + 1 for arc ``c``, cloned from ``q`` if it is longer."""
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = twin
            p = self.link[p]
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, c, self.next[p][c])
        return state

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        n = len(self.next)
        order = sorted(range(n), key=self.length.__getitem__)
        self.top = [-1] * n
        for v in order:
            if self.length[v] >= self.window:
                self.top[v] = v if self.length[self.link[v]] < self.window else self.top[self.link[v]]
        self.items: dict[int, set] = {}
        own: dict[int, list[tuple[int, str | None]]] = {}
        for name, ids in coded:
            v = 0
            for i, c in enumerate(ids, 1):
                v = self.next[v][c]
                if i >= self.window:
                    self.items.setdefault(self.top[v], set()).add(name)
            if len(ids) < self.window:
                while self.length[self.link[v]] >= len(ids):
                    v = self.link[v]
                own.setdefault(v, []).append((len(ids), name))
        self.short: list[tuple[tuple[int, str | None], ...]] = [()] * n
        for v in order[1:]:
            self.short[v] = self.short[self.link[v]] + tuple(own.get(v, ()))
        self.least = min([self.window, *(len(ids) for _, ids in coded)])

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit word ranges ``[first, last]`` (ascending, merged where they touch), item names, longest match."""
        arcs, link, length, window, short, top = self.next, self.link, self.length, self.window, self.short, self.top
        get = self.vocabulary.get
        ranges: list[tuple[int, int]] = []
        names: set = set()
        longest = v = l = 0
        for i, w in enumerate(words):
            c = get(w)
            if c is None:
                v = l = 0
                continue
            to = arcs[v].get(c)
            while to is None and v:
                v = link[v]
                l = length[v]
                to = arcs[v].get(c)
            if to is None:
                continue
            v = to
            l += 1
            if l > longest:
                longest = l
            first = i + 1
            if l >= window:
                first = i - window + 1
                names |= self.items[top[v]]
            if short[v]:
                for n, name in short[v]:
                    if n <= l:
                        first = min(first, i - n + 1)
                        names.add(name)
            if first <= i:
                while ranges and ranges[-1][1] >= first - 1:
                    first = min(first, ranges.pop()[0])
                ranges.append((first, i))
        return ranges, names, longest


def _automata(items: DataFrame, window: int) -> Iterator[SuffixAutomaton]:
    """Automata of at most AUTOMATON_WORDS words (one item at least), read from the items one by one."""
    some, size = [], 0
    for row in items.toLocalIterator():
        words = fold(row.text).split()
        if some and size + len(words) > AUTOMATON_WORDS:
            yield SuffixAutomaton(some, window)
            some, size = [], 0
        some.append((row.item_id, words))
        size += len(words)
    if some:
        yield SuffixAutomaton(some, window)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float | None = None, keep: tuple[str, ...] = (), with_text: bool = False) -> DataFrame:
    """Occurrences of benchmark items in ``docs(doc_id, text)``, streamed through a suffix automaton.

    Words are runs of ASCII letters and digits and non-ASCII characters, A-Z in lower case. A window is ``window``
    consecutive words of an item (an item with fewer words, but some, is one window); a document's
    word inside any occurrence of a window is hit. Returns for each row ``doc_id, n_words, n_hit,
    longest`` (longest match with any item, in words), ``item_ids`` (sorted strings), ``spans``
    (merged hit word ranges), the columns of ``keep`` and, with ``with_text``, ``clean_text`` (spans
    removed from the first to the last byte of their words; the text itself if nothing is hit) and
    ``over`` (coverage n_hit / n_words above ``max_coverage``).

    The automaton is built from the items on the driver in pieces of at most AUTOMATON_WORDS words, so what goes to a worker is
    bounded. With one piece the documents stream through it once and are never shuffled or written. With several they are
    written once with row ids and stream through each; only the hits are written and, by row, united and joined back.

    Edge cases: null text has no words and stays null; null or empty items mark nothing; an item with a
    null id marks words but is not listed; repeated item ids are listed once; repeated documents stay
    separate rows; a very long text is streamed word by word; no items or no documents give no hits or no rows. Columns that
    aren't kept are ignored, whatever their names.
    """
    texts = docs.select("doc_id", "text", *keep)
    named = {f.name: f for f in texts.schema.fields}
    found = "n_words long, n_hit long, longest long, item_ids array<string>, spans array<struct<first:int,last:int>>"
    schema = T.StructType([named["doc_id"], *T._parse_datatype_string(found).fields, *[named[k] for k in keep], *(T._parse_datatype_string("clean_text string, over boolean").fields if with_text else [])])
    limit = 1.0 if max_coverage is None else max_coverage

    def finished(doc: int | None, text: str | None, kept: tuple, words: list[bytes], ranges: list[tuple[int, int]], names: list[str], longest: int) -> tuple:
        hit = sum(b - a + 1 for a, b in ranges)
        tail = (cut(text, ranges), hit > len(words) * limit) if with_text else ()
        return (doc, len(words), hit, longest, names, [{"first": a, "last": b} for a, b in ranges], *kept, *tail)

    automata = _automata(items.select(F.col("item_id").cast("string").alias("item_id"), "text"), window)
    first, second = next(automata, None), next(automata, None)
    if second is None:
        shared = docs.sparkSession.sparkContext.broadcast(first or SuffixAutomaton([], window))

        def make():
            machine = shared.value

            def each(c):
                for doc, text, *kept in zip(c["doc_id"], c["text"], *(c[k] for k in keep), strict=True):
                    words = fold(text).split()
                    ranges, names, longest = machine.scan(words)
                    yield finished(doc, text, kept, words, ranges, sorted(names - {None}), longest)

            return each

        return map_rows(texts, make, schema, flush=500)

    numbered = materialise(texts.withColumn("_row", F.monotonically_increasing_id()), "numbered")
    hits = reduce(DataFrame.union, [materialise(_hits(numbered.select("_row", "text"), machine), "hits") for machine in chain((first, second), automata)])
    union = hits.groupBy("_row").agg(F.max("longest").alias("_longest"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("_ids"), F.flatten(F.collect_list("spans")).alias("_spans"))

    def unite():
        def each(c):
            for doc, text, ids, spans, longest, *kept in zip(c["doc_id"], c["text"], c["_ids"], c["_spans"], c["_longest"], *(c[k] for k in keep), strict=True):
                yield finished(doc, text, kept, fold(text).split(), merge([(s["first"], s["last"]) for s in spans or ()]), ids or [], longest or 0)

        return each

    return map_rows(numbered.join(union, "_row", "left").select("doc_id", "text", "_ids", "_spans", "_longest", *keep), unite, schema, flush=500)


def _hits(docs: DataFrame, automaton: SuffixAutomaton) -> DataFrame:
    """(_row, longest, item_ids, spans) of the rows that one automaton matches anywhere."""
    shared = docs.sparkSession.sparkContext.broadcast(automaton)

    def make():
        machine = shared.value

        def each(c):
            for row, text in zip(c["_row"], c["text"], strict=True):
                ranges, names, longest = machine.scan(fold(text).split())
                if longest:
                    yield row, longest, sorted(names - {None}), [{"first": a, "last": b} for a, b in ranges]

        return each

    return map_rows(docs, make, "_row long, longest long, item_ids array<string>, spans array<struct<first:int,last:int>>", flush=500)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and out[-1][1] >= first - 1:
            out[-1] = (out[-1][0], max(last, out[-1][1]))
        else:
            out.append((first, last))
    return out


def cut(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """``text`` without the bytes from each range's first word to its last."""
    if not ranges or text is None:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(fold(text))]
    parts, end = [], 0
    for first, last in ranges:
        parts.append(raw[end : at[first][0]])
        end = at[last][1]
    return b"".join([*parts, raw[end:]]).decode("utf-8", "surrogatepass")


def digest(ids: Column) -> Column:
    return F.sha2(F.concat_ws(",", ids), 256)
