"""Seams: how a scope of files splits into lanes that can be worked on side by side.

Files are numbered in order of their names, and every set of files is an integer whose bits are file numbers, so that parts,
rings and cuts are a few shifts and masks. A scope is what one change touches; its graph is bounded by one hop around it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from fnmatch import fnmatch

#: Cross-lane imports for each lane, share of unresolved imports and share of the largest lane up to which a split pays.
MOST_CROSS, MOST_UNRESOLVED, MOST_IN_ONE = 2, 0.05, 0.8


def _numbers(mask: int) -> Iterator[int]:
    while mask:
        low = mask & -mask
        yield low.bit_length() - 1
        mask ^= low


def _union(rows: list[int], mask: int) -> int:
    out = 0
    for i in _numbers(mask):
        out |= rows[i]
    return out


class ScopeGraph:
    """The files of a scope and one hop about it without the commons, their imports, and the units that move as one."""

    def __init__(self, edges: Iterable[tuple[str, str]], scope: Iterable[str], commons: Iterable[str] = ()) -> None:
        scope, edges, commons = set(scope), set(edges), list(commons)
        about = {x for e in edges if scope & set(e) for x in e} | scope
        self.names = sorted(x for x in about if not any(fnmatch(x, g) for g in commons))
        at = {x: i for i, x in enumerate(self.names)}
        n = len(self.names)
        self.every = (1 << n) - 1
        self.scope = sum(1 << at[x] for x in scope & at.keys())
        self.imports, self.importers = [0] * n, [0] * n
        for a, b in edges:
            if a in at and b in at:
                self.imports[at[a]] |= 1 << at[b]
                self.importers[at[b]] |= 1 << at[a]
        reach = list(self.imports)
        for k in range(n):
            for i in range(n):
                if reach[i] >> k & 1:
                    reach[i] |= reach[k]
        back = [0] * n
        for i, row in enumerate(reach):
            for j in _numbers(row):
                back[j] |= 1 << i
        self.unit = [1 << i | reach[i] & back[i] for i in range(n)]
        self.in_ring = sum(1 << i for i in range(n) if self.unit[i].bit_count() > 1)
        packages: Counter[str] = Counter()
        for i, x in enumerate(self.names):
            if x.endswith(".go"):
                packages[x.rpartition("/")[0]] |= 1 << i
        for package in packages.values():  # the files of a Go package share one name space
            whole = _union(self.unit, package)
            while (more := _union(self.unit, whole)) != whole:
                whole = more
            for i in _numbers(whole):
                self.unit[i] = whole
        self.touch = [self.unit[i] | self.imports[i] | self.importers[i] for i in range(n)]

    def part(self, start: int, among: int) -> int:
        """All of ``among`` that the files ``start`` are joined with, through ``among`` alone."""
        seen = front = start & among
        while front:
            front = _union(self.touch, front) & among & ~seen
            seen |= front
        return seen

    def parts(self, among: int) -> list[int]:
        out = []
        while among:
            out.append(self.part(among & -among, among))
            among &= ~out[-1]
        return out

    def hubs(self) -> int:
        """Files of units whose importers no longer hang together once the unit is gone, until no more are found."""
        units = {mask: _union(self.importers, mask) & ~mask for mask in self.unit}
        gone = 0
        while True:
            found = 0
            for mask, users in units.items():
                rest = self.every & ~gone & ~mask
                users &= rest
                if not mask & gone and users and users & ~self.part(users & -users, rest):
                    found |= mask
            if not found:
                return gone
            gone |= found

    def fan_in(self, i: int) -> int:
        return (_union(self.importers, self.unit[i]) & ~self.unit[i]).bit_count()

    def crossings(self, a: int, b: int) -> int:
        """Imports from files of ``a`` to files of ``b``."""
        return sum((self.imports[i] & b).bit_count() for i in _numbers(a))


class Lanes:
    """Parts of the scope without its hubs; what is too small, or past the limit, is folded into a neighbour.

    A lane is known by its least file at the start. The smallest lane is folded first, into the one that it shares the most
    imports with, else into the one whose first file lies in the nearest folder; the least name breaks ties.
    """

    def __init__(self, graph: ScopeGraph, hubs: int) -> None:
        self.graph = graph
        self.files = {(m & -m).bit_length() - 1: m for m in graph.parts(graph.scope & ~hubs)}
        keys = list(self.files)
        self.shared = {a: Counter({b: n for b in keys if b != a and (n := graph.crossings(self.files[a], self.files[b]) + graph.crossings(self.files[b], self.files[a]))}) for a in keys}

    def _near(self, a: int, b: int) -> int:
        """Leading folders that the first files of two lanes have in common."""
        one, two = (self.graph.names[next(_numbers(self.files[k]))].split("/")[:-1] or [""] for k in (a, b))
        n = 0
        while n < min(len(one), len(two)) and one[n] == two[n]:
            n += 1
        return n

    def _fold(self, lane: int, into: int) -> None:
        self.files[into] |= self.files.pop(lane)
        for other, n in self.shared.pop(lane).items():
            del self.shared[other][lane]
            if other != into:
                self.shared[into][other] += n
                self.shared[other][into] += n

    def settle(self, at_most: int, at_least: int) -> None:
        while len(self.files) > 1:
            lane = min(self.files, key=lambda k: (self.files[k].bit_count(), k))
            if len(self.files) <= max(at_most, 1) and self.files[lane].bit_count() >= at_least:
                return
            others = self.shared[lane] or {k: self._near(lane, k) for k in self.files if k != lane}
            self._fold(lane, min(others, key=lambda k: (-others[k], k)))


def _globs(names: list[str], owner: dict[str, int | None], lane: int) -> list[str]:
    """The top-most folders that hold nothing but this lane's files, and its files elsewhere, by a walk down the folders."""
    out = []

    def walk(folder: str, inside: list[str]) -> None:
        if folder and all(owner[x] == lane for x in inside):
            out.append(folder + "**")
            return
        below: dict[str, list[str]] = {}
        for x in inside:
            head, slash, _ = x[len(folder) :].partition("/")
            if slash:
                below.setdefault(folder + head + "/", []).append(x)
            elif owner[x] == lane:
                out.append(x)
        for sub, files in below.items():
            walk(sub, files)

    walk("", names)
    return sorted(out)


def _lane_names(groups: list[list[str]]) -> list[str]:
    """Each group's deepest common folder, ``lane`` if that is the root, numbered from the second of a name on."""
    out, used = [], Counter()
    for files in groups:
        folders = [x.split("/")[:-1] for x in files]
        depth = 0
        while all(len(f) > depth for f in folders) and len({f[depth] for f in folders}) == 1:
            depth += 1
        base = folders[0][depth - 1] if depth else "lane"
        name = base
        while name in out:
            used[base] += 1
            name = f"{base}-{used[base] + 1}"
        out.append(name)
    return out


def seam(edges: Iterable[tuple[str, str]], scope: Iterable[str], commons: Iterable[str] = (), lanes_max: int = 8, min_lane: int = 3, unresolved_share: float = 0.0, unparsed: Iterable[str] = ()) -> dict:
    """The split of ``scope`` under the import ``edges``: lanes, contracts, hubs and what speaks against it.

    Contracts (G31) are the scope's hubs and every file that another lane imports. Each objection (G32) makes the verdict
    ``solo``. The answer depends on the input's sets only; an empty scope has no lanes and is ``solo``.
    """
    graph = ScopeGraph(edges, scope, commons)
    hubs = graph.hubs()
    lanes = Lanes(graph, hubs)
    lanes.settle(lanes_max, min_lane)
    contracts = {graph.names[i]: "hub" for i in _numbers(hubs & graph.scope)}
    cross = 0
    for mask in lanes.files.values():
        foreign = sum(lanes.files.values()) & ~mask
        for i in _numbers(mask):
            cross += (graph.imports[i] & foreign).bit_count()
    where = {graph.names[i]: k for k, mask in lanes.files.items() for i in _numbers(mask)}
    for i, x in enumerate(graph.names):
        for j in _numbers(graph.imports[i]):
            y = graph.names[j]
            if x in where and y in where and where[x] != where[y]:
                contracts.setdefault(y, f"{x} imports it from another lane")
    groups = sorted([[x for i in _numbers(mask) if (x := graph.names[i]) not in contracts], k] for k, mask in lanes.files.items())
    groups = [(files, k) for files, k in groups if files]
    owner = {x: None if x in contracts else k for x, k in where.items()}
    held = sorted(owner)
    named = _lane_names([files for files, _ in groups])
    sizes = [len(files) for files, _ in groups]
    skipped = sorted(unparsed)
    objections = {
        f"lanes: {len(groups)}, a split needs 2": len(groups) < 2,
        f"{cross} imports run between {len(groups)} lanes, {MOST_CROSS} a lane at most": bool(groups) and cross > MOST_CROSS * len(groups),
        "a hub belongs to an import ring": bool(hubs & graph.in_ring),
        f"files of the scope that nothing parses: {', '.join(skipped)}": bool(skipped),
        f"{unresolved_share:.1%} of the imports lead nowhere, {MOST_UNRESOLVED:.0%} at most": unresolved_share > MOST_UNRESOLVED,
        f"one lane has {max(sizes, default=0) / max(sum(sizes), 1):.0%} of the files, {MOST_IN_ONE:.0%} at most": len(sizes) > 1 and max(sizes) > MOST_IN_ONE * sum(sizes),
    }
    reasons = [text for text, holds in objections.items() if holds]
    return {
        "v": 1,
        "verdict": "solo" if reasons else "fan_out",
        "reasons": reasons,
        "lanes": [{"name": name, "globs": _globs(held, owner, k), "files": files, "depends_on": ["contract"] * bool(contracts)} for name, (files, k) in zip(named, groups, strict=True)],
        "contracts": sorted(contracts.items()),
        "hubs": sorted((graph.names[i], graph.fan_in(i)) for i in _numbers(hubs)),
        "cross_lane_edges": cross,
    }
