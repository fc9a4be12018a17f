"""Clone classes: growth of repeated windows and greedy choice among them, spread over files and classes."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed, counted, release
from .text import CHUNK, _groups, _least_of, _mixed, _rolled

#: Pieces of the text beside a place that one round of growth compares.
PIECES = 32
#: Longest piece, so that no round asks for more than ``PIECES`` times as many tokens at a time.
LONGEST = 1 << 17
#: Bits of the broadcast bitmap of hashes (8 MB as rows).
SLOTS = 1 << 25
_CLASS = ["path0", "start0", "length"]


class Spans:
    """A union of half-open spans, kept as sorted disjoint ones."""

    def __init__(self) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []

    def meets(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end

    def add(self, start: int, end: int) -> None:
        i, j = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if i < j:
            start, end = min(start, self.starts[i]), max(end, self.ends[j - 1])
        self.starts[i:j], self.ends[i:j] = [start], [end]


def pieces(tokens: np.ndarray, size: int) -> np.ndarray:
    """A hash of each whole piece of ``size`` tokens, of ``PIECES`` at most, that depends on the order in the piece."""
    whole = min(PIECES, len(tokens) // size)
    salt = (np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(0xD6E8FEB86659FD93)
    mixed = (tokens[: whole * size].reshape(whole, size) ^ salt) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed ^ (mixed >> np.uint64(29))).sum(axis=1, dtype=np.uint64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files ``(z, hi, lo, n, forward, at, size)``, a token hash a token and the rest lists of one length, to (hi, lo, n, forward,
    size, hashes): those of the pieces after ``at``, or of those before it, going back."""
    for batch in batches:
        for i in range(batch.num_rows):
            col = lambda c: batch.column(c)[i].values  # noqa: B023, E731
            z = col("z").to_numpy().view(np.uint64)
            found = []
            for at, size, forward in zip(col("at").to_numpy(), col("size").to_numpy(), col("forward").to_numpy(zero_copy_only=False), strict=True):
                beside = z[at : at + PIECES * size] if forward else z[max(0, at - PIECES * size) : at][::-1]
                found.append(pieces(beside, int(size)))
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int32)
            hashes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*(col(c) for c in ("hi", "lo", "n", "forward", "size")), hashes], names=["hi", "lo", "n", "forward", "size", "hashes"])


def common_lengths(tokens: DataFrame, places: DataFrame, k: int) -> DataFrame:
    """How many tokens all places of a class have in common before, and after, their ``k`` tokens.

    ``tokens(path, z)``: a file's token hashes; ``places(hi, lo, n, path, pos)``: all ``n`` places of each class. Gives (hi, lo, back,
    ahead). A round compares 32 pieces beside all places of all classes at once; pieces grow sixteenfold while all agree, then
    the first that differs is cut in 32, so that L tokens take about ``log(L) / 2`` rounds. What is compared are least and greatest
    hashes of a class, combined before the shuffle; a task holds one file's tokens.
    """
    tokens = checkpointed(tokens.join(places.select("path").distinct(), "path", "left_semi"))
    both = F.explode(F.array(F.lit(False), F.lit(True))).alias("forward")
    state, left = counted(places.select("hi", "lo", "n").distinct().select("hi", "lo", "n", both, F.lit(0).cast("long").alias("done"), F.lit(2).cast("long").alias("size"), F.lit(True).alias("rising"), F.lit(True).alias("open")))
    while left:
        at = F.when(F.col("forward"), F.col("pos") + k + F.col("done")).otherwise(F.col("pos") - F.col("done"))
        asks = places.join(state.where("open").drop("n"), ["hi", "lo"]).groupBy("path").agg(F.collect_list(F.struct("hi", "lo", "n", "forward", at.alias("at"), "size")).alias("a"))
        rows = tokens.join(asks, "path").select("z", *(F.col(f"a.{c}").alias(c) for c in ("hi", "lo", "n", "forward", "at", "size")))
        hashed = rows.mapInArrow(_asked, "hi long, lo long, n long, forward boolean, size long, hashes array<long>")
        each = hashed.select("hi", "lo", "n", "forward", F.posexplode_outer("hashes").alias("j", "h"))
        same = each.groupBy("hi", "lo", "n", "forward", "j").agg((F.coalesce(F.min("h") == F.max("h"), F.lit(False)) & (F.count("h") == F.col("n"))).alias("same"))
        agreed = same.groupBy("hi", "lo", "forward").agg(F.coalesce(F.min(F.when(~F.col("same"), F.col("j"))), F.max("j") + 1, F.lit(0)).cast("long").alias("agreed"))
        all_ = F.col("agreed") == PIECES
        moved = state.join(agreed, ["hi", "lo", "forward"], "left").select(
            "hi", "lo", "n", "forward",
            (F.col("done") + F.coalesce("agreed", F.lit(0)) * F.col("size")).alias("done"),
            F.when(all_ & F.col("rising"), F.least(F.col("size") * 16, F.lit(LONGEST))).when(all_, F.col("size")).otherwise(F.greatest(F.lit(1), F.expr(f"size div {PIECES}"))).cast("long").alias("size"),
            (F.col("rising") & F.coalesce(all_, F.lit(False))).alias("rising"),
            (F.col("open") & (F.coalesce(all_, F.lit(False)) | (F.col("size") > 1))).alias("open"),
        )
        old = state
        state, left = counted(moved, F.col("open"))
        release(old)
    out = checkpointed(state.groupBy("hi", "lo").agg(F.max(F.when(~F.col("forward"), F.col("done"))).alias("back"), F.max(F.when(F.col("forward"), F.col("done"))).alias("ahead")))
    release(state, tokens)
    return out


def grown(places: DataFrame, tokens: DataFrame, k: int) -> DataFrame:
    """The classes that repeated windows grow to: (path0, start0, length, n, hi, lo, shift), each once.

    ``places(hi, lo, n, path, pos, length)`` are all ``n`` places, two at least, of each window and of those that all stand beside it up to
    ``length``. A class grows to the left, then to the right,
    while all its places agree, up to the smallest gap between two places in one file; a window with a gap below ``k`` doesn't
    grow and goes. Places start ``shift`` tokens before the row's; the least is (path0, start0). As a class's places are all
    those of its text, least place and length tell classes apart. Windows that all stand a token after those of another one
    with as many places share its growth, so that only the first of such a run is compared.
    """
    by_file = Window.partitionBy("path").orderBy("pos")
    before = F.lag(F.struct("hi", "lo", "n", "pos", "length")).over(by_file)
    near = places.withColumn("before", before).withColumn("before", F.when((F.col("before.pos") + F.col("before.length") == F.col("pos")) & (F.col("before.n") == F.col("n")), F.col("before")))
    near = near.withColumn("gap", F.col("pos") - F.lag("pos").over(Window.partitionBy("path", "hi", "lo").orderBy("pos")))
    one = lambda c: F.min(f"before.{c}") == F.max(f"before.{c}")
    classes = near.groupBy("hi", "lo", "n").agg(F.min("gap").alias("room"), F.min("length").alias("side"), F.min(F.struct("path", "pos")).alias("at"), F.coalesce((F.count("before") == F.col("n")) & one("hi") & one("lo"), F.lit(False)).alias("follows"))
    run = F.last(F.when(~F.col("follows"), F.struct("hi", "lo", "pos")), ignorenulls=True).over(Window.partitionBy("path0").orderBy("pos"))
    flat = classes.where(F.col("room").isNull() | (F.col("room") >= k)).select("hi", "lo", "n", "room", "side", "follows", F.col("at.path").alias("path0"), F.col("at.pos").alias("pos"))
    # a run without gaps in a file grows to one class, which its first window stands for
    flat = checkpointed(flat.withColumn("first", run).where(~F.col("follows") | F.col("room").isNotNull()))
    firsts = places.join(flat.where(~F.col("follows")).select("hi", "lo"), ["hi", "lo"], "left_semi")
    firsts = checkpointed(firsts)
    reach = common_lengths(tokens, firsts, k)
    on = reach.select(F.struct(F.col("hi"), F.col("lo")).alias("key"), "back", "ahead")
    beside = F.sequence(F.lit(0).cast("long"), F.when(F.col("room").isNull(), 0).otherwise(F.col("side") - 1).cast("long"))
    ways = flat.withColumn("j", F.explode(beside)).withColumn("pos", F.col("pos") + F.col("j")).withColumn("key", F.struct(F.col("first.hi").alias("hi"), F.col("first.lo").alias("lo"))).join(on, "key")
    after = F.col("pos") - F.col("first.pos")
    room = F.coalesce(F.col("room").cast("long"), F.lit(1 << 40)) - k
    ways = ways.withColumn("shift", F.least(F.col("back") + after, room)).withColumn("length", k + F.col("shift") + F.least(F.col("ahead") - after, room - F.col("shift")))
    best = F.min(F.struct("hi", "lo", "n", (F.col("shift") - F.col("j")).alias("shift")))
    out = checkpointed(ways.groupBy("path0", (F.col("pos") - F.col("shift")).alias("start0"), "length").agg(best.alias("w")).select(*_CLASS, "w.n", "w.hi", "w.lo", "w.shift"))
    release(flat, firsts, reach)
    return out


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences by file, first the taken ones, then by falling precedence: those that overlap no taken one, and whether one of
    higher precedence overlaps them. Rows that repeat one, as a repeated path makes them, count once."""
    here, last, taken, higher = None, None, Spans(), Spans()
    for batch in batches:
        free, blocked = [], []
        for row in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "length", "taken", *_CLASS)), strict=True):
            path, start, length, is_taken = row[:4]
            if path != here:
                here, taken, higher = path, Spans(), Spans()
            end = start + length
            if is_taken:
                taken.add(start, end)
            alive = not is_taken and row != last and not taken.meets(start, end)
            last = row
            free.append(alive)
            if alive:
                blocked.append(higher.meets(start, end))
                higher.add(start, end)
        left = batch.filter(pa.array(free, pa.bool_())).drop_columns(["taken"])
        yield left.append_column("blocked", pa.array(blocked, pa.bool_()))


def chosen(occurrences: DataFrame) -> DataFrame:
    """The occurrences that stay, with ``class``, the place of the first of them.

    ``occurrences(path0, start0, length, n, path, start, enough)``, others kept. The longest classes come first, then those of most places,
    then that of the least place; an occurrence that overlaps a chosen one goes, and a class stays whole if two or more are left
    and all of them are long ``enough``. A round decides every class that no undecided one of higher precedence overlaps: the
    first of all always, and usually most. A task walks one file's occurrences in order and holds their union.
    """
    schema = T.StructType([*(f for f in occurrences.schema.fields), T.StructField("blocked", T.BooleanType())])
    order = ["path", F.desc("taken"), F.desc("length"), F.desc("n"), "path0", "start0", "start"]
    live = checkpointed(occurrences.withColumn("taken", F.lit(False)))
    parts, made = [live.where("taken")], [live]
    while True:
        seen, left = counted(live.repartition("path").sortWithinPartitions(*order).mapInArrow(_walk, schema))
        if len(made) > 1:
            release(live)
        if not left:
            release(seen)
            break
        per = seen.groupBy(*_CLASS).agg(F.count("*").alias("_left"), F.bool_or("blocked").alias("_blocked"), F.bool_and("enough").alias("_enough"))
        verdict = per.withColumn("taken", ~F.col("_blocked") & (F.col("_left") >= 2) & F.col("_enough")).where("taken or _blocked and _left >= 2")
        live = checkpointed(seen.drop("blocked").join(verdict.select(*_CLASS, "taken"), _CLASS))
        release(seen)
        part = checkpointed(live.where("taken"))
        parts.append(part)
        made.append(part)
    stay = reduce(DataFrame.unionByName, parts).drop("taken")
    out = checkpointed(stay)
    release(*made)
    label = out.groupBy(*_CLASS).agg(F.min(F.struct("path", "start")).alias("_at"))
    return out.join(label, _CLASS).withColumn("class", F.concat(F.col("_at.path").cast("string"), F.lit(":"), F.col("_at.start").cast("string"))).drop("_at")


def _anchors(k: int):
    """Token hashes ``x`` of files to ``hi``, a row for each of their shorter runs of tokens that is the least inside some window. Equal
    windows have equal ones, at least two of them together."""
    inner = (k + 1) // 2
    width = k - inner + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("x"):
                short = _rolled(x.values.to_numpy().view(np.uint64), inner, 0x9E3779B97F4A7C15)
                pad = np.full(width - 1, np.iinfo(np.uint64).max)
                most = ~_least_of(np.concatenate([pad, ~_least_of(short, width), pad]), width)  # of the windows that a run lies in
                yield pa.RecordBatch.from_arrays([pa.array(short[short == most].view(np.int64))], names=["hi"])

    return run


def _window_runs(k: int):
    """Files ``(path, x, y)`` to ``(path, pos, hi, lo)``, runs of consecutive windows, ``lo`` their hashes, which have the least hash ``hi`` of
    shorter runs of tokens in common."""
    inner = (k + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path")
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("x", "y"))
                hi, lo = _least_of(_rolled(x, inner, 0x9E3779B97F4A7C15), k - inner + 1), _rolled(_mixed(y, x, 3), k, 0xC2B2AE3D27D4EB4F)
                begin = np.flatnonzero(np.append(True, hi[1:] != hi[:-1]))
                lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(lo)).astype(np.int32)), pa.array(lo.view(np.int64)))
                yield pa.RecordBatch.from_arrays([path.take(pa.array(np.full(len(begin), i))), pa.array(begin.astype(np.int32)), pa.array(hi[begin].view(np.int64)), lists], names=["path", "pos", "hi", "lo"])

    return run


def _class_runs(most: int):
    """Runs in order of ``hi`` to the places of windows that recur, (path, pos, hi, lo, n, length): where all ``n`` places of a window stand a
    token after those of one other, as many, it is counted in the ``length`` of that one's rows. A ``hi`` of far more than ``most``
    windows streams through as one row a window, without ``n``."""
    names = ["path", "pos", "hi", "lo", "n", "length"]

    def flat(rows: pa.Table) -> tuple[np.ndarray, ...]:
        lists = rows.column("lo").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        lo, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        return lo, row, rows.column("pos").to_numpy()[row] + np.arange(len(lo)) - np.repeat(np.cumsum(size) - size, size), rows.column("hi").to_numpy()[row]

    def batch_of(rows: pa.Table, row: np.ndarray, pos: np.ndarray, hi: np.ndarray, lo: np.ndarray, n: pa.Array, length: np.ndarray) -> pa.RecordBatch:
        path = rows.column("path").combine_chunks().take(pa.array(row))
        return pa.RecordBatch.from_arrays([path, pa.array(pos.astype(np.int64)), pa.array(hi), pa.array(lo), n, pa.array(length.astype(np.int64))], names=names)

    def torn_rows(rows: pa.Table) -> pa.RecordBatch:
        lo, row, pos, hi = flat(rows)
        return batch_of(rows, row, pos, hi, lo, pa.nulls(len(lo), pa.int64()), np.ones(len(lo)))

    def whole_rows(rows: pa.Table) -> pa.RecordBatch:
        lo, row, pos, hi = flat(rows)
        order = np.lexsort((lo, hi))
        first = _groups(order, lo, hi)
        size = np.diff(np.append(first, len(order)))
        n, own = np.empty(len(lo), dtype=np.int64), np.empty(len(lo), dtype=np.int64)
        n[order], own[order] = np.repeat(size, size), np.repeat(np.arange(len(first)), size)
        before = np.full(len(lo), -1)
        along = (row[1:] == row[:-1]) & (n[1:] == n[:-1])
        before[1:][along] = own[:-1][along]
        low, high = np.minimum.reduceat(before[order], first), np.maximum.reduceat(before[order], first)
        head = ~((low == high) & (low >= 0))[own]
        some = n >= 2
        at = np.flatnonzero(head & some)
        # a run ends where the next one begins, or a window that stands once
        length = np.diff(np.append(np.flatnonzero(head | ~some), len(lo)))[np.flatnonzero(some[np.flatnonzero(head | ~some)])]
        return batch_of(rows, row[at], pos[at], hi[at], lo[at], pa.array(n[at]), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, torn = [], 0, None  # ``torn``: the hi that came in part

        def ready(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            begin = 0 if torn is None else int(np.searchsorted(rows.column("hi").to_numpy(), torn, side="right"))
            if begin:
                yield torn_rows(rows.slice(0, begin))
            if begin < rows.num_rows:
                yield whole_rows(rows.slice(begin))

        for batch in batches:
            held.append(batch)
            n += len(batch.column("lo").flatten())
            if n < most:
                continue
            rows = pa.Table.from_batches(held)
            his = rows.column("hi").to_numpy()
            last = int(np.searchsorted(his, his[-1]))
            if last:
                yield from ready(rows.slice(0, last))
                rows, torn = rows.slice(last), None
            n = sum(len(c.flatten()) for c in rows.column("lo").chunks)
            if n >= 4 * most:
                yield torn_rows(rows)
                rows, n, torn = rows.slice(rows.num_rows), 0, his[-1]
            held = rows.to_batches()
        if held:
            yield from ready(pa.Table.from_batches(held))

    return run


def places_of_repeats(docs: DataFrame, k: int, most: int = CHUNK) -> DataFrame:
    """All places of windows that stand in two or more: (hi, lo, n, path, pos, length), a table; ``length`` windows from ``pos`` on that all
    stand side by side at all ``n`` places are one row each, by the first of them.

    A first pass counts the runs of half as many tokens that are the least inside some window, one in a dozen windows, eight bytes
    each; a bitmap of 8 MB at most says which stand once, so that no window with one recurs. The other windows are sent as runs
    with such a least one in common, 8 bytes a window, to where that goes, and counted there. A fuller bitmap lets more through and
    changes no result.
    """
    long = docs.where(F.size("tokens") >= k).select("path", F.transform("tokens", lambda t: F.xxhash64(t)).alias("x"), F.transform("tokens", lambda t: F.hash(t).cast("long")).alias("y"))
    again = long.select("x").mapInArrow(_anchors(k), "hi long").groupBy("hi").agg(F.count("*").alias("n")).where("n >= 2").select(F.pmod("hi", F.lit(SLOTS)).alias("slot"))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    bitmap = checkpointed(again.groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))
    maybe = (F.shiftright("slot", 6) == F.col("word")) & (F.col("bits").bitwiseAND(bit) != 0)
    schema = lambda ddl: T.StructType([docs.schema["path"], *T._parse_datatype_string(ddl).fields])
    runs = long.mapInArrow(_window_runs(k), schema("pos int, hi long, lo array<long>"))
    runs = runs.withColumn("slot", F.pmod("hi", F.lit(SLOTS))).join(F.broadcast(bitmap), maybe, "left_semi").drop("slot")
    twice = docs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select("path")
    if twice.take(1):
        one = runs.join(twice, "path", "left_semi").select("path", "pos", "hi", F.posexplode("lo").alias("i", "l")).groupBy("path", (F.col("pos") + F.col("i")).alias("pos")).agg(F.min(F.struct("hi", "l")).alias("w"))
        runs = runs.join(twice, "path", "left_anti").union(one.select("path", "pos", "w.hi", F.array("w.l")))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    met = runs.repartition(parts, "hi").sortWithinPartitions("hi", "path", "pos")
    found = checkpointed(met.mapInArrow(_class_runs(most), schema("pos long, hi long, lo long, n long, length long")))
    torn = found.where("n is null").drop("n")
    counts = torn.groupBy("hi", "lo").agg(F.count("*").alias("n")).where("n >= 2")
    columns = ["hi", "lo", "n", "path", "pos", "length"]
    places = found.where("n is not null").select(columns).union(torn.join(counts, ["hi", "lo"]).select(columns))
    release(bitmap)
    return places


def clones_of_files(docs: DataFrame, k: int = 50, min_lines: int = 4) -> DataFrame:
    """Clone classes of ``docs(path, tokens, lines)``, a row a file: (class, path, start, length, first_line, last_line).

    The places of a repeated window are grown together (``grown``), then classes are chosen greedily (``chosen``); an occurrence spans
    ``min_lines`` lines at least. Every step goes by window, class or file: no task holds more than one file's tokens, however
    many files share a window. ``lines`` holds each token's line. ``docs`` is read several times, so it should be a table or cheap to
    make of one. Rows without a path, and files of fewer than ``k`` tokens, give no rows; where rows repeat a path, one window counts at
    each position, and which of the rows it is from is not told.
    """
    docs = docs.where(F.col("path").isNotNull()).select("path", "tokens", "lines")
    places = places_of_repeats(docs, k)
    classes = grown(places, docs.select("path", F.transform("tokens", lambda t: F.xxhash64(t)).alias("z")), k)
    found = places.drop("length").join(classes.drop("n"), ["hi", "lo"]).select(*_CLASS, "n", "path", (F.col("pos") - F.col("shift")).alias("start"))
    at = lambda i: F.get("lines", i.cast("int"))
    lined = found.join(docs.select("path", "lines"), "path").select(*found.columns, at(F.col("start")).alias("first_line"), at(F.col("start") + F.col("length") - 1).alias("last_line"))
    out = chosen(lined.withColumn("enough", F.coalesce(F.col("last_line") - F.col("first_line") + 1 >= min_lines, F.lit(False))))
    release(classes)
    return out.select("class", "path", "start", "length", F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"))


def clone_classes(tokens_: DataFrame, k: int = 50, min_lines: int = 4) -> DataFrame:
    """``clones_of_files`` of ``tokens_(path, pos, norm, line)``, a row a token.

    Null tokens count as empty ones, null lines as line 0; rows without a path are left out; of equal ``pos`` in a file the order
    is by token, then line; an empty table gives no rows. Other columns are ignored.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("norm", F.lit("")).alias("norm"), F.coalesce(F.col("line").cast("long"), F.lit(0)).alias("line"))))
    files = tokens_.where(F.col("path").isNotNull()).groupBy("path").agg(ordered.alias("ts"))
    docs = checkpointed(files.select("path", F.transform("ts", lambda t: t["norm"]).alias("tokens"), F.transform("ts", lambda t: t["line"]).alias("lines")))
    out = clones_of_files(docs, k, min_lines)
    release(docs)
    return out
