"""Retrieval and clones: BM25, token windows, duplication."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed

#: F1: an acronym, a capitalised word or a lower-case run.
#: Different query terms up to which documents' tokens are filtered by a list of them.
FEW_TERMS = 10_000
TOKEN = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"

#: Tokens of files whose equal windows become one row, and windows that are counted at a time.
CHUNK = 1 << 19
_RUN = ["path", "pos", "hi", "lo", "places", "paths"]


def tokens(text: Column) -> Column:
    """identifier-aware tokens in lower case; null gives null."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(t))


def idf(n: Column, df: Column) -> Column:
    """F2."""
    return F.log1p((n - df + 0.5) / (df + 0.5))


def saturation(tf: Column, length: Column, average: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """F3."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / average))


def bm25(docs: DataFrame, queries: DataFrame, limit: int | None = None) -> DataFrame:
    """``docs(id, text)`` ranked for ``queries(qid, text)``: (qid, id, score).

    A document without a shared term is absent; a term that the query repeats counts as often; ties go by the id as a
    string. Parts are added up as decimals of 18 places, so that no order of adding tells equal scores apart. Only postings of query
    terms are made: up to FEW_TERMS different ones are looked up in each document's tokens before these become rows, more are
    joined. A limit of 1,000 at most is taken in every task before a query's scores meet.
    """
    asked = queries.select("qid", F.explode(tokens(F.col("text"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
    sized = docs.select("id", tokens(F.col("text")).alias("ts")).select("id", "ts", F.size("ts").alias("length"))
    stats = sized.agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    terms = asked.select("term").distinct()
    few = [r.term for r in terms.limit(FEW_TERMS + 1).collect()]
    if len(few) > FEW_TERMS:
        rows = sized.select("id", "length", F.explode("ts").alias("term")).join(terms, "term")
    else:
        rows = sized.select("id", "length", F.explode(F.filter("ts", lambda t: t.isin(few))).alias("term"))
    postings = rows.groupBy("id", "length", "term").agg(F.count("*").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    scored = postings.join(df, "term").crossJoin(F.broadcast(stats)).join(asked, "term")
    part = F.col("times") * idf(F.col("n"), F.col("df")) * saturation(F.col("tf"), F.col("length"), F.col("average"))
    out = scored.groupBy("qid", "id").agg(F.sum(part.cast("decimal(38,18)")).cast("double").alias("score"))
    if limit is None:
        return out
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("id").cast("string"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _mixed(x: np.ndarray, y: np.ndarray, odd: int) -> np.ndarray:
    """One 64-bit value of two, every bit of which depends on every bit of both."""
    z = x * np.uint64(odd) + y
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(29))


def _rolled(tokens_: np.ndarray, k: int, odd: int) -> np.ndarray:
    """The hash of each ``k`` consecutive values, from those of 1, 2, 4, ... values: as many steps as ``k`` has bits."""
    out, width = tokens_[:0], 0
    power, step = tokens_, 1
    n = len(tokens_)
    while True:
        if k & step:
            room = n - width - step + 1
            out = _mixed(out[:room], power[width : width + room], odd) if width else power
            width += step
        if width == k:
            return out
        power = _mixed(power[: n - 2 * step + 1], power[step : n - step + 1], odd)
        step *= 2


def windows(docs: DataFrame, k: int = 50) -> DataFrame:
    """Every ``k``-token window of ``docs(path, tokens)``: (path, pos, hi, lo), two rolling hashes of the window.

    Tokens are hashed in two ways, 96 bits together, and windows to 128. Shorter and null token lists have no windows.
    """
    long = docs.where(F.size("tokens") >= k).select("path", F.transform("tokens", lambda t: F.xxhash64(t)).alias("x"), F.transform("tokens", lambda t: F.hash(t).cast("long")).alias("y"))
    schema = T.StructType([docs.schema["path"], *T._parse_datatype_string("pos int, hi long, lo long").fields])

    def slide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = batch.column("path")
            for i in range(batch.num_rows):
                x, y = (batch.column(c)[i].values.to_numpy().view(np.uint64) for c in ("x", "y"))
                hi, lo = _rolled(x, k, 0x9E3779B97F4A7C15), _rolled(_mixed(y, x, 3), k, 0xC2B2AE3D27D4EB4F)
                same = path.take(pa.array(np.full(len(hi), i)))
                yield pa.RecordBatch.from_arrays([same, pa.array(np.arange(len(hi), dtype=np.int32)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], names=["path", "pos", "hi", "lo"])

    return long.mapInArrow(slide, schema)


def _least_of(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    out, step = x, 1
    while step * 2 <= width:
        out, step = np.minimum(out[: len(out) - step], out[step:]), step * 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _groups(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Where groups of equal keys begin in ``order``."""
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return np.flatnonzero(fresh)


def _runs(k: int, most: int):
    """Batches of ``(path, x, y)``, lists of token lists, to runs of windows: (path, pos, hi, lo, places, paths), ``lo`` being those of consecutive windows.

    ``hi`` is the least hash of the shorter windows inside one, so that neighbours mostly share it. Equal windows of ``most`` tokens or
    so of files become one, at their least place.
    """
    inner = (k + 1) // 2

    def chunk(batch: pa.RecordBatch, rows: np.ndarray) -> pa.RecordBatch | None:
        his, los, docs, places_ = [], [], [], []
        path = batch.column("path")
        for i in rows:
            for x, y in zip(batch.column("x")[i].values, batch.column("y")[i].values, strict=True):
                x, y = (v.values.to_numpy().view(np.uint64) for v in (x, y))
                his.append(_least_of(_rolled(x, inner, 0x9E3779B97F4A7C15), k - inner + 1))
                los.append(_rolled(_mixed(y, x, 3), k, 0xC2B2AE3D27D4EB4F))
                docs.append(i)
                places_.append(np.arange(len(los[-1])))
        if not his:
            return None
        size = [len(v) for v in his]
        hi, lo, pos = np.concatenate(his), np.concatenate(los), np.concatenate(places_)
        text, doc = np.repeat(np.arange(len(size)), size), np.repeat(np.array(docs), size)
        rank = np.zeros(batch.num_rows, dtype=np.int64)
        rank[rows] = np.arange(len(rows))
        order = np.lexsort((pos, rank[doc], lo))
        first = _groups(order, lo, hi)
        fresh = np.zeros(len(order), dtype=np.int64)
        fresh[_groups(order, lo, hi, doc)] = 1
        kept, places, paths = order[first], np.diff(np.append(first, len(order))), np.add.reduceat(fresh, first)
        by = np.argsort(kept)
        kept, places, paths = kept[by], places[by], paths[by]
        begin = np.ones(len(kept), dtype=bool)
        begin[1:] = np.diff(kept) != 1
        for v in (hi[kept], text[kept], places, paths):
            begin[1:] |= v[1:] != v[:-1]
        begin = np.flatnonzero(begin)
        head = kept[begin]
        lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(kept)).astype(np.int32)), pa.array(lo[kept].view(np.int64)))
        return pa.RecordBatch.from_arrays([path.take(pa.array(doc[head])), pa.array(pos[head].astype(np.int32)), pa.array(hi[head].view(np.int64)), lists, pa.array(places[begin]), pa.array(paths[begin])], names=_RUN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pc.sort_indices(batch.column("path"), null_placement="at_start").to_numpy()
            ends = np.cumsum([sum(len(v) for v in batch.column("x")[i].values) for i in rows])
            begin = 0
            while begin < len(rows):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + most)))
                out = chunk(batch, rows[begin:end])
                if out is not None:
                    yield out
                begin = end

    return run


def _recurring(most: int):
    """Runs in order of ``hi``, path and pos to the windows of two places or more, a row each. Those of a ``hi`` of far more than ``most``
    windows come as they are counted so far, all of them, ``whole`` being false."""

    def counts(rows: pa.Table, whole: bool) -> pa.RecordBatch:
        lists = rows.column("lo").combine_chunks()
        size = pc.list_value_length(lists).to_numpy()
        lo, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(size)), size)
        pos = rows.column("pos").to_numpy()[row] + np.arange(len(lo)) - np.repeat(np.cumsum(size) - size, size)
        hi, places, paths = (rows.column(c).to_numpy()[row] for c in ("hi", "places", "paths"))
        order = np.lexsort((lo, hi))  # stable: the first of equal windows is the least
        first = _groups(order, lo, hi)
        places, paths, head = np.add.reduceat(places[order], first), np.add.reduceat(paths[order], first), order[first]
        if whole:
            some = places >= 2
            places, paths, head = places[some], paths[some], head[some]
        path = rows.column("path").combine_chunks().take(pa.array(row[head]))
        return pa.RecordBatch.from_arrays([path, pa.array(pos[head].astype(np.int32)), pa.array(hi[head]), pa.array(lo[head]), pa.array(places), pa.array(paths), pa.array(np.full(len(head), whole))], names=[*_RUN, "whole"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, torn = [], 0, None  # ``torn``: the hi that came in part

        def ready(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            begin = 0 if torn is None else int(np.searchsorted(rows.column("hi").to_numpy(), torn, side="right"))
            for part, whole in ((rows.slice(0, begin), False), (rows.slice(begin), True)):
                if part.num_rows:
                    yield counts(part, whole)

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
                yield counts(rows, False)
                rows, n, torn = rows.slice(rows.num_rows), 0, his[-1]
            held = rows.to_batches()
        if held:
            yield from ready(pa.Table.from_batches(held))

    return run


def repeated_windows(docs: DataFrame, k: int = 50) -> DataFrame:
    """Windows of ``docs(path, tokens)`` that stand in two places or more: (hi, lo, path, pos, places, paths) with their least place.

    A window is sent to where its ``hi`` goes, the least hash of the shorter windows inside it; neighbours mostly share that and go
    as one row of 8 bytes a window (``lo``), so that about a half of what a row a window takes is shuffled, once. Equal windows of some
    hundreds of files become one before, so a header of very many files is a row for so many; a ``hi`` of very many different windows
    streams through its task. The rows of a repeated path are taken together. Shorter and null token lists have no windows.
    """
    long = docs.where(F.size("tokens") >= k).select("path", F.transform("tokens", lambda t: F.xxhash64(t)).alias("x"), F.transform("tokens", lambda t: F.hash(t).cast("long")).alias("y"))
    single = long.select("path", F.array("x").alias("x"), F.array("y").alias("y"))
    again = docs.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.col("path").alias("_again"))
    if again.take(1):
        match = F.col("path").eqNullSafe(F.col("_again"))
        more = long.join(again, match, "left_semi").groupBy("path").agg(F.collect_list(F.struct("x", "y")).alias("t")).select("path", F.col("t.x").alias("x"), F.col("t.y").alias("y"))
        single = single.join(again, match, "left_anti").union(more)
    schema = T.StructType([docs.schema["path"], *T._parse_datatype_string("pos int, hi long, lo array<long>, places long, paths long").fields])
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * docs.rdd.getNumPartitions())
    runs = single.mapInArrow(_runs(k, CHUNK), schema).repartition(parts, "hi").sortWithinPartitions("hi", "path", "pos")
    found = checkpointed(runs.mapInArrow(_recurring(CHUNK), T.StructType([docs.schema["path"], *T._parse_datatype_string("pos int, hi long, lo long, places long, paths long, whole boolean").fields])))
    torn = found.where("not whole").groupBy("hi", "lo").agg(F.sum("places").alias("places"), F.sum("paths").alias("paths"), F.min(F.struct("path", "pos")).alias("at")).where("places >= 2")
    return found.where("whole").select("hi", "lo", "path", "pos", "places", "paths").union(torn.select("hi", "lo", "at.path", "at.pos", "places", "paths"))


def duplication(clones: DataFrame, total_tokens: int) -> DataFrame:
    """Tokens of all occurrences but one of each class, and their share."""
    per = clones.groupBy("class").agg(F.max("length").alias("length"), F.count("*").alias("n"))
    extra = F.sum(F.col("length") * (F.col("n") - 1))
    return per.agg(F.coalesce(extra, F.lit(0)).alias("duplicate_tokens"), (F.coalesce(extra, F.lit(0)) / F.lit(total_tokens)).alias("ratio"))


def duplicate_lines(clones: DataFrame) -> DataFrame:
    """Distinct lines of each path that lie in a clone."""
    return clones.select("path", F.explode(F.sequence("first_line", "last_line")).alias("line")).distinct().groupBy("path").agg(F.count("*").alias("lines"))


def halstead(operators: Column, operands: Column) -> dict[str, Column]:
    """measures from arrays of operators and operands."""
    n1, n2 = F.size(F.array_distinct(operators)), F.size(F.array_distinct(operands))
    big1, big2 = F.size(operators), F.size(operands)
    vocabulary, length = n1 + n2, big1 + big2
    volume = F.when(vocabulary > 0, length * F.log2(vocabulary)).otherwise(F.lit(0.0))
    difficulty = F.coalesce(F.try_divide(n1 * big2, 2 * n2), F.lit(0.0))
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": volume * difficulty}


def maintainability(volume: Column, complexity: Column, sloc: Column, comments: Column) -> dict[str, Column]:
    """F8: the base index, with comments (share of lines), and on a scale to 100 that isn't negative."""
    base = 171 - 5.2 * F.log(F.greatest(volume, F.lit(1.0))) - 0.23 * complexity - 16.2 * F.log(F.greatest(sloc, F.lit(1)))
    return {"mi": base, "mi_sei": base + 50 * F.sin(F.sqrt(2.4 * comments)), "mi_vs": F.greatest(F.lit(0.0), base * 100 / 171)}


def numerals(text: Column) -> Column:
    """Distinct numerals, without thousands separators and trailing zeros of a fraction."""
    found = F.regexp_extract_all(text, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    plain = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.replace(x, F.lit(","), F.lit("")), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    return F.array_distinct(plain)


def unquotable(text: Column, allowed: Column) -> Column:
    """numerals of the prose that aren't allowed, in order of appearance."""
    return F.array_except(numerals(text), allowed)
