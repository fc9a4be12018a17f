"""Mixing sources to target weights by the cube method, in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Documents in one flight.
BLOCK = 4096
#: Smallest units of a source that wait for its landing, and units up to which a source has nothing but a landing.
RESERVE, FEW = 10, 16
SIZE = r"[^\x20\x09-\x0D]+"


def targets(sizes: dict[str | None, int], weights: tuple[float, ...], share: float, most: float) -> dict[str | None, float]:
    """Words to take from each source: ``share`` of all words by weight, none above ``most`` times its own.

    Sources go by code point, null last, and take the weights in turn. A source whose part is above its limit stops
    there; the rest is shared anew among the others by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out: dict[str | None, float] = {}
    left = share * sum(sizes.values())
    open_ = list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def flight(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """The cube method's flight: probabilities moved to 0 or 1 with the sums of ``p`` and ``p * size`` kept.

    Three open units at a time are moved along the null vector of their two constraints (documents, words) until
    one of them is settled; the side is drawn with the odds that keep each expectation. At most two are left open.
    """
    p = p.astype(float).tolist()
    size, draw = size.astype(float).tolist(), draw.tolist()
    unsettled: list[int] = []
    for i in range(len(p)):
        if not 1e-9 < p[i] < 1 - 1e-9:
            p[i] = float(round(p[i]))
            continue
        unsettled.append(i)
        if len(unsettled) < 3:
            continue
        a, b, c = unsettled
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        forward = min((1 - p[j]) / x if x > 0 else p[j] / -x for j, x in zip(unsettled, u, strict=True) if x)
        backward = min(p[j] / x if x > 0 else (1 - p[j]) / -x for j, x in zip(unsettled, u, strict=True) if x)
        step = forward if draw[i] * (forward + backward) < backward else -backward
        rest = []
        for j, x in zip(unsettled, u, strict=True):
            p[j] += step * x
            if p[j] < 1e-9 or p[j] > 1 - 1e-9:
                p[j] = float(round(p[j]))
            else:
                rest.append(j)
        unsettled = rest
    return np.array(p)


def spread(p: np.ndarray, size: np.ndarray, words: float, docs: float) -> np.ndarray | None:
    """``p`` moved so that its words rise by ``words`` and, if it can be, its documents by ``docs``; None if the words can't.

    Each probability moves in proportion to its variance, by an affine function of its size.
    """
    room = p * (1 - p)
    a, b, c = room.sum(), (room * size).sum(), (room * size * size).sum()
    if c <= 0:
        return None
    det = a * c - b * b
    tries = [(0.0, words / c)]
    if det > 1e-9 * max(a * c, 1e-300):
        tries.insert(0, ((docs * c - words * b) / det, (words * a - docs * b) / det))
    for shift, slope in tries:
        moved = p + room * (shift + slope * size)
        if moved.min() >= 0 and moved.max() <= 1:
            return moved
    return None


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last open units by trying every choice: the one whose words, then documents, come nearest to their sums."""
    open_ = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words = np.round(np.abs(choices @ size[open_] - p[open_] @ size[open_]), 6)
    docs = np.round(np.abs(choices.sum(axis=1) - p[open_].sum()), 6)
    out = p.copy()
    out[open_] = choices[np.lexsort((docs, words))[0]]
    return out


def settle(p: np.ndarray, size: np.ndarray, draw: np.ndarray, last: bool) -> np.ndarray:
    """Flights over units in descending order of size, one power of two after the other; at the end, if ``last``, the landing.

    The two units, at most, that a flight leaves open are drawn with their odds as soon as the smaller units can make up for
    what that changes (see ``spread``), else they fly on with the next ones. So what stays open is small. Without
    ``last``, two units at most stay open, and the sums of documents and words are as they were but for documents that could
    not be made up for; with it, the RESERVE smallest units with words (all, if they are FEW) don't fly but land with what is left.
    """
    p = np.where((p > 1e-9) & (p < 1 - 1e-9), p, np.round(p))
    size = size.astype(float)
    moving = np.flatnonzero((p > 0) & (p < 1))
    some = moving[size[moving] > 0]
    kept = some[:0] if not last else some if len(some) <= FEW else some[-RESERVE:]
    flying = np.setdiff1d(moving, kept)
    rank = np.frexp(size)[1]
    open_, docs_off = np.zeros(0, dtype=np.int64), 0.0
    cuts = np.flatnonzero(np.diff(rank[flying])) + 1
    for group in np.split(flying, cuts) if len(flying) else []:
        open_ = np.concatenate([open_, group])
        p[open_] = flight(p[open_], size[open_], draw[open_])
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
        rest = np.concatenate([flying[flying > group[-1]], kept])
        if not len(open_) or not len(rest):
            continue
        chosen = (draw[open_] * 7919 % 1 < p[open_]).astype(float)
        words, docs = float((p[open_] - chosen) @ size[open_]), float((p[open_] - chosen).sum()) + docs_off
        moved = spread(p[rest], size[rest], words, docs)
        if moved is not None:
            docs_off = docs - float((moved - p[rest]).sum())
            p[rest], p[open_] = moved, chosen
            open_ = open_[:0]
    return land(p, size) if last else p


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, most: float = 2.0, seed: int = 11, row_col: str | None = None) -> DataFrame:
    """Copies of each document in a mix of ``docs(doc_id, text, source)`` with target words for each source.

    Sizes are words between ASCII white space. A source with target ``t`` of ``s`` words takes each document
    ``t / s`` times: the whole part surely, the fraction by cube sampling that balances words and documents of the
    source. Flights run in blocks of about BLOCK documents of one source (by a hash of id and text); what each
    leaves open, two small documents at most, meets in the next level's blocks. A source lands when it is down to one block, which
    leaves about a dozen units to try all choices of. So a source with a third of all rows is many blocks, and a small
    one beside it lands with all its documents at hand. Returns ``doc_id, size, source, source_size, target, copies,
    taken``, and ``row_id`` where ``row_col`` names a column of row ids (long, once each), by which rows that have no id or share
    one can be told apart.

    Draws depend on ids, texts and the seed only: reruns agree, whatever the partitions. Edge cases: null text has size 0, an
    empty or very long one is a unit like any other (a source of few long documents can miss its target by half of the
    smallest one); null source is a source of its own, last; a source without words has target 0 and takes nothing; rows that
    repeat an id are units of their own (rows of one id, or none, and one text share a block); equal draws go by id, then row
    id; an empty table gives no rows; other columns are ignored, whatever their names. The driver holds one row per source.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SIZE)), F.lit(0)).cast("long")
    row = F.lit(None).cast("long") if row_col is None else F.col(row_col)
    unit = F.xxhash64("doc_id", "text").alias("unit")
    units = materialise(docs.select(row.alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), unit), "sizes")
    stats = {r.source: (r.s, r.n) for r in units.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()}
    goal = targets({s: x for s, (x, _) in stats.items()}, weights, share, most)
    plan = [(s, x, float(goal[s]), goal[s] / x if x else 0.0, n) for s, (x, n) in stats.items()]
    table = F.broadcast(spark.createDataFrame(plan, "src string, source_size long, target double, rate double, n long"))
    known = units.join(table, units.source.eqNullSafe(table.src)).drop("src")
    known = known.withColumn("whole", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    top = max((n for _, n in stats.values()), default=0)
    schema = "row_id long, source string, doc_id long, size long, unit long, p double, source_size long, target double, whole long, n long"

    def fly(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "draw", "doc_id", "row_id"], ascending=[False, True, True, True], kind="stable")
        pdf["p"] = settle(pdf["p"].to_numpy(), pdf["size"].to_numpy(), pdf["draw"].to_numpy(), last=pdf["n"].iloc[0] <= block_size)
        return pdf.drop(columns=["draw", "block"])

    block_size, level, done, here = BLOCK, 0, None, known.select(*[c.split()[0] for c in schema.split(", ")])
    while True:
        draw = (F.pmod(F.xxhash64("unit", "size", F.lit(seed + level)), F.lit(1 << 40)) / F.lit(float(1 << 40))).alias("draw")
        block = F.pmod(F.xxhash64("unit", F.lit(seed * 31 + level)), F.greatest(F.ceil(F.col("n") / F.lit(block_size)), F.lit(1))).alias("block")
        flown = materialise(here.select("*", draw, block).groupBy("source", "block").applyInPandas(fly, schema), "flight")
        if not level:
            discard(units)
        settled = flown.where("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        if top <= block_size:
            break
        here = flown.where("p > 0 and p < 1").withColumn("n", F.ceil(F.col("n") / F.lit(block_size)) * 2)
        top = math.ceil(top / block_size) * 2
        level += 1
    copies = (F.col("whole") + F.col("p")).cast("long")
    return done.select(*([] if row_col is None else ["row_id"]), "doc_id", "size", "source", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))
