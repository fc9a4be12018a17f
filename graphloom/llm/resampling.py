"""Target-distribution importance resampling over hashed word runs, by a vectorised byte automaton."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, _give_back, materialise, small_batches

#: Words whose CRCs advance together (what a task holds beside its texts), and bytes of a word after which it goes on alone.
LANES, LONG = 1 << 18, 48
_ALL = 0xFFFFFFFF


def _crc_table() -> np.ndarray:
    """The reflected CRC-32 of each byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


_BYTES = np.arange(256)
#: Each byte with A-Z in lower case, and whether it belongs to words: 0-9, letters, and all beyond ASCII.
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
IN_WORD = ((_BYTES >= 48) & (_BYTES <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_BYTES >= 128)
CRC = _crc_table()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them, as the buffers hold them; nulls are empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, dtype=np.uint8)
    return held, at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words: where the class of a byte differs from its neighbour's, or a row's end lies between them."""
    inside = IN_WORD[data]
    begins = np.diff(inside, prepend=False) & inside
    ends = np.diff(inside, append=False) & inside
    edges = offsets[1:-1]
    cut = edges[(edges > 0) & (edges < len(data))]
    begins[cut] = inside[cut]
    ends[cut - 1] = inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, side="right") - 1


def advance(states: np.ndarray, lower: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC states after each lane's bytes: all lanes take a byte in each step; a lane of over LONG bytes ends alone."""
    order = np.argsort(-lengths, kind="stable")
    out, at, left = states[order], starts[order], lengths[order]
    going = np.searchsorted(-left, -np.arange(min(LONG, int(left[0]) if len(left) else 0)), side="left")  # lanes of more than k bytes
    for k, n in enumerate(going.tolist()):
        out[:n] = CRC[(out[:n] ^ lower[at[:n] + k]) & 255] ^ (out[:n] >> 8)
    for i in range(int(np.searchsorted(-left, -LONG, side="left"))):
        rest = lower[at[i] + LONG : at[i] + left[i]].tobytes()
        out[i] = zlib.crc32(rest, int(out[i]) ^ _ALL) ^ _ALL
    back = np.empty_like(out)
    back[order] = out
    return back


def run_buckets(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, buckets)`` of all runs of 1 to ``longest`` words, a block of LANES first words at a time."""
    starts, ends, rows = word_bounds(data, offsets)
    lower, lengths, n = LOWER[data], ends - starts, len(starts)
    for low in range(0, n, LANES):
        lane = np.arange(low, min(low + LANES, n))
        states = np.full(len(lane), _ALL, dtype=np.uint32)
        for k in range(longest):
            if k:
                more = (lane + k < n) & (rows[np.minimum(lane + k, n - 1)] == rows[lane])
                lane, states = lane[more], states[more]
                states = CRC[(states ^ np.uint32(32)) & 255] ^ (states >> 8)
            if not len(lane):
                break
            states = advance(states, lower, starts[lane + k], lengths[lane + k])
            yield rows[lane], ((states ^ np.uint32(_ALL)) % np.uint32(buckets)).astype(np.int64)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            part = batch.slice(start, SLICE)
            yield part, *text_bytes(part.column("text"))


def bucket_counts(texts: DataFrame, longest: int = 3, buckets: int = 10_000) -> DataFrame:
    """``bucket, n``: features of all whole texts by bucket. A task sums them first and sends a row for each bucket at most."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for _, data, offsets in _slices(batches):
            for _, found in run_buckets(data, offsets, longest, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])
        _give_back()

    return texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """``floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets))))`` of each bucket from two tables of counts, which have ``buckets`` rows at most."""
    s, t = np.zeros(buckets), np.zeros(buckets)
    for table, into in ((source, s), (target, t)):
        for row in table.collect():
            into[row.bucket] = row.n
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, longest: int = 3, buckets: int = 10_000, seed: str = "42") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of each document, towards the texts of ``target``.

    1. Both tables' features are counted by bucket, in bytes as Arrow brings them: a lookup table classifies them, differences
       bound the words, and the CRCs of all words (then of all runs of two, then of three) advance a byte in each step.
    2. The gains of the buckets, a table of ``buckets`` numbers, go to every task; a second pass over the texts sums them.
    3. Of the N documents with ``least_words`` words, ``percent * N // 100`` are drawn by Gumbel noise from their ids: rows are
       dealt by ranges of (score, id) and numbered inside; one number a range reaches the driver.

    Edge cases: a null or empty text has no words, weight 0 and no rank; a null id hashes as an empty one and comes last among
    ties; repeated rows are rows of their own, equal ones in any order; a very long text takes its bytes and 24 more a word; no
    documents give no rows, no target texts give gains all the same (T = 0). Other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    gains = spark.sparkContext.broadcast(bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets), buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = gains.value
        for part, data, offsets in _slices(batches):
            n = part.num_rows
            words, features, weight = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
            for rows, found in run_buckets(data, offsets, longest, buckets):
                features += np.bincount(rows, minlength=n)
                sums = np.concatenate([[0], np.cumsum(gain[found])])  # rows ascend
                first = np.searchsorted(rows, np.arange(n + 1))
                weight += sums[first[1:]] - sums[first[:-1]]
            _, _, of = word_bounds(data, offsets)
            words += np.bincount(of, minlength=n)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(words), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])
        _give_back()

    weighed = docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialise(weighed.withColumn("score", F.col("weight") + noise).withColumn("uid", F.monotonically_increasing_id()), "weighed")
    enough = F.col("n_words") >= least_words
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("weight"), F.col("n_features"), F.col("uid"))
    dealt = scored.where(enough).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    dealt = materialise(dealt, "ranked")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = {r.part: r.n for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    drawn, before, rows = percent * sum(sizes.values()) // 100, 0, []
    for p in sorted(sizes):
        rows.append((p, before))
        before += sizes[p]
    base = spark.createDataFrame(rows, "part long, before long")  # a row for each partition
    rank = F.col("before") + place + 1
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    out = dealt.withColumn("part", part).join(F.broadcast(base), "part").select(*columns, F.when(rank <= drawn, rank).alias("rank"))
    return out.unionByName(scored.where(~enough).select(*columns, F.lit(None).cast("long").alias("rank")))
