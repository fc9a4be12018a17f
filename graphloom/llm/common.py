"""What the training-data operators share: the shared scratch folder, tables and Arrow rows."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_LOCAL: dict[str, str] = {}
#: Of the thread that runs: pipelines beside each other don't see each other's tables.
_COLLECTING: ContextVar[tuple[list[str], ...]] = ContextVar("collecting", default=())
#: Rows, and bytes, of an Arrow batch on its way to Python: what a task holds of its texts outside the heap and in Python.
SLICE, SLICE_BYTES = 1000, 8 << 20
#: Bits of a broadcast bitmap (8 MB as rows).
SLOTS = 1 << 25


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session, or what ``setCheckpointDir`` set.

    Only where both are absent and all runs on one machine (tests) a temporary folder takes their place; on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not found and not spark.sparkContext.master.startswith(("local[", "local-cluster")) and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="graphloom-"))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for one table in the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    for paths in _COLLECTING.get():
        paths.append(path)
    return path


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of all tables that this thread writes in the block."""
    paths: list[str] = []
    token = _COLLECTING.set((*_COLLECTING.get(), paths))
    try:
        yield paths
    finally:
        _COLLECTING.reset(token)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables; one that isn't there is no error."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return a scan of it.

    This cuts the lineage: a lost executor costs at most the tasks that read the table, and row ids
    that a task has made are fixed from here on.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more: all that was made of them is written."""
    for table in tables:
        remove(table.sparkSession, table._scratch)


def settled(df: DataFrame, name: str, made: list[str]) -> DataFrame:
    """``materialise``, after which the tables ``made`` on the way to ``df``, which nobody else has seen, are deleted."""
    out = materialise(df, name)
    remove(df.sparkSession, *(path for path in made if path != out._scratch))
    return out


def fixed_rows(df: DataFrame) -> DataFrame:
    """``df`` as a reliable checkpoint in the shared folder, for tables as large as the corpus that a result still reads.

    Spark itself deletes it when nothing refers to it any more, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set;
    otherwise it stays.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def _bitmap(wanted: DataFrame, column: str) -> DataFrame:
    """``(_word, _bits)``: a bitmap of SLOTS bits by hash of the keys, at most ``SLOTS / 64`` rows of 16 bytes however many they are."""
    slot = F.pmod(F.xxhash64(column), F.lit(SLOTS))
    keys = wanted.where(F.col(column).isNotNull()).select(slot.alias("_slot"))
    return keys.groupBy(F.shiftright("_slot", 6).alias("_word")).agg(F.bit_or(_bit()).alias("_bits"))


def _bit() -> Column:
    return F.expr("shiftleft(1L, cast(_slot & 63 as int))")


def maybe_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` may be in the same column of ``wanted``: all that are, and a few more.

    A bitmap of bounded size is broadcast. It spares a join that follows the rows that surely have no partner; the more keys,
    the more others get through. Null keys go.
    """
    found = df.where(F.col(column).isNotNull()).withColumn("_slot", F.pmod(F.xxhash64(column), F.lit(SLOTS)))
    hit = (F.shiftright("_slot", 6) == F.col("_word")) & (F.col("_bits").bitwiseAND(_bit()) != 0)
    return found.join(F.broadcast(_bitmap(wanted, column)), hit, "left_semi").drop("_slot")


def without(df: DataFrame, column: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``column`` isn't in the same column of ``gone`` (null never is).

    Only rows that a bitmap of bounded size marks are shuffled for the anti-join; the others pass as they are read. Both
    are read more than once, so they should be tables.
    """
    columns = df.columns
    marked = df.withColumn("_slot", F.coalesce(F.pmod(F.xxhash64(F.col(column)), F.lit(SLOTS)), F.lit(-1)))
    marked = marked.join(F.broadcast(_bitmap(gone, column)), F.shiftright("_slot", 6) == F.col("_word"), "left")
    marked = marked.withColumn("_maybe", F.col(column).isNotNull() & (F.coalesce(F.col("_bits").bitwiseAND(_bit()), F.lit(0)) != 0))
    return marked.where(~F.col("_maybe")).select(*columns).unionByName(marked.where("_maybe").select(*columns).join(gone.select(column).hint("merge"), column, "left_anti").select(*columns))


def most_frequent(counts: DataFrame, most: int) -> list[Row]:
    """The rows of ``counts(..., n)`` with the largest ``n``, ``most`` at most: all from the least count on with which they fit.

    The limit is found from how many rows have each count, so tasks send no more to the driver than what is taken.
    """
    table = materialise(counts, "counts")
    least, taken = None, 0
    for n, rows in sorted((tuple(r) for r in table.groupBy("n").agg(F.count("*")).collect()), reverse=True):
        if taken + rows > most:
            break
        least, taken = n, taken + rows
    found = [] if least is None else table.where(F.col("n") >= least).collect()
    discard(table)
    return found


def small_batches(spark: SparkSession) -> None:
    """Let the session send texts to Python in small Arrow batches: SLICE rows or SLICE_BYTES, whichever is less.

    At the usual 10,000 rows a task's texts take hundreds of megabytes outside the heap, which the executor's pools keep.
    Results don't depend on it. A session whose batches are smaller keeps them.
    """
    for key, most in (("maxRecordsPerBatch", SLICE), ("maxBytesPerBatch", SLICE_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        try:
            now = spark.conf.get(name)
        except Exception:  # noqa: BLE001  another release without this setting
            continue
        if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= most):
            spark.conf.set(name, str(most))


def map_rows(
    df: DataFrame,
    make: Callable[[], Callable[[dict[str, list]], Iterable[tuple]]],
    schema: str | T.StructType,
    flush: int = 2000,
) -> DataFrame:
    """``mapInArrow`` for row-wise Python: ``make()`` runs once a task, what it returns on each SLICE rows of a batch.

    The inner function gets their columns as lists and yields output tuples; they leave in
    batches of ``flush`` rows, so that memory is bound by a batch and not by a partition.
    """
    small_batches(df.sparkSession)
    out_schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        rows: list[tuple] = []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                for row in each({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)}):
                    rows.append(row)
                    if len(rows) >= flush:
                        yield to_batch(rows, arrow)
                        rows = []
        last = getattr(each, "close", None)
        if last is not None:
            for row in last():
                rows.append(row)
                if len(rows) >= flush:
                    yield to_batch(rows, arrow)
                    rows = []
        if rows:
            yield to_batch(rows, arrow)
        del each, rows, last
        _give_back()

    return df.mapInArrow(run, out_schema)


def _give_back() -> None:
    """Free memory goes back to the system, as idle workers are kept."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def row_base() -> int:
    """First row id of this task: the partition's number in the upper bits."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33
