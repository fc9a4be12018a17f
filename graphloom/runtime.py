"""Lineage cuts for iterative operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_folder(df: DataFrame) -> str:
    """``spark.checkpoint.dir`` of the session, or what ``setCheckpointDir`` set; a temporary folder only on one machine."""
    context = df.sparkSession.sparkContext
    found = df.sparkSession.conf.get("spark.checkpoint.dir", "") or context.getCheckpointDir() or ""
    if not found and context.master != "local" and not context.master.startswith(("local[", "local-cluster")):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return found or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="graphloom-"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and scanned again: survives lost executors, keeps plans short."""
    path = f"{shared_folder(df).rstrip('/')}/graphloom/round-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of ``checkpointed`` that nothing reads any more: what was made of them is written. Others are left alone."""
    for table in tables:
        path = getattr(table, "_table", None)
        if path:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def counted(df: DataFrame, what: Column | None = None) -> tuple[DataFrame, int]:
    """``checkpointed``, with the number of rows (of those that ``what`` holds for) counted as they are written, so that a
    round's stop test needs no job of its own."""
    seen = Observation()
    out = checkpointed(df.observe(seen, (F.count("*") if what is None else F.count_if(what)).alias("n")))
    return out, seen.get.get("n") or 0
