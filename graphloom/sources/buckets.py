"""A table in buckets by path, with versioned manifests (K1, K5, Q2, Q3).

``root/data/<write>/_bucket_=<n>/`` holds rows; ``root/versions/<v>.json`` names the folder of each bucket of a version. A write makes new
folders for the buckets it touches and then one manifest; other buckets keep their folders and files. A reader takes one manifest,
so it sees one version, whole, whatever is written beside it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import checkpointed, release
from .store import prune, replace_paths

BUCKET = "_bucket_"
#: Buckets of a table at most: as many numbers reach the driver, and as many folders a manifest names.
MOST = 4096


class VersionTaken(RuntimeError):
    """Another writer has committed the version; read again and repeat the write."""


def _path(spark: SparkSession, at: str):
    return spark._jvm.org.apache.hadoop.fs.Path(at)


def _names(spark: SparkSession, folder: str) -> list[str]:
    at = _path(spark, folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, ascending."""
    return sorted(int(n.removesuffix(".json")) for n in _names(spark, f"{root}/versions") if n.endswith(".json") and n[0].isdigit())


def _manifest(spark: SparkSession, root: str, version: int | None) -> tuple[int, dict]:
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"no version {'' if version is None else version} of a table in {root}")
    found = known[-1] if version is None else version
    return found, json.loads(spark.read.option("wholetext", True).text(f"{root}/versions/{found:08d}.json").first()[0])


def _commit(spark: SparkSession, root: str, version: int, manifest: dict) -> int:
    """Write the manifest beside its place, then move it there, which fails where it exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft, final = _path(spark, f"{root}/versions/_{uuid.uuid4().hex}"), _path(spark, f"{root}/versions/{version:08d}.json")
    fs = final.getFileSystem(conf)
    out = fs.create(draft)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    no_options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(final), no_options)
    except Exception as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e):
            raise VersionTaken(f"version {version} of {root}") from e
        raise
    return version


def _dealt(df: DataFrame, path: str, buckets: int) -> DataFrame:
    return df.withColumn(BUCKET, F.pmod(F.xxhash64(path), F.lit(buckets)).cast("int"))


def _written(df: DataFrame, root: str) -> dict[str, str]:
    """Rows with their bucket as new folders, of those buckets that have any; large buckets are split among tasks, small ones share one."""
    at = f"data/{uuid.uuid4().hex}"
    df.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{root}/{at}")
    return {n.split("=")[1]: f"{at}/{n}" for n in _names(df.sparkSession, f"{root}/{at}") if n.startswith(f"{BUCKET}=")}


def create(df: DataFrame, root: str, path: str = "path", buckets: int = 64) -> int:
    """Version 0 of a table: ``df`` in ``buckets`` by the hash of ``path``. A null path has a bucket too; an empty table has none.
    A table that is there already is an error."""
    if not 0 < buckets <= MOST or BUCKET in df.columns:
        raise ValueError(f"1 to {MOST} buckets, and no column {BUCKET}")
    manifest = {"path": path, "buckets": buckets, "schema": df.schema.jsonValue(), "folders": _written(_dealt(df, path, buckets), root)}
    return _commit(df.sparkSession, root, 0, manifest)


def read(spark: SparkSession, root: str, version: int | None = None, only: list[str] | None = None) -> DataFrame:
    """A version (the last one) of a table, or some of its buckets."""
    _, manifest = _manifest(spark, root, version)
    return _read(spark, root, manifest, only)


def _read(spark: SparkSession, root: str, manifest: dict, only: list[str] | None) -> DataFrame:
    schema = T.StructType.fromJson(manifest["schema"])
    folders = [f"{root}/{f}" for b, f in sorted(manifest["folders"].items()) if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def replace(new: DataFrame, root: str) -> int:
    """K1-K4: the next version, in which all rows of the paths that ``new`` has are its rows (``store.replace_paths``). Only the
    buckets of these paths are read and written. Columns go by name and take the table's types; without rows nothing changes but the
    version."""
    spark = new.sparkSession
    last, manifest = _manifest(spark, root, None)
    schema, path, n = T.StructType.fromJson(manifest["schema"]), manifest["path"], manifest["buckets"]
    rows = checkpointed(new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields]))
    touched = [str(r[0]) for r in _dealt(rows, path, n).select(BUCKET).distinct().collect()]
    folders = {b: f for b, f in manifest["folders"].items() if b not in touched}
    if touched:
        folders |= _written(_dealt(replace_paths(_read(spark, root, manifest, touched), rows, path), path, n), root)
    release(rows)
    return _commit(spark, root, last + 1, manifest | {"folders": folders})


def prune_unseen(seen: DataFrame, root: str) -> int:
    """K5: the next version, without the paths that ``seen`` lacks (``store.prune``). Only buckets that lose a path are written."""
    spark = seen.sparkSession
    last, manifest = _manifest(spark, root, None)
    path, n = manifest["path"], manifest["buckets"]
    there = _read(spark, root, manifest, None)
    gone = there.join(seen.select(path), path, "left_anti")
    touched = [str(r[0]) for r in _dealt(gone.select(path), path, n).select(BUCKET).distinct().collect()]
    folders = {b: f for b, f in manifest["folders"].items() if b not in touched}
    if touched:
        folders |= _written(_dealt(prune(_read(spark, root, manifest, touched), seen, path), path, n), root)
    return _commit(spark, root, last + 1, manifest | {"folders": folders})
