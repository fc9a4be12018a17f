"""The retry ledger as a stateful stream, and incremental ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Values that a key keeps, attempts above which it is exhausted, and how long it is remembered.
TRAJECTORY, BUDGET, DAYS = 8, 3, 7
OUTPUT = "session string, path string, key string, attempts long, values array<double>, exhausted boolean, repaired boolean"


class RetryLedger(StatefulProcessor):
    """Y2: per (session, path): each run's findings extend their keys; a key that a run no longer has is repaired and forgotten.

    Input rows ``(session, path, run_id, key, value)``, a clean run being a row with null key. Runs of one batch are taken in
    the order of their ids.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.attempts = handle.getMapState("attempts", "key string", "count long, values array<double>", ttlDurationMs=DAYS * 86_400_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer_values: Any) -> Iterator[pd.DataFrame]:  # noqa: N802
        runs = pd.concat(list(rows), ignore_index=True)
        out = []
        for _, run in sorted(runs.groupby("run_id"), key=lambda x: x[0]):
            found = {k: float(v) for k, v in zip(run["key"], run["value"], strict=True) if k is not None and not pd.isna(k)}
            known = {k[0]: (int(v[0]), list(v[1])) for k, v in (self.attempts.iterator() if self.attempts.exists() else [])}
            for name in sorted(set(known) - set(found)):
                count, values = known[name]
                self.attempts.removeKey((name,))
                out.append((*key, name, count, values, False, True))
            for name, value in found.items():
                count, values = known.get(name, (0, []))
                count, values = count + 1, [*values, value][-TRAJECTORY:]
                self.attempts.updateValue((name,), (count, values))
                out.append((*key, name, count, values, count > BUDGET > 0, False))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def retry_ledger(events: DataFrame) -> DataFrame:
    """Y2-Y4 over a stream (needs the RocksDB state store).

    Keys expire by processing time, for which Spark runs batches without data again and again: a query that is to end
    (``availableNow``) needs ``spark.sql.streaming.noDataMicroBatches.enabled`` false.
    """
    return events.groupBy("session", "path").transformWithStateInPandas(RetryLedger(), OUTPUT, "Append", "ProcessingTime")


def ledger_at_once(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Y2, Y4, W6 over all runs at once, for keys that no run misses: attempts, the last TRAJECTORY values in order, exhausted.

    The same as the last row that ``RetryLedger`` tells of each key. Nulls in ``keys`` are a key of their own.
    """
    last = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = rows.withColumn("_r", F.row_number().over(last)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where(F.col("_r") <= TRAJECTORY)
    out = kept.groupBy(*keys).agg(F.max("_n").alias("attempts"), F.sort_array(F.collect_list(F.struct((-F.col("_r")).alias("r"), F.col(value).alias("v")))).alias("_vs"))
    return out.select(*keys, "attempts", F.transform("_vs", lambda x: x["v"]).alias("values"), ((F.col("attempts") > BUDGET) & F.lit(BUDGET > 0)).alias("exhausted"))


def trend(values: Column) -> Column:
    """Y2: a trajectory as ``27 -> 19 -> 19``, six digits a value; null values are left out, a null list gives null."""

    @F.pandas_udf("string")
    def told(lists: pd.Series) -> pd.Series:
        return lists.map(lambda vs: None if vs is None else " -> ".join(f"{v:g}" for v in vs if v is not None and v == v))

    return told(values)


def repair_records(ledger: DataFrame, at: Column | None = None) -> DataFrame:
    """Y2, K7: what ``RetryLedger`` tells of repaired keys as records (at, rule, attempts, values); the rule is the key up to its first ``|``."""
    when = F.current_timestamp() if at is None else at
    return ledger.where("repaired").select(when.alias("at"), F.substring_index("key", "|", 1).alias("rule"), "attempts", "values")


def log_repairs(ledger: DataFrame, folder: str, checkpoint: str, **trigger):
    """K7: append the repairs of a ledger stream to a folder of JSON lines, each once, also after a restart."""
    return repair_records(ledger).writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(**trigger).start()


def repairs_at_once(found: DataFrame, group: list[str]) -> DataFrame:
    """Y2, K7 over all runs at once: ``found(*group, run, key, value)``, a clean run having a null key, to the repairs that ``RetryLedger``
    tells: (*group, run, key, attempts, values), the run being the first without the key.

    Runs of a group are in the order of ``run``; sightings in runs that follow each other are one attempt each, and the last
    TRAJECTORY values are kept. Of repeated keys of a run the greatest value counts; nulls in ``group`` are a group; rows without a
    run are left out. Keys do not expire here. Windows sort a group's runs, and a key's.
    """
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    rows = found.where(F.col("run").isNotNull()).select(*group, "run", "key", F.col("value").cast("double").alias("value"))
    seen = rows.groupBy(*group, "run", "key").agg(F.max("value").alias("value"))
    numbered = seen.withColumn("_run", F.dense_rank().over(Window.partitionBy(*group).orderBy("run")))
    runs = numbered.select(*group, "run", "_run").distinct()
    keys = numbered.where(F.col("key").isNotNull())
    stretch = F.col("_run") - F.row_number().over(Window.partitionBy(*group, "key").orderBy("_run"))
    back = F.row_number().over(Window.partitionBy(*group, "key", "_stretch").orderBy(F.desc("_run")))
    told = keys.withColumn("_stretch", stretch).withColumn("_back", back)
    value = F.when(F.col("_back") <= TRAJECTORY, F.struct((-F.col("_back")).alias("r"), F.col("value").alias("v")))
    spells = told.groupBy(*group, "key", "_stretch").agg(F.max("_run").alias("_last"), F.count("*").alias("attempts"), F.sort_array(F.collect_list(value)).alias("_vs"))
    after = [F.col("s._last") + 1 == F.col("r._run"), *same("s", "r")]
    return spells.alias("s").join(runs.alias("r"), after).select(*[F.col(f"s.{c}") for c in group], "r.run", "s.key", "s.attempts", F.transform("s._vs", lambda x: x["v"]).alias("values"))


def work_list(scan: DataFrame, known: DataFrame) -> DataFrame:
    """Files of a scan whose (path, sha, version) isn't known yet."""
    return scan.join(known.select("path", "sha", "version"), ["path", "sha", "version"], "left_anti")


def freshness(scan: DataFrame, known: DataFrame, measured: DataFrame) -> DataFrame:
    """Each file as CURRENT, UNMEASURED (known, without a measurement) or STALE."""
    k = known.select("path", "sha", "version", F.lit(True).alias("_known"))
    m = measured.select("path").distinct().withColumn("_measured", F.lit(True))
    state = F.when(F.col("_known").isNull(), "STALE").when(F.col("_measured").isNull(), "UNMEASURED").otherwise("CURRENT")
    return scan.join(k, ["path", "sha", "version"], "left").join(m, "path", "left").withColumn("state", state).drop("_known", "_measured")


def gate_stream(payloads: DataFrame, gate: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]):
    """Run ``gate`` on every micro-batch of hook payloads (``payload`` JSON) and hand its findings to ``sink``."""
    path = F.coalesce(F.get_json_object("payload", "$.tool_input.file_path"), F.get_json_object("payload", "$.tool_input.notebook_path"))
    rows = payloads.select(F.get_json_object("payload", "$.session_id").alias("session"), path.alias("path"))
    return rows.writeStream.foreachBatch(lambda batch, n: sink(gate(batch), n))
