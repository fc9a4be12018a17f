"""Wall seconds of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS say where and on how many threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "risk_profile", "gini_by_segment", "file_history", "change_coupling", "ownership", "hotspots", "bus_factor", "ceiling_rule", "ratchet", "contract_layered",
    "trade_closure", "propagation_cost", "martin", "lcom", "bm25_rank", "clone_windows", "duplicate_lines", "innermost_interval", "attempt_ledger",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from graphloom import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.QUERIES["risk_profile"](spark, sf).write.format("noop").mode("overwrite").save()  # start-up isn't a query's time
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
