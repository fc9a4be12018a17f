"""Compare queries with their DuckDB oracles: ``python tests/oracle_check.py [SF_DIR] [NAME...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6)
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if hasattr(value, "item"):
        return plain(value.item())
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def rows(names: list[str], data) -> Counter:
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(plain(r[i]) for i in order) for r in data)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """Empty if equal, else what differs."""
    frame = query(spark, sf_dir)
    got = rows(frame.columns, [tuple(r) for r in frame.collect()])
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    want = rows(names, found.fetchall())
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} rows against {sum(want.values())}; only here {list((got - want).items())[:3]}; only there {list((want - got).items())[:3]}"
    return "" if got else "no rows"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("OFF")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in args or list(queries):
        began = time.time()
        try:
            said = compare(session, sf, queries[name], oracles[name]) if name in oracles else f"no oracle, {queries[name](session, sf).count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:600]}"
        print(f"{name}: {said or 'equal'} ({time.time() - began:.1f} s)", flush=True)
