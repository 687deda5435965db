"""Runs a query and its SQL side by side: `python tests/oracle.py NAME... [--sf DIR]`."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from collections import Counter

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings projects entities observations relations diag_operation diag_bucket runtime_sessions containers".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, dt.datetime):
        return x.astimezone(dt.timezone.utc).replace(tzinfo=None).isoformat() if x.tzinfo else x.isoformat()
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if hasattr(x, "quantize"):
        return float(x)
    return x


def connect(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, query, sql: str, sf: str) -> str:
    """'' if rows and columns are equal, else what differs."""
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got == want:
        return "" if got else "EMPTY"
    return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:2]}; only in SQL {list((want - got).items())[:2]}"


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}).getOrCreate()


if __name__ == "__main__":
    import __spark_entry__ as e

    args = sys.argv[1:]
    sf = args[args.index("--sf") + 1] if "--sf" in args else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("--") and a != sf] or list(e.queries())
    spark, con, sqls = session(), connect(sf), e.oracle_sql()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for n in names:
        t = time.time()
        try:
            said = compare(spark, con, n, e.queries()[n], sqls[n], sf) if n in sqls else f"rows only: {e.queries()[n](spark, sf).count()}"
        except Exception as x:  # noqa: BLE001
            said = f"ERROR {type(x).__name__}: {str(x)[:600]}"
        bad += bool(said) and not said.startswith("rows only")
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
    sys.exit(bool(bad))
