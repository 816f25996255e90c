"""Compare named queries with their DuckDB twins: ``python tests/oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(float(v))
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(cell(x) for x in v) + "]"
    if isinstance(v, dict):
        return cell(list(v.values()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, sf_dir: str):
    """(ok, message); ok is None for a query without a twin, which is only run."""
    df = entry.queries()[name](spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return None, f"no twin: {len(got[1])} rows"
    res = con.execute(sql)
    want = canonical([d[0] for d in res.description], res.fetchall())
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}"
    if got[1] != want[1]:
        a, b = set(got[1]), set(want[1])
        return False, (
            f"{len(got[1])} rows != {len(want[1])} rows\n  spark only {[t for t in sorted(a - b)[:2]]}"
            f"\n  duck only  {[t for t in sorted(b - a)[:2]]}"
        )
    return True, f"{len(got[1])} rows"


if __name__ == "__main__":
    from reviewlens.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = build_session("oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                                   "spark.ui.showConsoleProgress": "false",
                                                   "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = agree = 0
    for name in names:
        t0 = time.time()
        try:
            ok, message = compare(spark, duck(sf), name, sf)
        except Exception as e:  # report and go on
            ok, message = False, f"{type(e).__name__}: {str(e)[:900]}"
        bad += ok is False
        agree += ok is True
        print(f"{'ok ' if ok else '-  ' if ok is None else 'BAD'} {name:24} {time.time() - t0:6.1f}s  {message}", flush=True)
    print(f"{agree} agree, {bad} do not, {len(names) - agree - bad} without a twin")
    spark.stop()
