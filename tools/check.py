"""Run registered queries in Spark and in DuckDB and compare the results.

usage: python tools/check.py [--sf DIR] [name-prefix ...]
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (decimal.Decimal, datetime.date)) and not isinstance(v, datetime.datetime):
        return f"!{type(v).__name__}:{v}"
    return f"{type(v).__name__}:{v}"


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(con, spark_df, sql: str) -> str:
    """Empty when equal, else a short description."""
    left = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    types = [str(d[1]) for d in cur.description]
    right = canonical([d[0] for d in cur.description], cur.fetchall())
    bad = [f"{d[0]}:{d[1]}" for d in cur.description if str(d[1]) in ("HUGEINT", "DATE") or "DECIMAL" in str(d[1])]
    if bad:
        return f"check SQL has awkward types {bad}"
    del types
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}: {left[1][:2]} / {right[1][:2]}"
    diff = [(a, b) for a, b in zip(left[1], right[1]) if a != b]
    return f"{len(diff)} rows differ, columns {left[0]}, first: {diff[0][0]} / {diff[0][1]}" if diff else ""


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("prefixes", nargs="*")
    args = ap.parse_args()
    from tidemill.plans.catalog import QUERIES
    from tidemill.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    failed = 0
    for name, q in QUERIES.items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        start = time.time()
        try:
            df = q(spark, args.sf)
            message = compare(con, df, q.sql) if q.sql else f"rows only: {df.count()}"
            ok = not message or message.startswith("rows only")
            n = ""
        except Exception as e:  # report and go on with the next query
            ok, message, n = False, f"{type(e).__name__}: {str(e)[:900]}", ""
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {n}{message}", flush=True)
    print(f"{failed} failed")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main())
