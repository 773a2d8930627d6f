"""Run registered queries next to their SQL in DuckDB and report differences.

    python tools/compare.py [--sf FOLDER] [--time] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadloom.plans import catalog  # noqa: E402
from leadloom.plans.base import TABLES  # noqa: E402
from leadloom.session import build_session  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (int, bool)) or value is None:
        return value
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(normal(r[i]) for i in order) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    db = duckdb.connect()
    for name in TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{args.sf}/{name}.parquet'")
    bad = 0
    for name in args.names or catalog.QUERIES:
        start = time.time()
        try:
            df = catalog.QUERIES[name](spark, args.sf)
            got = table(df.columns, [tuple(r) for r in df.collect()])
        except Exception as error:  # report and go on with the next query
            print(f"ERROR {name}: {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        spent = time.time() - start
        if name not in catalog.ORACLES:
            print(f"rows  {name}: {len(got[1])} rows {spent:.2f}s", flush=True)
            continue
        try:
            cursor = db.execute(catalog.ORACLES[name])
            want = table([c[0] for c in cursor.description], cursor.fetchall())
        except Exception as error:
            print(f"SQL ERROR {name}: {str(error)[:800]}", flush=True)
            bad += 1
            continue
        if got == want:
            print(f"same  {name}: {len(got[1])} rows {spent:.2f}s", flush=True)
            continue
        bad += 1
        print(f"DIFF  {name}: spark {len(got[1])} sql {len(want[1])} rows", got[0], want[0] if want[0] != got[0] else "")
        mine, theirs = set(got[1]), set(want[1])
        for row in sorted(mine - theirs, key=str)[:3]:
            print("   spark only", row)
        for row in sorted(theirs - mine, key=str)[:3]:
            print("   sql only  ", row)
    print(f"{bad} problems")
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
