"""Compare registered queries with their SQL on one data folder: rows, columns, types and an order-free value digest."""
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from codestrata.catalog import bindings, registry  # noqa: E402
from codestrata.session import local_session  # noqa: E402


def canonical(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        cells = []
        for v in row:
            if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
                cells.append("~")
            elif isinstance(v, bool) or type(v).__name__ == "bool_":
                cells.append(str(bool(v)))
            elif isinstance(v, float):
                cells.append(repr(round(v, 6)) if v != int(v) else str(int(v)))
            else:
                cells.append(str(v))
        rows.append(tuple(cells))
    return sorted(rows)


def main() -> int:
    folder = os.environ.get("CHECK_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    engine = duckdb.connect()
    for name in bindings.TABLES:
        engine.sql(f"create view {name} as from '{folder}/{name}.parquet'")
    failed = 0
    for name, (call, sql) in registry.collect().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        started = time.time()
        try:
            got = call(spark, folder)
            left = got.toPandas()
            spent = time.time() - started
            if sql is None:
                print(f"rows-only {name} rows={len(left)} {spent:.1f}s", flush=True)
                continue
            t = time.time()
            right = engine.sql(sql).df()
            told = time.time() - t
            a, b = canonical(left), canonical(right)
            same = sorted(left.columns) == sorted(right.columns) and a == b
            types = {c: (str(left[c].dtype), str(right[c].dtype)) for c in left.columns
                     if c in right.columns and str(left[c].dtype) != str(right[c].dtype)}
            print(f"{'ok  ' if same and len(a) else 'FAIL'} {name} rows={len(a)}/{len(b)} {spent:.1f}s/{told:.1f}s {types or ''}", flush=True)
            if not same:
                failed += 1
                only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
                print("  columns", sorted(left.columns), sorted(right.columns), "\n  spark", only_a, "\n  sql  ", only_b)
        except Exception as error:
            failed += 1
            print(f"ERROR {name}: {str(error)[:1500]}")
            if not isinstance(error, duckdb.Error):
                traceback.print_exc(limit=-4)
    return failed


if __name__ == "__main__":
    sys.exit(main())
