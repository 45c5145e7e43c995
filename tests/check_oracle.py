"""Compare every registered query with its SQL in DuckDB: ``python tests/check_oracle.py [sf] [name..]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from scrubline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(
        [tuple(row[i] for i in order) for row in rows],
        key=lambda r: tuple((v is not None, str(type(v)), str(v)) for v in r),
    )


def compare(spark, con, name, folder, sql):
    began = time.time()
    df = entry.queries()[name](spark, folder)
    ours = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return f"rows only ({len(ours)})", took
    done = con.execute(sql)
    names = [d[0] for d in done.description]
    theirs = done.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(names)}", took
    a, b = normal(ours, df.columns), normal(theirs, names)
    if len(a) != len(b):
        return f"COUNT {len(a)} vs {len(b)}", took
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    if bad:
        return f"VALUES {len(bad)} of {len(a)}: {str(bad[:2])[:700]}", took
    return f"ok ({len(a)})", took


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    spark = build_session(
        "check", spark__master="local[8]", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions="8", spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        try:
            result, took = compare(spark, con, name, folder, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            result, took = f"ERROR {type(e).__name__} {str(e)[:600]}", 0
        failed += not result.startswith(("ok", "rows"))
        print(f"{name:30s} {took:6.2f}s {result}", flush=True)
    print("failed", failed)


if __name__ == "__main__":
    main()
