"""Benchmark: every registered query plus a full clean and a wide profile; prints one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs per query (the median counts). An untimed run on the next smaller folder comes first, which
warms the JVM without doubling the time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from scrubline import CleanOptions, build_session, clean  # noqa: E402
from scrubline.operators.profile import column_profile  # noqa: E402
from scrubline.plans import views  # noqa: E402
from scrubline.plans.queries import all_queries  # noqa: E402
from scrubline.session import spread_small  # noqa: E402

WIDE = 50


def full_clean(spark, folder):
    """Trim, missing cells, inference, dates, mean fill and key duplicates over dirty lineitem."""
    dirty = views.dirty_lineitem(spark, folder).withColumn("row_place", views.lineitem_place())
    day = F.col("l_shipdate").cast("date").cast("string").alias("day_raw")
    keys = [F.col(k).cast("string").alias(k) for k in ("l_orderkey", "l_partkey")]
    raw = dirty.select("row_place", *keys, "qty_raw", "price_raw", "flag_raw", "note_raw", day)
    options = CleanOptions(
        infer_types=True, parse_dates=True, fill_missing="mean", drop_duplicates=True,
        dedup_keys=("l_orderkey", "l_partkey"),
    )
    return clean(raw, options, ["row_place"], spread=True).frame


def wide_profile(spark, folder):
    """Profile of dirty lineitem repeated to 50 columns."""
    dirty = views.dirty_lineitem(spark, folder)
    base = ["qty_raw", "price_raw", "flag_raw", "note_raw"]
    wide = dirty.select(*[F.col(base[i % 4]).alias(f"c{i}") for i in range(WIDE)])
    return column_profile(spread_small(wide, ["c0", "c1"]), wide.columns)


def timed(fn, spark, folder) -> float:
    began = time.perf_counter()
    fn(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = sys.argv[1:]
    spark = build_session(
        "bench",
        spark__master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("OFF")
    work = {**all_queries(), "full_clean": full_clean, "wide_profile": wide_profile}
    seconds = {}
    smaller = folder.rstrip("/").replace("sf0.1", "sf0.01")
    warm = smaller if os.path.isdir(smaller) else folder
    for name, fn in work.items():
        if chosen and name not in chosen:
            continue
        timed(fn, spark, warm)
        seconds[name] = round(statistics.median(timed(fn, spark, folder) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of all queries, warm",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
