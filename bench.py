"""Time the registered queries; prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_QUERIES comma-separated names (default all)

can be compared; those registered since are timed beside them, with a sum of
their own.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tallyloom.plans.queries import QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Registered after the baseline was taken.
SINCE = {
    "scan_array", "scan_mixed", "resolve_sources", "chunk_roundtrip", "checkpoint_roundtrip", "results_roundtrip",
    "canonical_text_exact", "normalize_exact", "chat_pair_objects", "length_groups", "stream_quantiles",
}

RATES = {"normalize": ("documents", "conversations"), "dedupe": ("documents",), "loss_mask": ("conversations",), "level_summary": ("events",)}


def main():
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    count = lambda t: spark.read.parquet(f"{SF_DIR}/{t}.parquet").count()
    rows = {n: sum(count(t) for t in tables) for n, tables in RATES.items()}  # also warms the session up
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(s for n, s in seconds.items() if n not in SINCE), 3),
                "unit": "sec",
                "new_queries_seconds": round(sum(s for n, s in seconds.items() if n in SINCE), 3),
                "queries": seconds,
                "rows_per_sec": {n: round(r / seconds[n]) for n, r in rows.items() if n in seconds},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
