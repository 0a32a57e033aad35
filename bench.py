"""Headline queries on the test tables: median of three warm runs each, as one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from airloom.session import build_session  # noqa: E402
from driver_queries.spark_side import QUERIES  # noqa: E402

HEADLINE = ["trend_day", "compare", "anomalies", "correlation", "ranking", "context_statistics", "insight_context",
            "upsert_merge", "stream_upsert"]
RUNS = 3


def timed(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("airloom-bench", master=f"local[{cpus}]",
                          shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, folder)
        seconds[name] = round(statistics.median(timed(spark, name, folder) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "total of median warm query times", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
