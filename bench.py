"""Time every registered query and print one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; the middle time
counts. Results go to Spark's ``noop`` sink, so all rows and columns are computed
and nothing is collected. ``BENCH_ONLY`` takes a comma-separated list of names.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from siltworks.registry import QUERIES
from siltworks.session import SESSION_SETTINGS


def session(cpus: str) -> SparkSession:
    builder = SparkSession.builder.appName("bench").master(f"local[{cpus}]")
    settings = {
        **SESSION_SETTINGS,
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = session(cpus)
    timings: dict[str, float] = {}
    failed: dict[str, str] = {}
    for name in only or QUERIES:
        try:
            seconds(spark, name, sf_dir)
            timings[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 4)
        except Exception as error:  # a broken query must not hide the others
            failed[name] = str(error).split("\n")[0]
            print(f"{name}: {failed[name]}", file=sys.stderr)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    if failed:
        result["failed"] = failed
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
