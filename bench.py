"""Time the headline queries and print one JSON line.

Shared intermediate tables are dropped before every timed run, so each number is the cost of
the query from the Parquet tables on.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from triagemill.plans import catalog  # noqa: E402
from triagemill.sources import views  # noqa: E402

HEADLINE = (
    "src4 src5 lab8 txt2 txt3 txt7 txt8 txt9 dup1 dup2 dup3 dup5 dup6 dup7 dup9 agg2 agg5 agg7 "
    "agg9 agg14 agg15 spl1 spl3 spl4 eva1 eva2 eva9 eva13 fea1 mod2 mod8 mod13 mod15"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("triagemill-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed = []
        for run in range(runs + 1):
            views._memo.clear()
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                timed.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(timed), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
