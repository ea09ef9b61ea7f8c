"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder of tables, BENCH_CPUS the number of local cores.  Each
query runs once to warm up, then BENCH_RUNS times (3); the median counts.  Results
go to the ``noop`` sink, so every row is produced and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import Observation, SparkSession
from pyspark.sql import functions as F

from tripleflow.catalog import QUERIES

HEADLINE = (
    # the defining workload: seven patterns over subjects x predicates x objects
    "jn4_default_query",
    "jn4_default_rows",
    "jn5_default_rows",
    # conjunctive queries over the star schema
    "jn4_home_sales",
    "jn4_bgp",
    "jn5_grouped",
    "jn1_natural",
    "jn1_hot_keys",
    "agg5_domain",
    # many patterns in one scan
    "snk1_counts",
    "flt5_each",
    "flt6_packed",
    "flt8_shared",
    "src2_parse",
    # order-dependent correlation
    "jn6_bounded_first_per_key",
    "jn6_bounded_latest_per_stream",
    "jn7_pair_up",
    "jn9_threshold",
    # run logs and statistics
    "log7_by_experiment",
    "agg4_anova",
    # streams
    "str2_bgp",
    "str3_counts",
    "str5_pair_up",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    rows: dict[str, int] = {}
    for name in chosen:
        counted = Observation(name)
        warm = QUERIES[name](spark, sf_dir).observe(counted, F.count(F.lit(1)).alias("n"))
        warm.write.format("noop").mode("overwrite").save()
        rows[name] = counted.get["n"]
        taken = []
        for _ in range(runs):
            begun = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - begun)
        times[name] = round(statistics.median(taken), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rows": rows,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
