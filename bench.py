"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local threads. Every query
runs to completion (all rows produced, none sent to the driver) once to warm
the JVM and then twice; the faster of those two counts.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

from claimloom.plans.catalogue import QUERIES

HEADLINE = (
    "claim_assembly", "event_stream", "episode_number", "episode_collapse", "hierarchy",
    "monthly_panel", "demographics", "exclusive_keys", "completeness_by_state", "study_sample",
    "county_rollup", "rate_state", "member_counts", "describe_categories",
    "within_county_variation_acute", "ip_claim_cost_state", "cost_combined", "cost_total_county",
    "savings_state",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("claimloom-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(run, spark: SparkSession, folder: str) -> float:
    begin = time.perf_counter()
    run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        timed(QUERIES[name], spark, folder)
        seconds[name] = round(min(timed(QUERIES[name], spark, folder) for _ in range(2)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "claims_headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
