"""Time the headline queries; print one JSON line.

BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_RUNS     timed runs per query, the shortest counts (default 2)
BENCH_QUERIES  comma-separated names instead of the headline list
BENCH_COPIES   repeat the event feed with new flocks this many times (scale trial, default 1)
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from broodspark.session import local_session
from checks.pairs import QUERIES

HEADLINE = [
    "panel_from_events",
    "r05_cumulative_entries",
    "r15_early_removal",
    "r18_dwell_occupancy_from_log",
    "k01_interpret",
    "k02_per_simulation",
    "k03_per_scenario",
    "x01_economic_sweep",
    "x03_growth_sweep",
    "r20_panel_quality",
    "s01_csv_tree_scan",
    "flagship_scenario_means",
]


def copied_feed(spark, sf_dir: str, copies: int) -> str:
    """The feed ``copies`` times, each copy with flocks of its own."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    users = events.selectExpr("max(user_id) + 1 AS n").first()["n"]
    step = -(-users // 6) * 6
    target = tempfile.mkdtemp(prefix="broodspark-bench-")
    columns = [c if c != "user_id" else "user_id + _copy * " + str(step) + " AS user_id" for c in events.columns]
    (
        events.selectExpr("*", f"explode(sequence(0, {copies - 1})) AS _copy")
        .selectExpr(*columns)
        .repartition(8 * max(1, copies // 50))
        .write.parquet(f"{target}/events.parquet")
    )
    return target


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    copies = int(os.environ.get("BENCH_COPIES", "1"))
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    spark = local_session(cpus, spark__sql__shuffle__partitions=cpus)
    feed_dir = copied_feed(spark, sf_dir, copies) if copies > 1 else sf_dir
    QUERIES["flagship_scenario_means"](spark, feed_dir).collect()
    seconds: dict[str, float] = {}
    for name in names:
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, feed_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
    }
    if copies > 1:
        result["copies"] = copies
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
