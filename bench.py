"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Every
query runs once to warm up and then ``RUNS`` times to a sink that discards rows; the best is kept.
"""

from __future__ import annotations

import json
import os
import sys
import time

from seedview.plans.queries import QUERIES
from seedview.session import build_session

RUNS = 2
HEADLINE = [
    "asof_last_order",
    "asof_tie_break",
    "parent_lookup_2hop",
    "tagg_orders_w30",
    "tagg_orders_all",
    "tagg_events_w7",
    "tagg_lines_by_order",
    "tagg_null_time_keep",
    "tagg_sweep_7_30_90_all",
    "temporal_view",
    "degree_temporal",
    "neighbors_k5_nodes",
    "split_70_15_15",
    "dense_customer_ids",
    "line_row_ids",
    "impute_median",
    "auroc_exact",
    "row_cap_sample",
]


def seconds(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_ui_enabled="false",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    times = {}
    for name in wanted:
        run = lambda: QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        run()
        times[name] = round(min(seconds(run) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": root.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
