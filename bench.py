"""Benchmark: wall time of the headline queries, one JSON line on stdout.

``BENCH_SF_DIR`` (default ``/root/testdata/sf0.1``) names the tables,
``BENCH_CPUS`` (default 8) the local cores, ``BENCH_QUERIES`` an optional
comma-separated list or ``all``. Each query is planned and fully executed into
a no-op sink; the time includes building the plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from scenaria.session import local_session  # noqa: E402
from scenaria.workload.catalog import QUERIES  # noqa: E402

HEADLINE = [
    "annual_panel_dense",
    "generation_mix",
    "generation_share",
    "scenario_contrast",
    "collapsed_mix",
    "corridor_capacity",
    "link_with_endpoints",
    "union_by_name",
    "storage_with_total",
    "right_join_fill",
    "canonical_flow",
    "net_trade",
    "trade_vs_demand",
    "flow_heatmap",
    "flow_utilisation",
    "hourly_balance_dense",
    "daily_balance",
    "hour_window_view",
    "price_table",
    "weighted_price_totals",
    "price_duration_curve",
    "price_curve_every_line",
    "cost_by_class",
    "link_cost_split",
    "cost_increment_npv",
    "gdp_discounted",
    "cost_pct_gdp",
    "cost_per_decade",
    "demand_completed",
    "node_symbol_box",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session("bench", cores=cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name].plan(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # starts the JVM's code paths; not counted
    seconds = {n: round(run(n), 3) for n in names}
    sf = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "scenario_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
