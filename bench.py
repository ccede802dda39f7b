"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then once timed, each time from the base tables to a full evaluation of all result columns.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "screen_full", "asof_latest_bar", "screen_panel", "screen_bulk", "indicators_all", "ema", "action_reconcile",
    "ratios", "alert_diff_history", "bt_sweep", "sink_bars_upsert", "snapshot_seal_history", "concept_tagging",
    "stream_daily_bars",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    picks = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    from pointpanel.plans import registry
    from pointpanel.session import local_session

    spark = local_session(cpus, "bench")
    queries = registry.queries()
    times: dict[str, float] = {}
    for name in picks:
        for _ in range(2):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
