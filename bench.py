"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from eventlake.queries import all_queries
from eventlake.session import local_session

HEADLINE = (
    "campaign_live_metrics", "dashboard_metrics", "campaign_summary", "dashboard_bars", "last_sync", "subscriber_assignments",
    "bootstrap_sections", "bootstrap_overlay", "consolidate_campaign", "consolidate_engagement", "consolidate_daily", "parse_payload",
    "normalize_events", "trace_lookup_events", "trace_gap", "insert_absent", "upsert_keyed", "replace_children", "command_normalize",
    "command_fanout", "command_apply_campaign", "command_apply_subscriber", "command_result", "seed_export", "status_transitions",
    "counter_increase", "error_ratio", "histogram_p95", "held_condition", "run_rollup", "stream_parse", "stream_dual_sink",
    "stream_dedup", "stream_daily", "stream_transitions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    build = all_queries()
    spark.read.parquet(f"{folder}/events.parquet").write.format("noop").mode("overwrite").save()  # start the executors
    seconds = {}
    for name in names:
        started = time.perf_counter()
        build[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    scale = Path(folder).name.removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": float(scale)}))


if __name__ == "__main__":
    main()
