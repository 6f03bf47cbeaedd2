"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from tallyroom.plans import catalog
from tallyroom.session import local_session

HEADLINE = [
    "last_reading", "void_last_reading", "reading_owner", "latest_one", "pending_recipients", "batch_chunks",
    "delivery_state", "delivery_log", "provider_ban", "config_drift", "mime_plan", "inbox_ingest",
    "parse_log", "event_not_seen", "out_of_order", "late_data", "ban_periods", "stream_log_ingest",
    "cell_json", "split_questions", "match_fields", "build_rows", "fold_question", "severity_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), partitions=8)
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
