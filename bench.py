"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is fully executed with the ``noop`` sink (whole plan, no
collect to the driver), ``BENCH_RUNS`` times (3); its time is the median.
Prints one JSON line: total seconds of the headline queries, per-query
search seconds).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from webloom.plans import queries as Q  # noqa: E402
from webloom.session import get_spark  # noqa: E402

HEADLINE = [
    "extract_links", "chunk_pages", "outline_text", "page_text",
    "last_n_log", "since_last_reset", "idle_sessions", "first_idle",
    "decode_body", "multi_search", "detect_language", "correlate",
]

# Timed as well, outside the headline total.
MORE = ["search_report", "translate_queries", "follow_links", "batch_fetch", "outline_elements",
        "links_edge", "file_inventory", "stream_links", "main_article", "select_elements", "tab_evictions",
        "index_search", "follow_chains", "search_json"]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(f"local[{cpus}]", app="webloom-bench", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "6g")})
    # Untimed warm-up on the smallest scale (different files, so nothing of
    # the measured input is cached): JVM JIT, codegen, Python workers.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for key in HEADLINE + MORE:
            if key in Q.QUERIES:
                Q.QUERIES[key](spark, warm_dir).write.format("noop").mode("overwrite").save()
    runs: dict[str, list[float]] = {}
    for key in HEADLINE + MORE:
        for _ in range(RUNS):
            t0 = time.perf_counter()
            Q.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.setdefault(key, []).append(round(time.perf_counter() - t0, 3))
    times = {k: statistics.median(v) for k, v in runs.items()}
    n_pages = spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    n_events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_total", "value": round(sum(times[k] for k in HEADLINE), 3), "unit": "sec",
        "queries": times, "spread": {k: [min(v), max(v)] for k, v in runs.items()}, "sf": float(m.group(1)) if m else None, "cpus": int(cpus),
        "pages_per_sec": {k: round(n_pages / times[k], 1) for k in
                          ("extract_links", "chunk_pages", "outline_text") if k in times and times[k]},
        "events_per_sec": {k: round(n_events / times[k], 1) for k in
                           ("last_n_log", "since_last_reset", "idle_sessions") if k in times and times[k]},
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
