"""Wall time of the headline queries; prints one JSON line.

Every query runs once to warm up and is then timed over its whole result (noop sink).
Environment: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS, BENCH_ALL=1 for every registered query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "url_normalize", "page_index", "link_edges", "link_indegree_by_domain", "clean_text", "search_topk",
    "search_documents", "trigram_postings", "search_batch_topk", "ttl_claims", "content_change", "upsert_urls",
    "status_current", "job_progress", "stats_bundle", "jobs_page", "frontier_bfs", "fetch_outcome",
    "politeness_schedule", "robots_filter", "dlq_shape_route", "rate_5m", "p95_from_buckets", "alert_intervals",
    "stream_ledger",
]


def run(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    from crawlframe.plans import catalog
    from crawlframe.plans.local import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = list(catalog.QUERIES) if os.environ.get("BENCH_ALL") else HEADLINE
    spark = local_session(cpus)
    seconds = {}
    for name in names:
        query = catalog.QUERIES[name]
        run(query, spark, folder)
        seconds[name] = round(statistics.median(run(query, spark, folder) for _ in range(runs)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
