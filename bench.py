"""Headline queries on local[$BENCH_CPUS] at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from noticemill.plans import catalog
from noticemill.session import build_session

HEADLINE = ("incremental_plan", "mark_delivered", "list_filter_reason", "within_source_dedup", "content_hash", "funnel",
            "store_upsert", "qualification_clauses", "field_values_purchaser", "page_text", "duplicate_links",
            "dedup_primaries")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = [q for q in os.environ.get("BENCH_ONLY", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", int(cpus), "noticemill-bench", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    catalog.queries()["live_tasks"](spark, sf_dir).count()  # start-up is not part of a query
    times: dict[str, float] = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
