"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from vitrine.plans import all_queries
from vitrine.session import build_session

HEADLINE = [
    "vec_topk_filtered",
    "vec_threshold_topk",
    "vec_threshold_topk_blocked",
    "vec_storefront_search",
    "vec_similar_products",
    "ivf_exact_topk",
    "search_requests",
    "typo_correct",
    "title_suggestions",
    "quality_metrics",
    "catalog_diff",
    "upsert_full",
    "upsert_preserve_embedding",
    "embedding_writeback",
    "snapshot_write",
    "embed_outcome",
    "embed_through_cache",
    "text_templates",
    "html_strip",
    "daily_stats",
    "search_summary_by_tenant",
    "daily_rollup",
    "plan_limits",
    "tenant_erase_counts",
    "usage_counters",
    "webhook_verify",
    "stream_usage_counters",
    "stream_daily_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("product_counts")  # start the JVM's and Python's workers outside the timings
    seconds = {name: round(min(run(name), run(name)), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
