"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. Each query runs once
untimed on the same tables, so that compilation and start-up are not counted, then once timed;
its result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docquarry.plans.queries import QUERIES  # noqa: E402
from docquarry.session import local_session, scope  # noqa: E402

HEADLINE = [
    "relevant_docs_url", "link_graph", "link_audit", "visible_text", "clean_text",
    "chunk_words", "chunk_ids", "embed_texts", "embed_batch_size", "write_collection",
    "collection_add", "knn", "knn_batch", "results_report", "query_dispatch", "search_docs",
    "crawl_bfs", "crawl_summary", "index_documentation", "index_and_search",
]


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    with scope(spark):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "docquarry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        run(spark, name, sf_dir)
        seconds[name] = round(run(spark, name, sf_dir), 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(found.group(1)) if found else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
