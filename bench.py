"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from loamfield.plans import catalogue
from loamfield.session import local_session

HEADLINE = [
    "bm25_topk", "sparse_dot_topk", "hybrid_rrf", "dense_topk", "dense_filtered", "ir_summary", "fixed_chunks", "recursive_chunks", "pii_redact", "idf_table", "change_detection",
    "exact_duplicates", "link_graph", "page_headings", "pagerank", "neighbors_k", "memory_window", "exchange_docs", "latency_percentiles", "stream_tumbling",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    spent = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(spent.values()), 3), "unit": "sec", "queries": spent, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
