"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of the parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS: local cores (default 8)

The warehouse and the vector table are built first, timed as ``warehouse_load``
and ``vectorize``; the reports and searches then read their files.
"""

from __future__ import annotations

import json
import os
import sys
import time

from broadsheet.queryset import all_queries, fixtures
from broadsheet.session import get_session

HEADLINE = [
    "clean_text", "title_dedup", "page_text", "author_cascade", "page_to_item", "link_classify",
    "chunk_split", "chunk_export", "encode_sparse", "encode_dense", "dense_topk", "text_topk", "sparse_topk", "hybrid_topk",
    "search_hits", "article_list", "article_search", "source_distribution", "top_authors", "monitor_metrics",
    "stream_dedup", "event_decode", "eval_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="12g", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of any query
    queries, seconds = all_queries(), {}

    def timed(name, action):
        started = time.time()
        action()
        seconds[name] = round(time.time() - started, 3)
        print(f"{name:24} {seconds[name]:8.2f}", file=sys.stderr, flush=True)

    timed("raw_table", lambda: fixtures.article_metadata(spark, sf_dir))
    timed("warehouse_load", lambda: fixtures.warehouse(spark, sf_dir))
    timed("vectorize", lambda: fixtures.points(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda: queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
