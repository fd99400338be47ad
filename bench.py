"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the local cores. BENCH_QUERIES may
name other queries (comma-separated) or ``all``. Every result is computed in full and written nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dealweave.catalog import QUERIES  # noqa: E402
from dealweave.session import local_session  # noqa: E402

HEADLINES = (
    "company_list", "company_deals", "employer_facts", "startup_universe", "company_rounds", "segment_metrics",
    "worked_at", "nearest_date_match", "mirror_upsert", "snapshot_diff", "pages_scan", "table_coverage",
    "chunk_documents", "term_df", "keyword_search", "vector_top_k", "similar_items", "hybrid_search", "freshness",
    "usage_kpis", "daily_series", "stream_daily_kpis", "stream_usage_24h", "regex_join", "memory_context", "build_documents",
    "nightly_run",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = tuple(QUERIES) if wanted == "all" else tuple(wanted.split(",")) if wanted else HEADLINES
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(folder).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
