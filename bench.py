"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "a01_consensus_core", "a11_confidence_weighted", "a17_primary_ticker", "t04_most_bullish",
    "c13_dump_documents", "c07_text_metrics", "j10_thread_assembly", "m01_ticker_features",
    "m03_keyword_features", "m07_quality_features", "s25_extraction_outputs", "a26_day_costs",
    "w01_ema", "w11_trailing_usage", "r02_signal_scan", "r03_rolling_diagnostics",
    "r05_walk_forward", "r09_trade_replay", "m14_ranking_metrics", "st3_daily_consensus",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    from tidemark.plans import all_queries
    from tidemark.session import local_session

    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = all_queries()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the executors before timing
    seconds = {}
    for name in HEADLINE:
        best = None
        for _attempt in range(2):
            start = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
