"""Seconds of the headline queries at $BENCH_SF_DIR, as one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from millrace import registry

HEADLINE = (
    "cashflow_by_month", "top1_category", "transfer_candidates", "balance_asof", "running_balance", "recurring_groups",
    "ols_trend", "price_changes", "structural_scores", "quality_audit", "doc_exact_dedup", "doc_language", "bm25_topk", "rrf_fusion",
    "vector_topk", "kg_noisy_or", "two_hops", "approximate_topk", "simhash_pairs", "cash_flow_forecast", "booking_search", "latency_percentiles", "session_windows", "rate_limit_window",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    sys.stdout.write(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rpartition("sf")[2]}) + "\n")


if __name__ == "__main__":
    main()
