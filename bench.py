"""Runs the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINES = [
    "knn_exact_l2",
    "knn_bulk_l2",
    "ivf_probe_topk",
    "two_tier_rerank",
    "two_tier_recall",
    "pq_adc_topk",
    "knn_graph_edges",
    "sq8_dim_codes_i8",
    "clean_text_full",
    "chunk_documents",
    "exact_dedup_first_wins",
    "date_group_topn",
    "star_join_revenue",
    "latency_percentiles",
    "session_windows",
]


def main() -> None:
    from vecflow.plans import catalogue
    from vecflow.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    took = {}
    queries["distinct_values"](spark, sf_dir).collect()  # starts the engine
    for name in HEADLINES:
        began = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    # every row as a query: build and search apart, with recall
    from pyspark.sql import functions as F
    from vecflow import evaluation
    from vecflow.plans.tables import vectors

    v = vectors(spark, sf_dir).select("vec_id", "v").cache()
    asked = v.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"))
    reports = evaluation.comparison(v, asked, 10, repeats=1)
    qps = next(r["qps"] for r in reports if r["index"] == "flat")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "bulk_knn_qps": qps, "indexes": reports}))
    spark.stop()


if __name__ == "__main__":
    main()
