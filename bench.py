"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))
from worklens.plans import registry  # noqa: E402

HEADLINE = (
    "assignee_risk", "resource_risk", "features_core", "sprint_trend", "workload_pivot", "profile_columns",
    "describe_numeric", "agent_scan_by_resource", "report_markdown_by_sprint", "roc_auc", "stratified_folds",
    "monte_carlo", "optimal_path", "trajectory", "knn_similar", "knn_classify",
    "fit_logistic", "fit_gnb", "fit_ridge", "fit_tree", "fit_forest", "fit_gbt", "anomaly_flags", "cluster_resources",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("worklens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    queries["kpi_summary"](spark, sf_dir).collect()  # JVM and file-listing warm-up
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
