"""Seconds per headline query; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from marketloom.plans.catalog import QUERIES
from marketloom.session import local_session

HEADLINE = [
    "ohlcv_bars", "indicators", "training_table", "macd", "sequences", "asof_features",
    "asof_features_daily", "latest_per_ticker", "online_features", "price_summary",
    "indicator_snapshot", "decide", "dq_rules", "drift_summary", "drift_psi", "ordered_split",
    "stratified_split", "standardize", "roc_auc", "threshold_sweep", "describe", "iqr_outliers",
    "acf", "seasonal_decompose", "validate_input", "pii_redact", "pii_counts", "sanitize_output",
    "vector_topk", "rag_context", "golden_eval", "judge_parse", "ab_compare", "parse_actions",
    "latency_histogram", "latency_p95", "sliding_rate", "limited_requests", "alerts",
    "request_rate_stream", "materialize_stream", "feature_pipeline", "model_logistic",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.TemporaryDirectory(prefix="bench-")
    spark = local_session(cpus, folder=folder.name)
    run = lambda name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    run("ohlcv_bars")  # start the executors and compile the common code
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    folder.cleanup()
    print(json.dumps({
        "metric": "headline queries, total time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
