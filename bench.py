"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and
cores. Each query runs into a sink that discards rows, once to warm up and three times that count:
their median is its time.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gatesift.plans.queries import REGISTRY  # noqa: E402
from gatesift.session import build_session  # noqa: E402

HEADLINE = [
    "validate_text_high", "validate_pages", "analyze_file_profile", "base64_roundtrip_verdict",
    "validate_requests", "paged_document_verdict", "rule_matches_long", "keyword_matches",
    "model_verdict_join", "risk_score_legacy", "analyse_once", "validate_with_cache",
    "ttl_replay", "event_counters", "first_sighting", "counter_sessions", "issue_frequency",
    "stream_validate", "stream_ttl_replay",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    # one row group per file would be one task: split the scan over the cores
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    n_docs, n_bytes = documents.selectExpr("count(*)", "sum(octet_length(text))").first()
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    text = seconds["validate_text_high"]
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": int(cpus),
        "validate_text_docs_per_sec": round(n_docs / text),
        "validate_text_mb_per_sec": round(n_bytes / text / 1e6, 1),
    }))


if __name__ == "__main__":
    main()
