"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.
``python bench.py NAME...`` times the named queries, ``python bench.py all`` every registered one.
Each query runs to completion into the no-op sink after one short warm-up of the session.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wirelens.catalog import QUERIES  # noqa: E402
from wirelens.session import build_session  # noqa: E402


HEADLINE = """
eve_features_25 eve_features_78 extraction_stats anomaly_score anomaly_threshold severity_tier allowlist_match
alert_payload alert_cooldown suppression_stats flow_alert_summary flow_sessions_idle flow_sessions_active
flow_iat_stats flow_features_78 clean_nonfinite_rows stratified_split scaler_fit scaler_transform class_weights
range_check score_linear_softmax score_model_udf per_class_accuracy anomaly_eval perturb_fgsm perturb_pgd
robustness_eval alert_rate_limit train_classifier sid_suppress sid_rate_limit dedup_sent notify_digest
review_top_sids review_actionable overnight_summary loki_batches attack_rate_window latency_p95_window
sustained_for lesson_match lesson_match_long_text classify_cascade review_disagreements lesson_ingest lesson_prune
lesson_stats escalations stream_attack_rate stream_flow_sessions
""".split()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = QUERIES if sys.argv[1:] == ["all"] else sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()
    seconds, failed = {}, {}
    for name in chosen:
        began = time.perf_counter()
        try:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
            print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
        except Exception as e:  # one broken query must not hide the others
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    out = {"metric": "total wall-clock of the queries", "value": round(sum(seconds.values()), 3),
           "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}
    if failed:
        out["failed"] = failed
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
