from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from conftest import rows
from test_sources import lesson
from wirelens import constants as K
from wirelens.operators import lessons as L, triage as T
from wirelens.plans.flow_alerting import alert_flows, fit_anomaly_model, score_flows
from wirelens.plans.review_pass import escalation_pass, learn_pass, report_pass
from wirelens.plans.training_data import prepare_training_data
from wirelens.operators import flow_records as R
from wirelens.sources import store, views

NOW = datetime(2026, 6, 1)


def test_training_data(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame(
        [(i, float(a), float(b), float(c), str(l)) for i, (a, b, c, l) in enumerate(
            zip(*rng.normal(size=(3, 200)), rng.choice(["BENIGN", "DoS", "Probe"], 200)))],
        "id long, ` a` double, b double, c double, ` Label` string")
    data = prepare_training_data(df, "id", ["c", "a"])
    assert data.classes == ["BENIGN", "DoS", "Probe"] and data.scaler.features == ["c", "a"]
    assert set(data.weights) == {0, 1, 2} and abs(sum(data.weights.values()) - 3) < 1e-9
    assert data.rows.columns == ["id", "class_id", "split", "c", "a"] and data.rows.count() == 200
    mean, std = data.part("train").agg(F.avg("a"), F.stddev_pop("a")).first()
    assert abs(mean) < 1e-9 and abs(std - 1) < 1e-9


def test_alerting(spark, sf):
    features = R.eve_features_25(R.min_packets_filter(views.eve_flow(spark, sf), 3))
    scored = score_flows(features, fit_anomaly_model(features))
    routed = alert_flows(scored, views.ALLOW_RULES)
    assert routed.count() == features.count()
    assert routed.where("admitted and allow_rule is not null").count() == 0
    checked = routed.where("admitted is not null")
    assert rows(checked.select("flow_id")) == rows(
        routed.where("allow_rule is null and severity in ('critical', 'emergency')").select("flow_id"))


def test_alerting_applies_the_limit_over_all_pairs(spark):
    t0 = datetime(2026, 1, 1)
    flows = [(i, t0 + timedelta(seconds=i), f"10.0.0.{i}") for i in range(25)] + [(25, t0 + timedelta(seconds=61), "10.0.0.24"),
             (3, t0 + timedelta(seconds=200), "10.0.0.3"), (3, t0 + timedelta(seconds=201), "10.0.0.4"), (26, None, "10.0.0.9")]
    df = spark.createDataFrame([(*f, "d", 1, 2, "TCP", "critical") for f in flows] + [(99, t0, "w", "d", 1, 2, "TCP", "warning")],
                               "flow_id long, ts timestamp, src_ip string, dst_ip string, src_port int, dst_port int, "
                               "proto string, severity string")
    got = [tuple(r) for r in alert_flows(df, []).select("flow_id", "src_ip", "admitted").collect()]
    assert len(got) == len(flows) + 1 and (99, "w", None) in got
    # the pair of flow 24, held back by the limit, has started no cooldown; equal ids are judged one by one
    assert sorted((i, s) for i, s, a in got if a) == sorted(
        [(i, f"10.0.0.{i}") for i in range(20)] + [(25, "10.0.0.24"), (3, "10.0.0.3"), (3, "10.0.0.4")])


def entry(spark, i, severity, action, queued):
    alert = spark.createDataFrame([(f"{i:03d}", "t", 10, "510", "d", "pi0", "log", severity, action, "", "model", None,
                                    False, False)],
                                  "id string, ts string, level int, rule_id string, description string, agent string, "
                                  "full_log string, severity string, action string, reason string, classifier string, "
                                  "lesson_id string, fallback boolean, coherence_corrected boolean")
    return T.queue_entries(alert, F.lit(queued))


def test_report_learn_and_escalate(spark, tmp_path):
    queue, marks, out, lessons = (str(tmp_path / n) for n in ("queue", "marks", "out", "lessons"))
    first = entry(spark, 1, "high", "investigate", "2026-01-01T00:00:01Z").unionByName(
        entry(spark, 2, "low", "log", "2026-01-01T00:00:02Z"))
    store.append_json(first, queue)
    reported = report_pass(spark, queue, marks, out)
    assert [r.alert_id for r in reported.collect()] == ["001"]
    report = spark.read.text(f"{out}/until=2026-01-01T00-00-01Z/section=header").collect()
    assert sorted(r.value for r in report) == ["- Alerts analyzed: **1**", "- Severity breakdown: high=1"]
    assert report_pass(spark, queue, marks, out).count() == 0

    answer = ('[{"alert_id":"001","correct_severity":"noise","correct_action":"ignore","log_keywords":["log"]}]')
    responses = spark.createDataFrame([(str(i), t) for i, t in enumerate([answer, answer, answer, "broken"])],
                                      "response_id string, response string")
    learned = learn_pass(reported, responses, lessons, NOW).first()
    assert (learned.status, learned.promotion_count, learned.severity) == ("authoritative", 3, "noise")
    alerts = reported.select(F.col("alert_id").alias("id"), "alert.rule_id", "alert.agent", "alert.full_log")
    assert L.lesson_match(alerts, store.src_lessons(spark, lessons)).first().lesson.lesson_id == learned.lesson_id

    state = str(tmp_path / "escalation")
    assert escalation_pass(spark, queue, state).count() == 0
    store.append_json(entry(spark, 3, "critical", "escalate", "2026-01-01T00:00:03Z"), queue)
    notice = escalation_pass(spark, queue, state).first()
    assert (notice.headline, notice.via) == ("[CRITICAL] pi0 rule 510: d", "via: model at 2026-01-01T00:00:03Z")
    assert escalation_pass(spark, queue, state).count() == 0


def test_model_fit_computes_features_twice(spark):
    seen, n = spark.sparkContext.accumulator(0), 200
    def counted(x):
        seen.add(1)
        return float(x * x)
    square = F.udf(counted, "double").asNondeterministic()(F.col("id"))
    features = spark.range(n).withColumn("x", square).select(*[(F.col("x") + i).alias(f) for i, f in enumerate(K.FEATURES_25)])
    fit_anomaly_model(features)
    assert seen.value == 2 * n
