from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens import constants as K
from wirelens.operators import ids_alerts as A, metric_windows as M

T0 = datetime(2024, 1, 1)
SCHEMA = ("event_id long, ts timestamp_ntz, sid long, severity int, signature string, category string, "
          "src_ip string, dest_ip string")


def alerts(spark, *specs):
    data = []
    for i, (minute, sid, severity, signature, *ips) in enumerate(specs):
        src, dst = ips or ("a", "b")
        data.append((i, T0 + timedelta(minutes=minute), sid, severity, signature, "cat", src, dst))
    return spark.createDataFrame(data, SCHEMA)


def test_classes(spark):
    df = alerts(spark, (0, 2016149, 1, "x"), (0, 1, 1, "SURICATA STREAM x"), (0, 1, 1, "x"), (0, 1, 2, "HUNTING"),
                (0, 1, 3, "ET HUNTING x"), (0, 1, 3, "ET INFO x"), (0, 1, 3, "other"))
    got = df.orderBy("event_id").select(A.classify_review(), A.classify_notify(), A.review_reason()).collect()
    assert [r[0] for r in got] == ["KNOWN_INFRA", "STREAM_NOISE", "ACTION_REQUIRED", "REVIEW", "HUNTING",
                                   "INFORMATIONAL", "UNCLASSIFIED"]
    assert [r[1] for r in got] == ["CRITICAL"] * 3 + ["WARNING", "HUNTING", "INFO", "INFO"]
    assert got[0][2] == K.INFRA_SIDS[2016149] and got[6][2] == K.REVIEW_REASONS["UNCLASSIFIED"]


def test_lookback_reaches_the_scan(spark, sf):
    from wirelens.sources import views
    plan = A.lookback_filter(views.ids_alerts(spark, sf), views.AS_OF, timedelta(hours=8)) \
        ._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan


def test_run_repeats_stay_and_sent_keys_go(spark):
    df = alerts(spark, (0, 1, 1, "s"), (1, 1, 1, "s"), (2, 2, 1, "s"))
    sent = spark.createDataFrame([("2:a:b", T0)], "key string, last_ts timestamp_ntz")
    new = A.dedup_sent(df, sent)
    assert rows(new.select("event_id")) == [(0,), (1,)]
    kept = A.sent_keys_update(sent, new, keep=1).collect()
    assert [r.key for r in kept] == ["1:a:b"]


def test_rate_limit_window(spark):
    df = alerts(spark, (0, 7, 1, "s"), (1, 7, 1, "s"), (2, 7, 1, "s", "z", "b"), (6, 7, 1, "s"), (0, 8, 1, "s"))
    got = A.sid_rate_limit(df, [(7, 1, 300)])
    assert rows(got.select("event_id")) == [(0,), (2,), (3,), (4,)]
    assert A.sid_rate_limit(df, []).count() == 5


def test_suppress_by_table_and_list(spark):
    df = alerts(spark, (0, 7, 1, "s"), (1, 8, 1, "s"))
    assert A.sid_suppress(df, [7]).count() == 1 and A.sid_suppress(df, []).count() == 2
    assert A.sid_suppress(df, spark.createDataFrame([(7,), (7,)], "sid long")).count() == 1


def test_digest_ties_go_to_the_first_seen(spark):
    df = alerts(spark, (0, 1, 1, "late", "x", "y"), (1, 2, 1, "b"), (2, 3, 1, "c"), (3, 3, 1, "c"))
    got = A.notify_digest(df, 2).orderBy("place").collect()
    assert [(r.signature, r.alerts, r.class_alerts) for r in got] == [("c", 2, 4), ("late", 1, 4)]
    assert got[1].src_ip == "x"


def test_detail_cuts_before_it_filters(spark):
    df = alerts(spark, (0, 5, 1, "old"), (1, 2016149, 1, "k"), (2, 5, 1, "SURICATA STREAM"))
    assert A.alert_detail(df, 2).count() == 0 and A.alert_detail(df, 3).count() == 1


def test_actionable_keeps_one_per_pair(spark):
    df = alerts(spark, (0, 5, 1, "x"), (1, 5, 1, "x"), (2, 6, 3, "other"))
    assert rows(A.review_actionable(df).select("event_id")) == [(0,), (2,)]
    assert rows(A.review_actionable(df, 1).select("event_id")) == [(2,)]


def test_status_and_issues(spark):
    tiers = spark.createDataFrame([(0,), (9,), (10,)], "n int").select(A.status_tier(F.col("n"))).collect()
    assert [r[0] for r in tiers] == ["GREEN", "YELLOW", "RED"]
    checks = spark.createDataFrame([("a", 3, False, "%s bad"), ("b", 0, True, "%s bad")],
                                   "name string, value long, healthy boolean, template string")
    assert rows(A.handoff_issues(checks)) == [("a", "3 bad")]


def test_unreadable_time_becomes_as_of(spark):
    df = spark.createDataFrame([("bad", 1), ("2024-01-01T00:00:00+0000", 2)], "t string, id long")
    got = A.loki_rows(df, F.col("t"), F.lit("line"), datetime(2024, 2, 1), keep=["id"])
    assert rows(got.select("id", "ns")) == [(1, "1706745600000000000"), (2, "1704067200000000000")]


@pytest.mark.parametrize("shards", [1, 3])
def test_push_batches_hold_every_row_once(spark, shards):
    df = spark.range(500).select("id", (F.col("id") % 17).alias("us"), F.col("id").cast("string").alias("ns"),
                                 F.lit("x").alias("line"))
    out = A.push_batches(df, "id", 50, shards).collect()
    assert sum(r.entries for r in out) == 500 and max(r.entries for r in out) <= 50


def test_sliding_share(spark):
    df = spark.createDataFrame([(T0 + timedelta(minutes=m), p) for m, p in
                                [(0, "BENIGN"), (1, "DoS"), (6, "BENIGN")]], "ts timestamp, prediction string")
    got = {r.window_us: (r.n, r.bad, r.firing) for r in M.attack_rate_window(df).collect()}
    zero = 1704067200000000
    assert got[zero] == (2, 1, 1) and got[zero - 240_000_000] == (1, 0, 0) and got[zero + 360_000_000] == (1, 0, 0)
    with pytest.raises(ValueError):
        M.attack_rate_window(df, 100, 60)


def test_silence_and_sustained(spark):
    up = spark.createDataFrame([(T0,), (T0 + timedelta(minutes=5),), (T0 + timedelta(minutes=15),)], "ts timestamp")
    events = up.limit(1)
    zero = 1704067200000000
    got = rows(M.silence_detect(up, events))
    assert got == [(zero + 300_000_000, "silent"), (zero + 600_000_000, "down"), (zero + 900_000_000, "silent")]
    firing = spark.createDataFrame([(zero + i * 60_000_000, f) for i, f in enumerate([1, 1, 1, 0, 1])],
                                   "window_us long, firing int")
    assert rows(M.sustained_for(firing, 60, 120)) == [(zero, zero + 120_000_000, 3)]
