import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens.operators import routing

FLOW = "flow_id long, src_ip string, dst_ip string, src_port int, dst_port int, proto string"


def test_allowlist(spark):
    flows = spark.createDataFrame([(1, "1.1.1.1", "8.8.8.8", 5, 53, "UDP"), (2, "1.1.1.1", "8.8.8.8", 5, 443, "TCP"),
                                   (3, "10.0.0.1", "8.8.8.8", 5, 443, "TCP"), (4, None, "8.8.8.8", 5, 123, "UDP")], FLOW)
    rules = [{"name": "dns", "dst_port": 53}, {"name": "ntp", "dst_port": 123}, {"name": "trusted", "src_ip": "10.0.0.1"}]
    want = [(1, "dns"), (2, None), (3, "trusted"), (4, "ntp")]
    assert rows(routing.allowlist_match(flows, rules).select("flow_id", "allow_rule")) == rows(
        spark.createDataFrame(want, "a long, b string"))
    table = routing.rule_table(spark, rules)
    assert rows(routing.allowlist_match(flows, table).select("flow_id", "allow_rule")) == rows(
        spark.createDataFrame(want, "a long, b string"))
    assert rows(routing.allowlist_exclude(flows, rules).select("flow_id")) == [(2,)]
    assert routing.allowlist_match(flows, []).where("allow_rule is not null").count() == 0
    long = rules + [{"name": f"never {i}", "proto": "X", "src_port": i} for i in range(routing.LISTED_RULES)]
    assert rows(routing.allowlist_match(flows, long).select("flow_id", "allow_rule")) == rows(spark.createDataFrame(want, "a long, b string"))


def test_rule_without_keys_matches_all_and_order_decides(spark):
    flows = spark.createDataFrame([(1, "a", "b", 1, 2, "TCP")], FLOW)
    rules = [{"name": "port", "dst_port": 2}, {"name": "any"}, {"name": "src", "src_ip": "a"}]
    for given in (rules, routing.rule_table(spark, rules)):
        assert routing.allowlist_match(flows, given).first().allow_rule == "port"
    for given in (rules[1:], routing.rule_table(spark, rules[1:])):
        assert routing.allowlist_match(flows, given).first().allow_rule == "any"


def test_large_rule_table_without_exchanging_flows(spark, monkeypatch):
    rnd = random.Random(8)
    draw = {"src_ip": lambda: f"10.0.{rnd.randrange(40)}.{rnd.randrange(40)}", "dst_ip": lambda: f"8.8.{rnd.randrange(9)}.{rnd.randrange(99)}",
            "src_port": lambda: rnd.randrange(1024, 3000), "dst_port": lambda: rnd.randrange(1, 900), "proto": lambda: rnd.choice(["TCP", "UDP"])}
    shapes = [("src_ip", "dst_port"), ("dst_ip", "src_port", "proto"), ("src_ip", "dst_ip"), ("src_port", "dst_port"), tuple(draw)]
    rules = [{"name": f"r{i}", **{k: draw[k]() for k in shapes[i % 5]}} for i in range(100_000)]
    flows = [(i, *[None if rnd.random() < 0.05 else make() for make in draw.values()]) for i in range(3_000)]
    first = {}
    for i, r in enumerate(rules):
        first.setdefault(tuple(r.get(k) for k in draw), i)
    want = []
    for i, *values in flows:
        held = dict(zip(draw, values))
        hits = [first[key] for s in shapes if (key := tuple(held[k] if k in s else None for k in draw)) in first and None not in [held[k] for k in s]]
        want.append((i, f"r{min(hits)}" if hits else None))
    asked = spark.createDataFrame(flows, FLOW)
    table = routing.rule_table(spark, rules)
    got = routing.allowlist_match(asked, table)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert rows(got.select("flow_id", "allow_rule")) == rows(spark.createDataFrame(want, "a long, b string"))
    outer = plan.split("Subquery")[0]
    assert "Exchange" not in outer and "Join" not in outer
    monkeypatch.setattr(routing, "CLASSIFIER_RULES", 1_000)  # a larger table is joined, with the same result
    joined = routing.allowlist_match(asked, table)
    assert rows(joined.select("flow_id", "allow_rule")) == rows(got.select("flow_id", "allow_rule"))
    assert joined.columns == got.columns


def test_tiers(spark):
    df = spark.createDataFrame([(2.0, True), (2.0, False), (1.5, True), (0.9, False), (0.8, False), (0.7, False)],
                               "s double, a boolean")
    got = [r[0] for r in df.select(routing.severity_tier(F.col("s"), F.col("a"), 1.0)).collect()]
    assert got == ["emergency", "emergency", "critical", "warning", "warning", None]


def alerts(spark, events):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, t0 + timedelta(seconds=s), p, "x") for i, (s, p) in enumerate(events)],
                                 "flow_id long, ts timestamp, src_ip string, dst_ip string")


def admitted(df):
    return sorted(r.flow_id for r in df.where("admitted").collect())


def test_cooldown(spark):
    assert admitted(routing.alert_cooldown(alerts(spark, [(0, "a"), (0, "a"), (0, "b")]))) == [0, 2]
    assert admitted(routing.alert_cooldown(alerts(spark, [(0, "a"), (59, "a"), (60, "a"), (119, "a"), (121, "a")]))) == [0, 2, 4]


def test_global_limit(spark):
    burst = [(i, f"p{i}") for i in range(21)]
    assert admitted(routing.alert_rate_limit(alerts(spark, burst))) == list(range(20))
    # a globally rejected alert starts no cooldown: pair p20 passes as soon as the window has room
    later = burst + [(61, "p20")]
    assert admitted(routing.alert_rate_limit(alerts(spark, later))) == [*range(20), 21]


def brute(events, cooldown, limit, window):
    last, recent, out = {}, deque(), []
    for i, (t, p) in sorted(enumerate(events), key=lambda e: (e[1][0], e[0])):
        if p in last and t - last[p] < cooldown:
            continue
        while recent and recent[0] < t - window:
            recent.popleft()
        if len(recent) >= limit:
            continue
        last[p] = t
        recent.append(t)
        out.append(i)
    return sorted(out)


@pytest.mark.parametrize("seed,chunk", [(1, 7), (2, 40), (3, 1000)])
def test_global_limit_against_a_plain_loop(spark, seed, chunk):
    rng, t, events = random.Random(seed), 0, []
    for _ in range(400):
        t += rng.choice([0, 0, 1, 1, 2, 5, 9, 70 if rng.random() < 0.1 else 1])
        events.append((t, rng.choice("aaaabcdefghij")))
    got = admitted(routing.alert_rate_limit(alerts(spark, events), 60, 5, 60, chunk_rows=chunk))
    assert got == brute(events, 60, 5, 60)


def test_constant_load_takes_few_jobs(spark):
    events = [(t, f"p{t % 7}") for t in range(600)]  # the window is full all the time, every chunk depends on the one before
    context = spark.sparkContext
    context.setJobGroup("constant load", "")
    try:
        got = admitted(routing.alert_rate_limit(alerts(spark, events), 60, 5, 60, chunk_rows=20))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert got == brute(events, 60, 5, 60)
    assert len(context.statusTracker().getJobIdsForGroup("constant load")) < 250  # 30 chunks


def test_limit_with_earlier_admissions_and_odd_rows(spark):
    t0 = datetime(2024, 1, 1)
    data = [(None, t0, "a", "x"), (5, t0, "a", "x"), (6, None, "a", "x"), (7, t0, None, "x"), (8, t0 + timedelta(seconds=61), "c", "x")]
    df = spark.createDataFrame(data, "flow_id long, ts timestamp, src_ip string, dst_ip string")
    assert admitted(routing.alert_rate_limit(df, 60, 2, 60)) == [5, 7, 8]
    assert admitted(routing.alert_rate_limit(df, 60, 0, 60)) == []
    start = 1_704_067_200_000_000
    earlier = [(start - 1_000_000 * i, f"k{i}") for i in (1, 2, 3)]  # more than the limit
    assert admitted(routing.alert_rate_limit(df, 60, 2, 60, earlier=earlier)) == [8]


def test_payload_and_lines(spark):
    scored = spark.createDataFrame(
        [("critical", 0.1234567, "a", 1, "b", 2, "TCP", 7, datetime(2024, 1, 1), 1_234_567.0, 100.0, 50.0, 3.0, 2.0)],
        "severity string, score double, src_ip string, src_port int, dst_ip string, dst_port int, proto string, flow_id long, "
        "ts timestamp, `Flow Duration` double, `Total Length of Fwd Packets` double, `Total Length of Bwd Packets` double, "
        "`Total Fwd Packets` double, `Total Backward Packets` double")
    payload = routing.alert_payload(scored, 0.1)
    p = payload.first()
    assert len(payload.columns) == 16 and (p.score, p.ratio, p.duration_s) == (0.123457, 1.23, 1.235)
    assert routing.alert_syslog_line(payload).first().line == (
        "<134>flow-anomaly: severity=critical score=0.123457 threshold=0.1 src=a:1 dst=b:2 proto=TCP fwd_bytes=100 bwd_bytes=50")
    pushed = routing.alert_payload_loki(payload.withColumn("src_ip", F.lit(None).cast("string"))).first().payload
    assert '"src_ip":"unknown"' in pushed and '"1704067200000000000"' in pushed
