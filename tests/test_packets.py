import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from conftest import rows
from wirelens import schemas
from wirelens.operators import packets as P
from wirelens.operators.skew import greedy_starts

T0 = datetime(2024, 1, 1)


def packets(spark, times, **fixed):
    base = dict(src="10.0.0.1", dst="10.0.0.2", sport=1000, dport=80, proto=6, size=100, flags=0x18)
    data = []
    for i, t in enumerate(times):
        us, over = (t if isinstance(t, tuple) else (t, {}))
        r = {**base, **fixed, **over}
        data.append((i, T0 + timedelta(microseconds=us), r["src"], r["dst"], r["sport"], r["dport"], r["proto"],
                     r["size"], r["flags"]))
    return spark.createDataFrame(data, schemas.PACKET)


BACK = {"src": "10.0.0.2", "dst": "10.0.0.1", "sport": 80, "dport": 1000}
S = 1_000_000


def test_key_is_the_same_both_ways(spark):
    out = P.packet_flow_key(packets(spark, [0, (1, BACK)])).orderBy("us").collect()
    assert [r.direction for r in out] == [0, 1]
    assert out[0].ip_a == out[1].ip_a == "10.0.0.1" and out[0].port_b == out[1].port_b == 80


def test_ports_only_for_tcp_and_udp(spark):
    icmp = P.packet_flow_key(packets(spark, [0], proto=1)).first()
    assert (icmp.port_a, icmp.port_b, icmp.flags) == (0, 0, 0)
    assert P.packet_flow_key(packets(spark, [0], proto=17)).first().flags == 0
    assert P.packet_flow_key(packets(spark, [(0, {"src": None})])).count() == 0


def test_packet_at_the_gap_stays(spark):
    assert P.flow_sessions_idle(packets(spark, [0, 15 * S])).count() == 1
    assert P.flow_sessions_idle(packets(spark, [0, 15 * S + 1])).count() == 2


def test_long_flow_is_cut_by_age(spark):
    steps = [i * 10 * S for i in range(0, 130)]
    flows = P.flow_direction_totals(packets(spark, steps)).orderBy("start_us").collect()
    base = flows[0].start_us
    assert [(f.start_us - base) // S for f in flows] == [0, 610, 1220]
    assert [f.fwd_pkts for f in flows] == [61, 61, 8]
    assert all(f.duration_us <= 600 * S for f in flows)


def brute_starts(times, gap, strict):
    out, last = [], None
    for t in sorted(times):
        if last is None or (t - last > gap if strict else t - last >= gap):
            out.append(t)
            last = t
    return out


def test_greedy_starts_against_a_plain_loop(spark):
    rng = random.Random(7)
    events, want = [], {True: [], False: []}
    for key in range(12):
        t, times = 0, []
        for _ in range(rng.choice([1, 5, 200])):
            t += rng.choice([0, 1, 3, 10, 10, 25, 99, 100, 101, 400])
            times.append(t)
        events += [(key, x) for x in times]
        for strict in want:
            want[strict] += [(key, x) for x in brute_starts(times, 100, strict)]
    df = spark.createDataFrame(events, "k int, us long")
    for strict in (True, False):
        got = rows(greedy_starts(df, ["k"], "us", 100, strict).select("k", "us"))
        assert sorted(got) == sorted(want[strict])


def test_gaps_carry_over_buckets(spark):
    times = [0, (7 * S, BACK), 14 * S, 16 * S, (29 * S, BACK), 31 * S, 60 * S]
    got = P.flow_iat_stats(packets(spark, times), 15).orderBy("start_us").collect()
    first, second = got
    assert (first.iat_total, first.iat_max, first.iat_min, first.iat_mean) == (31e6, 13e6, 0, 31e6 / 6)
    assert (first.iat_fwd_total, first.iat_fwd_max, first.iat_fwd_min) == (31e6, 15e6, 2e6)
    assert (first.iat_bwd_total, first.iat_bwd_mean, first.iat_bwd_std) == (22e6, 22e6, 0)
    assert second.iat_total == 0 and second.iat_std == 0
    plain = P.flow_iat_stats(packets(spark, times), 15, leading_zero_gap=False).orderBy("start_us").first()
    assert plain.iat_min == 2e6 and plain.iat_mean == 31e6 / 5


def test_flags_and_rates(spark):
    r = P.flow_features_78(packets(spark, [(0, {"flags": 0x02}), (S, {"flags": 0x29})])).first()
    assert (r["SYN Flag Count"], r["FIN Flag Count"], r["PSH Flag Count"], r["URG Flag Count"]) == (1, 1, 1, 1)
    assert (r["Fwd PSH Flags"], r["Bwd PSH Flags"], r["Fwd URG Flags"], r["Bwd URG Flags"]) == (1, 0, 1, 0)
    assert r["Flow Packets/s"] == 2 and r["Down/Up Ratio"] == 0 and r["Bwd Packet Length Max"] == 0
    single = P.flow_features_78(packets(spark, [0])).first()
    assert single["Flow Duration"] == 0 and single["Flow Packets/s"] == 1e6


def test_hot_flow_is_spread_over_buckets(spark):
    keyed = P._bucketed(packets(spark, [i * S for i in range(1000)]), 15 * S)
    assert keyed.groupBy(*P.KEY, "bucket").count().agg(F.max("count")).first()[0] == 15
    assert P.flow_sessions_idle(packets(spark, [i * S for i in range(1000)])).first().packets == 1000
