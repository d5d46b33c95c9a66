import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens import constants as K
from wirelens.functions.numeric import named, safe_div
from wirelens.functions.time import parse_event_ts
from wirelens.operators import flow_records as R

SCHEMA = ("flow_id string, src_ip string, dst_ip string, src_port int, dst_port int, proto string, ts timestamp, "
          "pkts_toserver long, pkts_toclient long, bytes_toserver long, bytes_toclient long, start_us long, "
          "end_us long, age long")
START = 1_774_432_800_000_000


def flow(spark, up, down, up_bytes, down_bytes, start=START, end=START, age=0, port=443):
    return spark.createDataFrame([("12345", "192.168.1.100", "10.0.0.1", 54321, port, "TCP", datetime(2026, 3, 25, 10),
                                   up, down, up_bytes, down_bytes, start, end, age)], SCHEMA)


def vector(df):
    r = df.first()
    return [r[n] for n in K.FEATURES_25]


def test_feature_contract():
    assert len(K.FEATURES_78) == len(set(K.FEATURES_78)) == 78
    assert len(K.FEATURES_25) == 25
    assert (len(K.EXACT_25), len(K.DERIVED_25), len(K.UNAVAILABLE_25)) == (9, 7, 9)


def test_good_flow(spark):
    out = R.eve_features_25(flow(spark, 10, 8, 5000, 3000, end=START + 5_000_000, age=5))
    v = vector(out)
    assert v[0] == 5_000_000 and v[1:6] == [10, 8, 5000, 3000, 500] and v[7] == 375
    assert v[6] == v[8] == v[23] == v[24] == 0
    assert v[9] == 8000 / 5 and v[10] == 18 / 5 and v[11] == 5_000_000 / 17
    assert not any(math.isnan(x) or math.isinf(x) for x in v)
    assert out.first().quality == "full" and out.first().src_port == 54321


def test_flow_without_packets_gives_no_row(spark):
    assert R.eve_features_25(flow(spark, 0, 0, 0, 0)).count() == 0
    assert R.eve_features_25(flow(spark, None, None, None, None)).count() == 0


def test_short_flow_is_partial(spark):
    assert R.eve_features_25(flow(spark, 1, 1, 100, 50)).first().quality == "partial"


def test_age_is_the_fallback_duration(spark):
    assert vector(R.eve_features_25(flow(spark, 3, 3, 10, 10, age=7)))[0] == 7_000_000
    assert vector(R.eve_features_25(flow(spark, 3, 3, 10, 10, start=START + 9, age=0)))[0] == 0


def test_78_vector(spark):
    r = R.eve_features_78(flow(spark, 20, 15, 10000, 8000, age=10, port=80)).first()
    v = [r[n] for n in K.FEATURES_78]
    assert [v[i] for i in (0, 2, 3, 4, 5)] == [80, 20, 15, 10000, 8000] and len(v) == 78
    zero_age = R.eve_features_78(flow(spark, 1, 0, 60, 0)).first()
    assert zero_age["Flow Bytes/s"] == 0


def test_safe_div(spark):
    one = spark.range(1)
    ten, two, zero = F.lit(10), F.lit(2), F.lit(0)
    assert one.select(safe_div(ten, two), safe_div(ten, zero), safe_div(ten, zero, -1.0)).first()[:] == (5.0, 0.0, -1.0)


def test_parse_event_ts(spark):
    df = spark.createDataFrame([("2026-02-16T18:25:21.511588+00:00",), ("2026-02-16T18:25:21.511588-0800",),
                                ("not-a-date",), (None,)], "t string")
    got = [r[0] for r in df.select(parse_event_ts(F.col("t"))).collect()]
    assert got == [1771266321511588, 1771266321511588 + 8 * 3_600_000_000, 0, 0]


def test_stats_summary(spark):
    good = flow(spark, 5, 5, 10, 10, age=1)
    df = good
    for _ in range(7):
        df = df.unionByName(good)
    df = df.unionByName(flow(spark, 1, 0, 1, 0)).unionByName(flow(spark, 0, 0, 0, 0))
    s = R.extraction_stats(df, 2).first()
    assert (s.total_processed, s.successful, s.skipped_no_packets, s.success_rate) == (10, 8, 2, "80.0%")


def test_subset_order_and_unknown_names(spark):
    wide = R.eve_features_78(flow(spark, 20, 15, 10000, 8000, age=10))
    assert R.feature_subset(wide, ["Flow Duration", "Destination Port"]).columns == ["Flow Duration", "Destination Port"]
    with pytest.raises(ValueError, match="unknown"):
        R.feature_subset(wide, ["nope"])
    vec = wide.select(F.array(*[named(n) for n in K.FEATURES_78]).alias("v"))
    got = vec.select(R.subset_vector(F.col("v"))).first()[0]
    assert got == list(R.feature_subset(wide, K.FEATURES_25).first())


def test_nested_form(spark):
    f = R.feature_metadata_struct(R.eve_features_25(flow(spark, 10, 8, 5000, 3000, age=5))).first()
    assert len(f.features) == 25 and f.metadata.unavailable_count == 9 and f.metadata.flow_id == "12345"
