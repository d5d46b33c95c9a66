from wirelens.operators import counters

S = 1_000_000


def samples(spark, values, le=1.0, instance=0):
    return spark.createDataFrame([(instance, le, t * S, float(v)) for t, v in values], "instance long, le double, us long, value double")


def test_rate_with_a_restart(spark):
    # 0, 60, 120, 180, 240: the counter falls to 5 at 180, so 30 + 20 + 5 + 15 were counted
    rate = counters.counter_rate(samples(spark, [(0, 100), (60, 130), (120, 150), (180, 5), (240, 20)]), ["instance", "le"], 300).first()
    assert (rate.window_us, rate.n) == (0, 5) and abs(rate.rate - 70 * (240 + 0 + 60) / 240 / 300) < 1e-12


def test_rate_is_not_carried_below_zero_or_far(spark):
    one = counters.counter_rate(samples(spark, [(50, 1), (60, 11)]), ["instance", "le"], 300).first()
    assert abs(one.rate - 10 * (10 + 1 + 5) / 10 / 300) < 1e-12  # zero lies 1 s ahead; the end is far: half a distance
    assert counters.counter_rate(samples(spark, [(50, 1)]), ["instance", "le"], 300).count() == 0
    assert counters.counter_rate(samples(spark, [(50, 1), (50, 2)]), ["instance", "le"], 300).count() == 0
    assert counters.counter_rate(samples(spark, []), ["instance", "le"], 300).count() == 0


def quantile(spark, buckets, p=0.95):
    df = spark.createDataFrame([(0, float(le), float(r)) for le, r in buckets], "window_us long, le double, rate double")
    return counters.histogram_quantile(df, ["window_us"], p, "q").first().q


def test_quantile_inside_a_bucket(spark):
    inf = float("inf")
    assert abs(quantile(spark, [(0.1, 50), (0.5, 90), (1, 100), (inf, 100)]) - 0.75) < 1e-12
    assert abs(quantile(spark, [(0.1, 100), (inf, 100)], 0.5) - 0.05) < 1e-12
    assert quantile(spark, [(0.1, 10), (0.5, 20), (inf, 100)]) == 0.5  # beyond the last finite bound
    assert quantile(spark, [(-1, 100), (inf, 100)], 0.5) == -1
    assert abs(quantile(spark, [(0.1, 50), (0.5, 49.9), (1, 100), (inf, 100)]) - 0.95) < 1e-12  # a dip counts as level
    for nothing in ([(0.1, 0), (inf, 0)], [(0.1, 5), (0.5, 6)], [(inf, 5)]):
        assert quantile(spark, nothing) is None


def test_histograms_merge_over_instances(spark):
    inf = float("inf")
    both = None
    for instance, counts in ((0, [8, 10]), (1, [0, 10])):
        for le, n in zip((0.1, inf), counts):
            rows = samples(spark, [(0, 0), (100, n), (200, 2 * n), (299, 3 * n)], le, instance)
            both = rows if both is None else both.unionByName(rows)
    out = counters.latency_p95_histogram(both, 300, 0.05, 0.4).first()
    assert abs(out.latency - 0.1) < 1e-9 and out.firing == 1
