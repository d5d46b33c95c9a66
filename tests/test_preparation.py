import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens.operators import preparation as P
from wirelens.operators.skew import exact_percentile, global_percentile, rank_within


def test_clean_drops_infinite_and_missing(spark):
    inf, nan = float("inf"), float("nan")
    assert P.clean_nonfinite_rows(spark.createDataFrame([(1.0, 4.0), (inf, 5.0), (3.0, -inf)], "a double, b double")).count() == 1
    assert P.clean_nonfinite_rows(spark.createDataFrame([(1.0, 4.0), (nan, 5.0), (3.0, 6.0)], "a double, b double")).count() == 2
    assert P.clean_nonfinite_rows(spark.createDataFrame([(1.0, None)], "a double, Label string")).count() == 0
    report = P.clean_report(spark.createDataFrame([(1.0,), (nan,), (None,)], "a double")).first()
    assert (report.rows, report.dropped, report.dropped_percent) == (3, 2, 66.67)


def test_trim_and_label_column(spark):
    df = spark.createDataFrame([(1, 2, "x")], " col1 int, `col2 ` int, ` Label` string")
    assert P.trim_columns(df).columns == ["col1", "col2", "Label"]
    assert P.detect_label_column(df) == " Label"
    with pytest.raises(ValueError, match="No label column"):
        P.detect_label_column(spark.range(1))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 5))
    labels = rng.choice(["BENIGN", "DoS", "Probe"], 200)
    return spark.createDataFrame([(i, *map(float, r), str(c)) for i, (r, c) in enumerate(zip(x, labels))],
                                 "id long, feat_0 double, feat_1 double, feat_2 double, feat_3 double, feat_4 double, Label string")


FEATS = [f"feat_{i}" for i in range(5)]


def test_preparation_of_a_small_table(labelled):
    classes = P.label_classes(labelled, "Label")
    assert classes == ["BENIGN", "DoS", "Probe"]
    encoded = P.label_encode(labelled, classes, "Label")
    assert encoded.where("class_id is null").count() == 0
    assert P.label_decode(encoded, classes, out="again").where("again <> Label").count() == 0
    split = P.stratified_split(encoded, "Label", "id")
    train = split.where("split = 'train'")
    scaler = P.scaler_fit(train, FEATS)
    assert len(scaler.mean) == 5
    scaled = P.scaler_transform(train, scaler)
    for f in FEATS:
        m, s = scaled.agg(F.avg(f), F.stddev_pop(f)).first()
        assert abs(m) < 1e-9 and abs(s - 1) < 1e-9
    weights = P.class_weights(train, "Label").collect()
    assert len(weights) == 3 and all(w.weight > 0 for w in weights) and abs(sum(w.weight for w in weights) - 3) < 1e-9


def test_split_is_stratified_and_repeatable(labelled):
    first = P.stratified_split(labelled, "Label", "id")
    assert rows(first.select("id", "split")) == rows(P.stratified_split(labelled.repartition(7), "Label", "id").select("id", "split"))
    assert rows(first.select("id", "split")) != rows(P.stratified_split(labelled, "Label", "id", seed=1).select("id", "split"))
    n = {(r.Label, r.split): r["count"] for r in first.groupBy("Label", "split").count().collect()}
    for label in ("BENIGN", "DoS", "Probe"):
        size = sum(v for (l, _), v in n.items() if l == label)
        assert abs(n[label, "train"] - 0.7 * size) <= 0.5 and abs(n[label, "val"] - 0.15 * size) <= 1


def test_constant_feature_keeps_scale_one(spark):
    s = P.scaler_fit(spark.createDataFrame([(2.0,), (2.0,)], "a double"), ["a"])
    assert s.mean == [2.0] and s.scale == [1.0]


def test_any_number_of_classes(spark):
    many = spark.range(12_000).select(F.format_string(" c%05d ", F.col("id")).alias("label"), "id")
    odd = many.limit(1).withColumn("label", F.lit(None).cast("string"))
    table = P.class_table(many.unionByName(odd))
    encoded = P.label_encode(many.unionByName(odd), table)
    assert encoded.count() == 12_001 and encoded.where("label is null and class_id is not null").count() == 0
    assert encoded.where("label is not null and not (class_id <=> id)").count() == 0
    assert P.label_decode(encoded.drop("label"), table).where("label <> format_string('c%05d', id)").count() == 0


def test_rank_within_equals_row_number(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 == 0, None).otherwise("hot").alias("k"),
                                  (F.col("id") * 7919 % 997).alias("v"), "id")
    got = rank_within(df.withColumn("b", F.floor(F.col("v") / 50)), ["k"], "b", [F.col("v"), F.col("id")])
    from pyspark.sql import Window
    want = df.withColumn("want", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")) - 1)
    assert got.join(want.select("id", "want"), "id").where("rank <> want").count() == 0
    assert got.count() == 1000


@pytest.mark.parametrize("accuracy", [50, 100_000])
@pytest.mark.parametrize("p", [0.0, 0.5, 0.95, 1.0])
def test_percentile_is_exact(spark, accuracy, p):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.exponential(size=4000), np.zeros(1500)])
    df = spark.createDataFrame([(int(i % 2), float(v)) for i, v in enumerate(values)], "k int, v double")
    want = {k: np.percentile(values[k::2], p * 100) for k in (0, 1)}
    got = {r.k: r.q for r in exact_percentile(df, ["k"], "v", p, "q", accuracy).collect()}
    assert got == pytest.approx(want)
    assert global_percentile(df, "v", p, accuracy) == pytest.approx(np.percentile(values, p * 100))


def test_percentile_of_nothing(spark):
    assert global_percentile(spark.createDataFrame([], "v double"), "v", 0.5) is None
