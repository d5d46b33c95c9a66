"""Preparation of labelled data."""

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.catalog.flows import features_cte, sql_rounded, rounded, _features, _STATS, _z
from wirelens.catalog.registry import oracle, query
from wirelens.functions.numeric import named
from wirelens.operators import flow_records as R, preparation as P
from wirelens.session import cut_lineage
from wirelens.sources import views

V = ["v_labelled"]
F4 = ["f0", "f1", "f2", "f3"]
CLEAN = {"clean": "SELECT * FROM v_labelled WHERE f1 IS NOT NULL AND NOT isinf(f1)"}
SEED = 42


def _clean(spark, sf):
    return P.clean_nonfinite_rows(views.labelled(spark, sf))


@query("clean_nonfinite_rows")
def _(spark, sf):
    return _clean(spark, sf)


oracle("clean_nonfinite_rows", V, "SELECT * FROM clean", CLEAN)


@query("clean_report")
def _(spark, sf):
    return P.clean_report(views.labelled(spark, sf))


oracle("clean_report", V, """SELECT count(*) AS rows, count(*) FILTER (f1 IS NULL OR isinf(f1)) AS dropped,
 round_even(100.0 * count(*) FILTER (f1 IS NULL OR isinf(f1)) / count(*), 2) AS dropped_percent FROM v_labelled""")


@query("label_encode")
def _(spark, sf):
    d = _clean(spark, sf)
    return P.label_encode(d, P.class_table(d)).select("row_id", "label", "class_id")


oracle("label_encode", V, """SELECT row_id, label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INT) AS class_id
 FROM clean""", CLEAN)


@query("label_decode")
def _(spark, sf):
    d = views.vectors(spark, sf).withColumnRenamed("label", "class_id")
    classes = P.class_table(_clean(spark, sf))
    return P.label_decode(d, classes).select("vec_id", "class_id", "label")


oracle("label_decode", [*V, "v_vectors"], """SELECT vec_id, v.label AS class_id, c.label AS label FROM v_vectors v
 LEFT JOIN (SELECT label, row_number() OVER (ORDER BY label) - 1 AS id FROM (SELECT DISTINCT label FROM clean)) c
 ON c.id = v.label""", CLEAN)


@query("class_distribution")
def _(spark, sf):
    return P.class_distribution(_clean(spark, sf))


oracle("class_distribution", V, "SELECT label, count(*) AS rows FROM clean GROUP BY label", CLEAN)

SPLIT = {**CLEAN, "split": f"""SELECT *, CASE WHEN (2 * r + 1) * 100 < 2 * n * 70 THEN 'train'
 WHEN (2 * r + 1) * 100 < 2 * n * 85 THEN 'val' ELSE 'test' END AS split FROM (SELECT *,
 row_number() OVER (PARTITION BY label ORDER BY md5(row_id || '|{SEED}'), row_id) - 1 AS r,
 count(*) OVER (PARTITION BY label) AS n FROM clean)"""}


def _split(spark, sf):
    return P.stratified_split(_clean(spark, sf), "label", "row_id", SEED)


@query("stratified_split")
def _(spark, sf):
    return _split(spark, sf).select("row_id", "label", "split")


oracle("stratified_split", V, "SELECT row_id, label, split FROM split", SPLIT)


@query("scaler_fit")
def _(spark, sf):
    train = _split(spark, sf).where("split = 'train'")
    fitted = P.scaler_fit(train, F4).table(spark)
    return fitted.select("pos", "feature", *rounded(["mean", "scale"]))


oracle("scaler_fit", V, " UNION ALL ".join(
    f"""SELECT {i} AS pos, '{f}' AS feature, round(avg({f}), 6) AS mean, round(stddev_pop({f}), 6) AS scale
 FROM split WHERE split = 'train'""" for i, f in enumerate(F4)), SPLIT)


@query("scaler_transform")
def _(spark, sf):
    split = cut_lineage(_split(spark, sf))
    scaler = P.scaler_fit(split.where("split = 'train'"), F4)
    return P.scaler_transform(split, scaler).select("row_id", "split", *rounded(F4))


oracle("scaler_transform", V, "SELECT row_id, split, " + ", ".join(
    f"round(({f} - m_{f}) / s_{f}, 6) AS {f}" for f in F4) + " FROM split, (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, stddev_pop({f}) AS s_{f}" for f in F4) + " FROM split WHERE split = 'train')", SPLIT)


@query("class_weights")
def _(spark, sf):
    train = _split(spark, sf).where("split = 'train'")
    return P.class_weights(train).select("label", "rows", F.round("weight", 6).alias("weight"))


oracle("class_weights", V, """SELECT label, rows, round((1.0 / rows) / sum(1.0 / rows) OVER () * count(*) OVER (), 6)
 AS weight FROM (SELECT label, count(*) AS rows FROM split WHERE split = 'train' GROUP BY label)""", SPLIT)


@query("range_check")
def _(spark, sf):
    f = cut_lineage(_features(spark, sf))
    scaler = P.scaler_fit(f, K.FEATURES_25)
    out = P.range_check(f, scaler, ["flow_id"], 3.0)
    return out.select("flow_id", "feature", F.round("z", 6).alias("z"))


oracle("range_check", ["v_eve_flow"], " UNION ALL ".join(
    f"SELECT flow_id, '{n}' AS feature, round(abs({_z(n)}), 6) AS z FROM feats, stats WHERE abs({_z(n)}) > 3"
    for n in K.FEATURES_25), {**features_cte(), "stats": f"SELECT {_STATS} FROM feats"})


@query("zero_feature_impact")
def _(spark, sf):
    # features a flow record cannot give, taken from the packet-level statistics of the labelled table
    measured = views.labelled(spark, sf).where("f1 IS NOT NULL AND f1 < double('inf')")
    stand_in = measured.select(*[(named(F4[i % 4]) * (i + 1)).alias(n) for i, n in enumerate(K.FEATURES_25)])
    scaler = P.scaler_fit(stand_in, K.FEATURES_25)
    return P.zero_feature_impact(scaler.table(spark), R.provenance(spark))


oracle("zero_feature_impact", V, " UNION ALL ".join(
    f"""SELECT '{n}' AS feature, 0.0::DOUBLE AS raw_value, round_even(-avg(x) / stddev_pop(x), 4) AS normalized_value,
 round_even(avg(x), 4) AS training_mean, round_even(stddev_pop(x), 4) AS training_scale
 FROM (SELECT f{K.FEATURES_25.index(n) % 4} * {K.FEATURES_25.index(n) + 1} AS x FROM clean)"""
    for n in K.UNAVAILABLE_25), CLEAN)


@query("sample_rows")
def _(spark, sf):
    return P.sample_rows(_clean(spark, sf), "row_id", 1000, SEED)


oracle("sample_rows", V, f"SELECT * FROM clean ORDER BY md5(row_id || '|{SEED}'), row_id LIMIT 1000", CLEAN)
