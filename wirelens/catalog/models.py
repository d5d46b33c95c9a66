"""Scoring, evaluation, perturbation, and the global alert limit."""

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.catalog.flows import ALLOW_SQL, DAY, _STATS, _features, _z, features_cte, rounded, scored_ctes, scored_flows
from wirelens.catalog.registry import oracle, query
from wirelens.functions.numeric import named
from wirelens.operators import preparation as P, robustness as B, routing, scoring as S
from wirelens.session import cut_lineage
from wirelens.sources import views

V = ["v_vectors"]
CLASSES, WIDTH = 10, 64
WEIGHTS = [[((c * 7 + j * 3) % 11 - 5) / 10 for j in range(WIDTH)] for c in range(CLASSES)]
MODEL = S.LinearModel(WEIGHTS, [0.0] * CLASSES, [f"class-{c}" for c in range(CLASSES)])
EPS = 0.05


def _scored(spark, sf):
    return S.score_linear_softmax(views.vectors(spark, sf), MODEL, "embedding")


_ROWS = [f"[{', '.join(map(str, row))}]::DOUBLE[]" for row in WEIGHTS]
_COLS = [f"[{', '.join(str(WEIGHTS[c][j]) for c in range(CLASSES))}]::DOUBLE[]" for j in range(WIDTH)]


def _scored_ctes(source="v_vectors", prefix=""):
    return {
        prefix + "lg": f"SELECT *, [{', '.join(f'list_dot_product(embedding::DOUBLE[], {w})' for w in _ROWS)}] AS z FROM {source}",
        prefix + "ex": f"SELECT *, [exp(v - list_max(z)) FOR v IN z] AS e FROM {prefix}lg",
        prefix + "scored": f"""SELECT *, [v / list_sum(e) FOR v IN e] AS p,
 CAST(list_position(z, list_max(z)) - 1 AS INT) AS class_id FROM {prefix}ex"""}


@query("score_linear_softmax")
def _(spark, sf):
    return _scored(spark, sf).select("vec_id", "class_id", "prediction", F.round("confidence", 6).alias("confidence"))


_SCORE_SQL = """SELECT vec_id, class_id, 'class-' || class_id AS prediction, round(list_max(p), 6) AS confidence FROM scored"""
oracle("score_linear_softmax", V, _SCORE_SQL, _scored_ctes())


def load_linear():
    """Loader of the vectorised form of the same model."""
    w = MODEL.matrix()
    return lambda matrix: matrix @ w.T


@query("score_model_udf")
def _(spark, sf):
    scored = S.score_model_udf(views.vectors(spark, sf), load_linear, "linear", "embedding", MODEL.classes)
    return scored.select("vec_id", "class_id", "prediction", F.round("confidence", 6).alias("confidence"))


oracle("score_model_udf", V, _SCORE_SQL, _scored_ctes())


@query("probability_map")
def _(spark, sf):
    p = S.probability_map(F.col("probabilities"), MODEL.classes)
    scored = _scored(spark, sf).withColumn("m", p)
    return scored.select("vec_id", F.size("m").alias("n"),
                         *[F.round(F.col("m")[c], 6).alias(c) for c in MODEL.classes])


oracle("probability_map", V, f"SELECT vec_id, {CLASSES} AS n, " + ", ".join(
    f'round(p[{i + 1}], 6) AS "{c}"' for i, c in enumerate(MODEL.classes)) + " FROM scored", _scored_ctes())


@query("confident_detections")
def _(spark, sf):
    return S.confident_detections(views.predictions(spark, sf)).select("event_id", "prediction", "confidence", "attack")


oracle("confident_detections", ["v_predictions"], """SELECT event_id, prediction, confidence,
 CASE WHEN prediction <> 'BENIGN' THEN 1 ELSE 0 END AS attack FROM v_predictions WHERE confidence >= 0.7""")


@query("prediction_counts")
def _(spark, sf):
    return S.prediction_counts(views.predictions(spark, sf))


oracle("prediction_counts", ["v_predictions"], """SELECT prediction, count(*) AS predictions FROM v_predictions
 GROUP BY prediction""")


@query("accuracy_eval")
def _(spark, sf):
    return S.accuracy_eval(_scored(spark, sf)).select("rows", *rounded(["accuracy", "loss"]))


oracle("accuracy_eval", V, """SELECT count(*) AS rows, round(avg(CASE WHEN class_id = label THEN 1.0 ELSE 0 END), 6) AS accuracy,
 round(avg(-ln(p[label + 1])), 6) AS loss FROM scored""", _scored_ctes())


@query("per_class_accuracy")
def _(spark, sf):
    return S.per_class_accuracy(_scored(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


oracle("per_class_accuracy", V, """SELECT label AS true_class, count(*) FILTER (class_id = label) AS correct, count(*) AS total,
 round(count(*) FILTER (class_id = label) / count(*), 6) AS accuracy FROM scored GROUP BY label""", _scored_ctes())



def _udp():
    return F.col("proto") == "UDP"


@query("anomaly_eval")
def _(spark, sf):
    features = cut_lineage(_features(spark, sf))
    scaler = P.scaler_fit(features.where(~_udp()), K.FEATURES_25)
    scored = S.anomaly_score(P.scaler_transform(features, scaler), K.FEATURES_25)
    threshold = S.anomaly_threshold(scored, ~_udp())
    return S.anomaly_eval(scored, _udp(), threshold).select(*rounded(
        ["benign_error", "attack_error", "recall", "false_positive_rate", "separation"]))


oracle("anomaly_eval", ["v_eve_flow"], """SELECT *, round(a / b, 6) AS separation FROM (SELECT round(b, 6) AS benign_error,
 round(a, 6) AS attack_error, recall, false_positive_rate, a, b FROM (SELECT avg(score) FILTER (proto <> 'UDP') AS b,
 avg(score) FILTER (proto = 'UDP') AS a, round(avg(CASE WHEN score > t THEN 1.0 ELSE 0 END) FILTER (proto = 'UDP'), 6) AS recall,
 round(avg(CASE WHEN score > t THEN 1.0 ELSE 0 END) FILTER (proto <> 'UDP'), 6) AS false_positive_rate FROM scored, thr))""".replace(
    "SELECT *, round(a / b, 6) AS separation", "SELECT * EXCLUDE (a, b), round(a / b, 6) AS separation"), {
    **features_cte(), "stats": f"SELECT {_STATS} FROM feats WHERE proto <> 'UDP'",
    "scored": scored_ctes()["scored"], "thr": "SELECT quantile_cont(score, 0.95) AS t FROM scored WHERE proto <> 'UDP'"})


@query("anomaly_score_pca")
def _(spark, sf):
    features = cut_lineage(_features(spark, sf))
    scaler = P.scaler_fit(features, K.FEATURES_25)
    scaled = P.scaler_transform(features, scaler)
    return S.anomaly_score_pca(scaled, K.FEATURES_25, scaled).select("flow_id", F.round("score", 4).alias("score"))


F4 = ["f0", "f1", "f2", "f3"]


def _training(spark, sf):
    clean = P.clean_nonfinite_rows(views.labelled(spark, sf))
    split = P.stratified_split(clean, "label", "row_id").where("split = 'train'")
    classes = P.label_classes(clean)
    train = cut_lineage(P.label_encode(split, classes))
    scaler = P.scaler_fit(train, F4)
    return P.scaler_transform(train, scaler), classes


@query("train_classifier")
def _(spark, sf):
    train, classes = _training(spark, sf)
    weights = {classes.index(r.label): r.weight for r in P.class_weights(train).collect()}
    model = S.train_classifier(train, F4, "class_id", len(classes), weights=weights, maxIter=20)
    out = model.transform(S.training_frame(train, F4, "class_id"))
    return (out.groupBy(F.col("y").cast("int").alias("class_id"))
            .agg(F.count("*").alias("rows"), F.count_if(F.col("prediction") == F.col("y")).alias("right")))


@query("feature_importance")
def _(spark, sf):
    train, _classes = _training(spark, sf)
    return S.feature_importance(train, F4, "class_id")


# --- perturbation ------------------------------------------------------------------
BOX = dict(clip_min=-1.0, clip_max=1.0)


def _vectors(spark, sf):
    return views.vectors(spark, sf).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))


@query("perturb_fgsm")
def _(spark, sf):
    moved = B.perturb_fgsm(_vectors(spark, sf), MODEL, "embedding", "label", EPS, **BOX)
    return moved.select("vec_id", *[F.round(F.col("embedding")[j], 6).alias(f"x{j}") for j in range(WIDTH)])


_FGSM = {**_scored_ctes(), "miss": """SELECT *, list_transform(p, lambda v, i: v - CASE WHEN i = label + 1 THEN 1 ELSE 0 END) AS d
 FROM scored"""}
_MOVED = [f"least(greatest(embedding[{j + 1}]::DOUBLE + {EPS} * sign(list_dot_product(d, {w})), -1), 1)"
          for j, w in enumerate(_COLS)]
oracle("perturb_fgsm", V, "SELECT vec_id, " + ", ".join(
    f"round({m}, 6) AS x{j}" for j, m in enumerate(_MOVED)) + " FROM miss", _FGSM)


@query("perturb_pgd")
def _(spark, sf):
    moved = B.perturb_pgd(_vectors(spark, sf), MODEL, "embedding", "label", "vec_id", EPS, num_steps=20, **BOX)
    return moved.select("vec_id", "label", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@query("perturb_cw")
def _(spark, sf):
    moved = B.perturb_cw(_vectors(spark, sf), MODEL, "embedding", "label", "vec_id", **BOX)
    return moved.select("vec_id", "label", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@query("robustness_eval")
def _(spark, sf):
    attacks = {"fgsm": B.get_attack("fgsm", epsilon=EPS, **BOX),
               "pgd": B.get_attack("pgd", epsilon=EPS, num_steps=20, **BOX),
               "cw": B.get_attack("cw", num_steps=50, **BOX)}
    return B.robustness_eval(_vectors(spark, sf), MODEL, "embedding", "label", "vec_id", attacks)


# --- the global limit ----------------------------------------------------------------
HOUR6 = 6 * 3600


@query("alert_rate_limit")
def _(spark, sf):
    alerts = views.ids_alerts(spark, sf)
    out = routing.alert_rate_limit(alerts, HOUR6, 5, HOUR6, row_id="event_id", pair=("src_ip", "dest_ip"))
    return out.select("event_id", F.col("admitted").cast("int").alias("admitted"))


_STEP = HOUR6 * 1_000_000
oracle("alert_rate_limit", ["v_ids_alerts"], """SELECT e.event_id, CASE WHEN a.event_id IS NULL THEN 0 ELSE 1 END AS admitted
 FROM ev e LEFT JOIN adm a USING (event_id)""", {
    "ev": "SELECT event_id, epoch_us(ts) AS us, src_ip || '>' || dest_ip AS pair FROM v_ids_alerts",
    "adm": f"""SELECT event_id, us, [{{'u': us, 'p': pair}}] AS st FROM (SELECT * FROM ev ORDER BY us, event_id LIMIT 1)
 UNION ALL SELECT event_id, us, st FROM (SELECT e.event_id, e.us,
  list_filter(a.st, lambda x: x.u >= e.us - {_STEP}) || [{{'u': e.us, 'p': e.pair}}] AS st,
  row_number() OVER (ORDER BY e.us, e.event_id) AS n
  FROM adm a JOIN ev e ON (e.us, e.event_id) > (a.us, a.event_id)
  WHERE len(list_filter(a.st, lambda x: x.p = e.pair AND e.us - x.u < {_STEP})) = 0
  AND len(list_filter(a.st, lambda x: x.u >= e.us - {_STEP})) < 5) WHERE n = 1"""}, recursive=True)
