import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens.functions.numeric import first_argmax, softmax
from wirelens.operators import preparation as P, robustness as B, scoring as S

RNG = np.random.default_rng(3)
W = RNG.normal(size=(4, 6))
MODEL = S.LinearModel(W.tolist(), [0.1, -0.2, 0.0, 0.3], list("abcd"))
X = RNG.uniform(size=(40, 6))
Y = RNG.integers(0, 4, size=40)


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame([(i, [float(v) for v in x], int(y)) for i, (x, y) in enumerate(zip(X, Y))],
                                 "id long, x array<double>, y int")


def probs(x):
    z = x @ W.T + np.array(MODEL.bias)
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def matrix(df):
    return np.array([r.x for r in df.orderBy("id").collect()])


def test_softmax_of_logits(spark):
    df = spark.createDataFrame([([0.1, 0.8, 0.1],), ([700.0, 800.0, 100.0],), ([1.0, 1.0, 0.0],)], "z array<double>")
    got = df.select(softmax(F.col("z")).alias("p"), first_argmax(F.col("z")).alias("c")).collect()
    assert [r.c for r in got] == [1, 1, 0]
    assert all(abs(sum(r.p) - 1) < 1e-12 and 0 <= max(r.p) <= 1 for r in got)


def test_scores_agree_with_numpy(data):
    scored = S.score_linear_softmax(data, MODEL, "x").orderBy("id").collect()
    assert np.allclose([r.probabilities for r in scored], probs(X))
    assert [r.class_id for r in scored] == list(probs(X).argmax(axis=1))
    assert scored[0].prediction == MODEL.classes[scored[0].class_id]
    loss = S.accuracy_eval(S.score_linear_softmax(data, MODEL, "x"), "y").first()
    assert loss.loss == pytest.approx(-np.log(probs(X)[np.arange(40), Y]).mean())
    assert loss.accuracy == pytest.approx((probs(X).argmax(axis=1) == Y).mean())


def test_model_udf_gives_the_same(data):
    w, b = np.array(MODEL.weights), np.array(MODEL.bias)

    def load():
        return lambda m: m @ w.T + b
    a = S.score_model_udf(data, load, "test", "x", MODEL.classes).select("id", "class_id", F.round("confidence", 9))
    b = S.score_linear_softmax(data, MODEL, "x").select("id", "class_id", F.round("confidence", 9))
    assert rows(a) == rows(b)


def test_dimensions(data):
    S.dimension_check(list("abcdef"), MODEL)
    with pytest.raises(ValueError, match="mismatch"):
        S.dimension_check(["a"], MODEL)
    assert S.right_sized(data.withColumn("x", F.when(F.col("id") == 0, F.array(F.lit(1.0))).otherwise(F.col("x"))), "x",
                         MODEL).count() == 39
    with pytest.raises(ValueError):
        S.LinearModel([[1.0]], [0.0, 1.0], ["a"])


def test_pca_residual(spark):
    z = RNG.normal(size=(60, 5)) @ RNG.normal(size=(5, 5))
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in z], names)
    got = np.array([r.score for r in S.anomaly_score_pca(df, names, df, 2).collect()])
    _, _, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    want = ((z - z @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    assert np.allclose(np.sort(got), np.sort(want))


def test_anomaly_figures(spark):
    df = spark.createDataFrame([(1.0, False), (3.0, False), (8.0, True), (2.0, True)], "score double, attack boolean")
    r = S.anomaly_eval(df, F.col("attack"), 2.5).first()
    assert (r.benign_error, r.attack_error, r.recall, r.false_positive_rate, r.separation) == (2, 5, 0.5, 0.5, 2.5)
    assert S.anomaly_threshold(df.limit(0)) == 0.1245


def test_fgsm_follows_the_gradient(data):
    got = matrix(B.perturb_fgsm(data, MODEL, "x", "y", 0.1))
    gradient = (probs(X) - np.eye(4)[Y]) @ W
    assert np.allclose(got, np.clip(X + 0.1 * np.sign(gradient), 0, 1))
    # the closed form is the slope of the loss
    step = 1e-6 * np.eye(6)[2]
    slope = (-np.log(probs(X + step)[np.arange(40), Y]) + np.log(probs(X)[np.arange(40), Y])) / 1e-6
    assert np.allclose(slope, gradient[:, 2], atol=1e-4)


@pytest.mark.parametrize("name,params", [("fgsm", {}), ("pgd", {"num_steps": 5}), ("pgd", {"num_steps": 3, "random_start": False})])
@pytest.mark.parametrize("epsilon", [0.1, 0.5])
def test_perturbation_bounds(data, name, params, epsilon):
    got = matrix(B.get_attack(name, epsilon=epsilon, **params)(data, MODEL, "x", "y", "id"))
    assert np.abs(got - X).max() <= epsilon + 1e-6 and got.min() >= 0 and got.max() <= 1
    assert not np.allclose(got, X)


def test_pgd_does_not_depend_on_partitions(data):
    one = matrix(B.perturb_pgd(data.coalesce(1), MODEL, "x", "y", "id", num_steps=4))
    many = matrix(B.perturb_pgd(data.repartition(7), MODEL, "x", "y", "id", num_steps=4))
    assert np.array_equal(one, many)


def test_cw_turns_predictions_or_leaves_the_row(data):
    got = matrix(B.perturb_cw(data, MODEL, "x", "y", "id", num_steps=100, lr=0.05))
    turned = probs(got).argmax(axis=1) != Y
    untouched = np.all(got == X, axis=1)
    assert np.all(turned | untouched) and turned.mean() > 0.5
    assert got.min() >= -0.1 and got.max() <= 1.1


def test_robustness_table(data):
    got = {r.attack: r for r in B.robustness_eval(
        data, MODEL, "x", "y", "id", {"fgsm": B.get_attack("fgsm", epsilon=0.2)}).collect()}
    assert set(got) == {"clean", "fgsm"} and got["clean"].drop == 0 and got["fgsm"].total == 40
    assert got["fgsm"].accuracy <= got["clean"].accuracy
    assert list(r.attack for r in B.robustness_eval(data, MODEL, "x", "y", "id", {}).collect()) == ["clean"]


def test_registries(data):
    with pytest.raises(ValueError, match="Unknown attack"):
        B.get_attack("deepfool")
    with pytest.raises(ValueError, match="Unknown model"):
        S.get_classifier("other", 3, 2)


@pytest.mark.parametrize("name,params", [("linear", {"maxIter": 30}), ("mlp", {"hidden": [8], "maxIter": 60, "seed": 1})])
def test_training(spark, name, params):
    x = RNG.normal(size=(300, 2))
    df = spark.createDataFrame([(float(a), float(b), int(a + b > 0)) for a, b in x], "a double, b double, c int")
    model = S.train_classifier(df, ["a", "b"], "c", 2, name, weights={0: 1.2, 1: 0.8}, **params)
    out = model.transform(S.training_frame(df, ["a", "b"], "c"))
    assert out.where("prediction = y").count() > 280
    top = S.feature_importance(df.withColumn("noise", F.lit(1.0)), ["noise", "a"], "c", trees=5).first()
    assert top.feature == "a"
