"""Scoring and evaluation of class and anomaly models."""

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import (LogisticRegression, MultilayerPerceptronClassifier,
                                       RandomForestClassifier)
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirelens import constants as K
from wirelens.functions.numeric import first_argmax, let, named, softmax, total
from wirelens.operators.preparation import Scaler
from wirelens.operators.skew import global_percentile


@dataclass(frozen=True)
class LinearModel:
    """Class weights (one row per class), biases and class names; small, so it travels as literals."""

    weights: list[list[float]]
    bias: list[float]
    classes: list[str]

    def __post_init__(self):
        if not len(self.weights) == len(self.bias) == len(self.classes):
            raise ValueError("weights, bias and classes differ in length")

    @property
    def inputs(self) -> int:
        return len(self.weights[0])

    def matrix(self) -> np.ndarray:
        return np.asarray(self.weights, dtype=float)


def dimension_check(features: list[str], model: LinearModel) -> None:
    """The number of features must equal the model's inputs."""
    if len(features) != model.inputs:
        raise ValueError(f"Feature dimension mismatch: {len(features)} feature names "
                         f"but the model expects {model.inputs} inputs")


def right_sized(df: DataFrame, vector: str, model: LinearModel) -> DataFrame:
    """Rows whose vector has the model's input size."""
    return df.where(F.size(vector) == model.inputs)


def _matrix(rows) -> Column:
    """A constant matrix as one literal, folded at planning time."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])


def _inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, w: x * w), F.lit(0.0), lambda acc, p: acc + p)


def logits(vector: Column, model: LinearModel) -> Column:
    rows = [[*w, b] for w, b in zip(model.weights, model.bias)]
    extended = F.concat(vector.cast("array<double>"), F.array(F.lit(1.0)))
    return let(extended, lambda x: F.transform(_matrix(rows), lambda w: _inner(x, w)))


def score_linear_softmax(df: DataFrame, model: LinearModel, vector: str) -> DataFrame:
    """Add probabilities, class_id, prediction and confidence; the vector is already scaled."""
    scored = df.withColumn("_logits", logits(F.col(vector), model)) \
        .withColumn("probabilities", softmax(F.col("_logits")))
    return scored.withColumns({
        "class_id": first_argmax(F.col("_logits")), "confidence": F.array_max("probabilities"),
        "prediction": F.get(F.array(*[F.lit(c) for c in model.classes]), first_argmax(F.col("_logits")))}) \
        .drop("_logits")


def probability_map(probabilities: Column, classes: list[str]) -> Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in classes]), probabilities)


_LOADED: dict = {}


def _load_once(key: str, load: Callable):
    if key not in _LOADED:
        _LOADED.clear()  # one model at a time
        _LOADED[key] = load()
    return _LOADED[key]


def score_model_udf(df: DataFrame, load: Callable[[], Callable], key: str, vector: str,
                    classes: list[str]) -> DataFrame:
    """The same outputs for any vectorised model.  ``load()`` returns ``fn(matrix) -> logits`` and
    runs once per Python worker and call of this function, so a newer model under the same ``key`` is
    never mistaken for an older one; batches arrive as Arrow."""
    key = f"{key}-{uuid.uuid4().hex}"
    schema = T.StructType([T.StructField("class_id", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
                           T.StructField("prediction", T.StringType()),
                           T.StructField("probabilities", T.ArrayType(T.DoubleType()))])

    def infer(vectors: pd.Series) -> pd.DataFrame:
        model = _load_once(key, load)
        out = np.asarray(model(np.stack(vectors.to_numpy()).astype(float)), dtype=float)
        exps = np.exp(out - out.max(axis=1, keepdims=True))
        probs = exps / exps.sum(axis=1, keepdims=True)
        best = out.argmax(axis=1)
        return pd.DataFrame({"class_id": best.astype("int32"), "confidence": probs[np.arange(len(best)), best],
                             "prediction": [classes[i] for i in best], "probabilities": list(probs)})

    scorer = F.pandas_udf(infer, schema)
    return df.withColumn("_s", scorer(F.col(vector))).select(*df.columns, "_s.*")


def onnx_loader(path: str) -> Callable[[], Callable]:
    """Loader of an ONNX file every worker can read; needs onnxruntime on the workers."""
    def load():
        import onnxruntime
        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name
        return lambda matrix: session.run(None, {name: matrix.astype(np.float32)})[0]
    return load


def confident_detections(predictions: DataFrame, minimum: float = K.DETECTION_CONFIDENCE) -> DataFrame:
    return predictions.where(F.col("confidence") >= minimum).withColumn(
        "attack", (F.col("prediction") != K.BENIGN).cast("int"))


def prediction_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("prediction").agg(F.count("*").alias("predictions"))


def accuracy_eval(scored: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and mean cross-entropy of rows with class_id, probabilities and a true class id."""
    p_true = F.element_at("probabilities", F.col(label) + 1)
    return scored.agg(F.count("*").alias("rows"),
                      F.avg((F.col("class_id") == F.col(label)).cast("double")).alias("accuracy"),
                      F.avg(-F.log(p_true)).alias("loss"))


def per_class_accuracy(scored: DataFrame, label: str = "label") -> DataFrame:
    right = F.count_if(F.col("class_id") == F.col(label))
    return scored.groupBy(F.col(label).alias("true_class")).agg(
        right.alias("correct"), F.count("*").alias("total"), (right / F.count("*")).alias("accuracy"))


# --- anomaly ------------------------------------------------------------------
def anomaly_score(scaled: DataFrame, features: list[str], out: str = "score") -> DataFrame:
    """Mean squared error of reconstructing the scaled vector by the training mean (all zeros)."""
    squares = [F.pow(named(f), F.lit(2.0)) for f in features]
    return scaled.withColumn(out, total(squares) / len(features))


def anomaly_score_pca(scaled: DataFrame, features: list[str], train: DataFrame, k: int = 4,
                      out: str = "score") -> DataFrame:
    """Mean squared error of a rank-``k`` reconstruction; the components are fitted on ``train``.

    Fitting sums one small matrix per task.  The residual is the squared length of the vector
    minus the squared length of its projection, so the score stays a column expression.
    """
    vectors = train.select(array_to_vector(F.array(*[named(f).cast("double") for f in features])).alias("x"))
    axes = PCA(k=k, inputCol="x", outputCol="y").fit(vectors).pc.toArray()
    def length(values):
        return total([F.pow(v, F.lit(2.0)) for v in values])
    projections = [total([named(f) * float(axes[i, c]) for i, f in enumerate(features)]) for c in range(k)]
    residual = length([named(f) for f in features]) - length(projections)
    return scaled.withColumn(out, F.greatest(residual, F.lit(0.0)) / len(features))


def anomaly_threshold(scored: DataFrame, benign: Column | None = None, p: float = 0.95,
                      score: str = "score") -> float:
    """Exact percentile of the score over benign rows."""
    value = global_percentile(scored if benign is None else scored.where(benign), score, p)
    return K.DEFAULT_THRESHOLD if value is None else value


def anomaly_eval(scored: DataFrame, attack: Column, threshold: float, score: str = "score") -> DataFrame:
    """Mean error of benign and attack rows, their ratio, recall and false positive rate."""
    s, above = F.col(score), (F.col(score) > threshold).cast("double")
    out = scored.agg(
        F.avg(F.when(~attack, s)).alias("benign_error"), F.avg(F.when(attack, s)).alias("attack_error"),
        F.avg(F.when(attack, above)).alias("recall"), F.avg(F.when(~attack, above)).alias("false_positive_rate"))
    return out.withColumn("separation", F.col("attack_error") / F.col("benign_error"))


# --- fitting with Spark ML -------------------------------------------------------
def get_classifier(name: str, features: int, classes: int, **params):
    """Baseline classifier by name: ``linear`` (takes class weights) or ``mlp``."""
    makers = {
        "linear": lambda: LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", **params),
        "mlp": lambda: MultilayerPerceptronClassifier(
            featuresCol="x", labelCol="y",
            layers=[features, *params.pop("hidden", [256, 128, 64]), classes], **params),
    }
    if name not in makers:
        raise ValueError(f"Unknown model: {name}. Available: {sorted(makers)}")
    return makers[name]()


def training_frame(df: DataFrame, features: list[str], class_id: str, weights: dict[int, float] | None = None):
    """Columns x (vector), y (class id) and w (class weight) for Spark ML."""
    weight = F.lit(1.0)
    if weights:
        table = F.create_map(*[F.lit(v) for k, w in weights.items() for v in (int(k), float(w))])
        weight = F.coalesce(table[F.col(class_id)], F.lit(1.0))
    return df.select(array_to_vector(F.array(*[named(f).cast("double") for f in features])).alias("x"),
                     F.col(class_id).cast("double").alias("y"), weight.alias("w"))


def train_classifier(df: DataFrame, features: list[str], class_id: str, classes: int, name: str = "linear",
                     weights: dict[int, float] | None = None, **params):
    """A fitted Spark ML model; the training data never leaves the executors."""
    return get_classifier(name, len(features), classes, **params).fit(
        training_frame(df, features, class_id, weights))


def feature_importance(df: DataFrame, features: list[str], class_id: str, trees: int = 20, depth: int = 5,
                       seed: int = 42) -> DataFrame:
    """Feature and importance, most important first (random forest)."""
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(training_frame(df, features, class_id))
    rows = [(f, float(v)) for f, v in zip(features, model.featureImportances.toArray())]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double") \
        .orderBy(F.col("importance").desc(), "feature")
