"""Cleaning, splitting, scaling and weighting of labelled flow tables."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from wirelens import constants as K
from wirelens.functions.numeric import named
from wirelens.operators.skew import rank_within

_FLOATS = (T.DoubleType, T.FloatType)


def trim_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def _usable(df: DataFrame) -> Column:
    """True where no column is null, NaN or infinite."""
    ok = F.lit(True)
    for field in df.schema.fields:
        col = named(field.name)
        ok = ok & col.isNotNull()
        if isinstance(field.dataType, _FLOATS):
            ok = ok & ~F.isnan(col) & (F.abs(col) != float("inf"))
    return ok


def clean_nonfinite_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a null, NaN or infinity in any column, the label included."""
    df = trim_columns(df)
    return df.where(_usable(df))


def clean_report(df: DataFrame) -> DataFrame:
    df = trim_columns(df)
    counts = df.agg(F.count("*").alias("rows"), F.count_if(~_usable(df)).alias("dropped"))
    percent = F.when(F.col("rows") > 0, F.col("dropped") / F.col("rows") * 100).otherwise(0.0)
    return counts.withColumn("dropped_percent", F.bround(percent, 2))


def detect_label_column(df: DataFrame) -> str:
    for name in K.LABEL_COLUMNS:
        if name in df.columns:
            return name
    raise ValueError(f"No label column found. Columns: {df.columns}")


def class_table(df: DataFrame, label: str = "label") -> DataFrame:
    """Distinct labels in order with their numbers (label, class_id), however many there are."""
    found = df.select(F.trim(named(label)).alias("label")).where(F.col("label").isNotNull()).distinct()
    ranked = rank_within(found.withColumn("_b", F.substring("label", 1, 3)), [], "_b", [F.col("label")], "_rank", "_n")
    return ranked.select("label", F.col("_rank").cast("int").alias("class_id"))


def label_classes(df: DataFrame, label: str = "label") -> list[str]:
    """The labels of ``class_table`` as a list, for models that hold one weight or output per class."""
    return [r.label for r in class_table(df, label).orderBy("class_id").collect()]


def label_encode(df: DataFrame, classes: list[str] | DataFrame, label: str = "label",
                 out: str = "class_id") -> DataFrame:
    """Class numbers, null for unknown labels: by equi-join with a class table, or a list's positions."""
    if isinstance(classes, DataFrame):
        numbers = classes.select(F.col("label").alias("_label"), F.col("class_id").alias(out))
        return df.join(numbers, F.trim(named(label)) == F.col("_label"), "left").drop("_label")
    position = F.array_position(F.array(*[F.lit(c) for c in classes]), F.trim(named(label)))
    return df.withColumn(out, (position - 1).cast("int"))


def label_decode(df: DataFrame, classes: list[str] | DataFrame, class_id: str = "class_id",
                 out: str = "label") -> DataFrame:
    if isinstance(classes, DataFrame):
        names = classes.select(F.col("class_id").alias("_id"), F.col("label").alias(out))
        return df.join(names, F.col(class_id) == F.col("_id"), "left").drop("_id")
    return df.withColumn(out, F.get(F.array(*[F.lit(c) for c in classes]), F.col(class_id)))


def class_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(named(label).alias(label)).agg(F.count("*").alias("rows"))


def seeded_order(row_id: str, seed: int) -> Column:
    """A reproducible pseudo-random order: the digest of row id and seed."""
    return F.md5(F.concat_ws("|", F.col(row_id).cast("string"), F.lit(str(seed))))


def stratified_split(df: DataFrame, label: str, row_id: str, seed: int = 42,
                     train_percent: int = 70, val_percent: int = 15) -> DataFrame:
    """Add ``split``: each class is cut at the same percentages in a seeded order.

    Ranks are exact and a dominant class stays spread over 4096 digest ranges.
    """
    ranked = rank_within(
        df.withColumn("_h", seeded_order(row_id, seed)).withColumn("_b", F.substring("_h", 1, 3)),
        [label], "_b", [F.col("_h"), F.col(row_id)], "_rank", "_size")
    # the middle of row r lies at (2r + 1) / 2n; compared in whole numbers
    place = (F.col("_rank") * 2 + 1) * 100
    whole = F.col("_size") * 2
    split = (F.when(place < whole * train_percent, "train")
             .when(place < whole * (train_percent + val_percent), "val").otherwise("test"))
    return ranked.withColumn("split", split).drop("_h", "_b", "_rank", "_size")


def sample_rows(df: DataFrame, row_id: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed (a distributed top-n)."""
    return df.orderBy(seeded_order(row_id, seed), F.col(row_id)).limit(n)


@dataclass(frozen=True)
class Scaler:
    """Fitted means and scales; one number pair per feature, so it travels as literals."""

    features: list[str]
    mean: list[float]
    scale: list[float]

    def __post_init__(self):
        if not len(self.features) == len(self.mean) == len(self.scale):
            raise ValueError("scaler lists differ in length")

    def scaled(self, name: str) -> Column:
        i = self.features.index(name)
        return (named(name) - self.mean[i]) / self.scale[i]

    def table(self, spark) -> DataFrame:
        rows = [(i, f, float(m), float(s))
                for i, (f, m, s) in enumerate(zip(self.features, self.mean, self.scale))]
        return spark.createDataFrame(rows, "pos int, feature string, mean double, scale double")


def scaler_fit(df: DataFrame, features: list[str]) -> Scaler:
    """Mean and population deviation of the training rows in one aggregation; deviation 0 becomes 1.

    The result is one number pair per feature, so it comes back as Python lists.
    """
    quoted = ["`" + f.replace("`", "``") + "`" for f in features]
    row = df.agg(*[F.expr(f"avg({q})") for q in quoted], *[F.expr(f"stddev_pop({q})") for q in quoted]).first()
    mean, std = list(row[:len(features)]), list(row[len(features):])
    if any(m is None for m in mean):
        raise ValueError("cannot fit a scaler on an empty table or an all-null feature")
    return Scaler(list(features), mean, [s if s > 0 else 1.0 for s in std])


def scaler_transform(df: DataFrame, scaler: Scaler) -> DataFrame:
    return df.withColumns({f: scaler.scaled(f) for f in scaler.features})


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Inverse class frequency, normalised so that the weights add up to the number of classes."""
    counts = class_distribution(df, label)
    all_classes = Window.partitionBy()
    inverse = 1.0 / F.greatest(F.col("rows"), F.lit(1))
    return counts.withColumn(
        "weight", inverse / F.sum(inverse).over(all_classes) * F.count("*").over(all_classes))


def range_check(df: DataFrame, scaler: Scaler, keep: list[str], sigma: float = 5.0) -> DataFrame:
    """One row per value that lies more than ``sigma`` scales from the training mean."""
    cells = [F.struct(F.lit(f).alias("feature"), named(f).alias("raw"), F.lit(m).alias("mean"),
                      F.lit(s).alias("scale"), F.abs(scaler.scaled(f)).alias("z"))
             for f, m, s in zip(scaler.features, scaler.mean, scaler.scale) if s > 0]
    outside = F.filter(F.array(*cells), lambda cell: cell.getField("z") > sigma)
    return df.select(*keep, F.explode(outside).alias("c")).select(*keep, "c.*")


def zero_feature_impact(scaler_rows: DataFrame, provenance: DataFrame) -> DataFrame:
    """What a zero in an unavailable feature becomes after scaling."""
    return (scaler_rows.join(provenance.where("source = 'UNAVAILABLE'").select("feature"), "feature")
            .select("feature", F.lit(0.0).alias("raw_value"),
                    F.bround(-F.col("mean") / F.col("scale"), 4).alias("normalized_value"),
                    F.bround("mean", 4).alias("training_mean"), F.bround("scale", 4).alias("training_scale")))
