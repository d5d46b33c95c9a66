"""Labelled flow table to training data: clean, encode, split, scale, weigh."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wirelens.functions.numeric import named
from wirelens.operators import flow_records, preparation as P
from wirelens.session import cut_lineage


@dataclass(frozen=True)
class TrainingData:
    rows: DataFrame  # row id, class_id, split and scaled features
    classes: list[str]
    scaler: P.Scaler
    weights: dict[int, float]

    def part(self, split: str) -> DataFrame:
        return self.rows.where(F.col("split") == split)


def prepare_training_data(table: DataFrame, row_id: str, features: list[str] | None = None, seed: int = 42,
                          train_percent: int = 70, val_percent: int = 15) -> TrainingData:
    """The scaler and the class weights see training rows only.

    The split is written out once, because fitting and scaling both read it.
    """
    clean = P.clean_nonfinite_rows(table)
    label = P.detect_label_column(clean)
    features = features or [c for c in clean.columns if c not in (label, row_id)]
    classes = P.label_classes(clean, label)
    encoded = P.label_encode(clean, classes, label)
    chosen = flow_records.feature_subset(encoded, features, keep=[row_id, "class_id"])
    split = cut_lineage(P.stratified_split(chosen, "class_id", row_id, seed, train_percent, val_percent))
    train = split.where("split = 'train'")
    scaler = P.scaler_fit(train, features)
    weights = {r.class_id: r.weight for r in P.class_weights(train, "class_id").collect()}
    rows = P.scaler_transform(split, scaler).select(row_id, "class_id", "split", *[named(f) for f in features])
    return TrainingData(rows, classes, scaler, weights)
