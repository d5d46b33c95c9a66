"""Flow features to tiered alerts: the batch form of the live alerting path."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wirelens import constants as K
from wirelens.functions.numeric import named, total
from wirelens.functions.time import micros
from wirelens.operators import preparation, routing, scoring
from wirelens.operators.skew import rank_within
from wirelens.session import cut_lineage


@dataclass(frozen=True)
class AnomalyModel:
    scaler: preparation.Scaler
    threshold: float


def _error(scaler: preparation.Scaler) -> Column:
    squares = [F.pow(scaler.scaled(f), F.lit(2.0)) for f in scaler.features]
    return total(squares) / len(scaler.features)


def fit_anomaly_model(features: DataFrame, benign: Column | None = None, p: float = 0.95) -> AnomalyModel:
    """Scaler on all given rows, threshold on the benign ones.

    The percentile looks at the scores several times, so they are computed once and kept; the features are computed twice.
    """
    scaler = preparation.scaler_fit(features, K.FEATURES_25)
    held_out = features if benign is None else features.where(benign)
    scored = cut_lineage(held_out.select(_error(scaler).alias("score")))
    return AnomalyModel(scaler, scoring.anomaly_threshold(scored, p=p))


def _evaluated(df: DataFrame) -> DataFrame:
    """The same rows, computed before anything above looks at them.  A filter on the score would
    otherwise move below the features and repeat their expressions for every reference."""
    return df.select(F.inline(F.array(F.struct(*[named(c) for c in df.columns]))))


def score_flows(features: DataFrame, model: AnomalyModel) -> DataFrame:
    """Raw features plus score, anomaly flag and severity; no shuffle."""
    return (_evaluated(features.withColumn("score", _error(model.scaler)))
            .withColumn("anomaly", F.col("score") > model.threshold)
            .withColumn("severity", routing.severity_tier(F.col("score"), F.col("anomaly"), model.threshold)))


def route_alerts(scored: DataFrame, cooldown_s: float = K.ALERT_COOLDOWN_S, earlier=()) -> DataFrame:
    """Add ``admitted``: whether the pair's cooldown and the limit over all pairs let an alert pass; null for
    flows that raise none (warnings, which are only logged, and flows below every tier or on the allowlist).

    Alerts are numbered in the order of time and id, so flows that share an id are judged one by one.
    """
    open_flow = F.col("allow_rule").isNull() if "allow_rule" in scored.columns else F.lit(True)
    raises = open_flow & F.coalesce(F.col("severity").isin("critical", "emergency"), F.lit(False))
    slot = F.floor(micros(F.col("ts")) / 60_000_000)
    numbered = cut_lineage(rank_within(scored.where(raises).withColumn("_slot", slot), [], "_slot",
                                       [F.col("ts"), F.col("flow_id")], "_row", "_all").drop("_slot", "_all"))
    limited = routing.alert_rate_limit(numbered, cooldown_s, row_id="_row", earlier=earlier).drop("_row")
    return scored.where(~raises).withColumn("admitted", F.lit(None).cast("boolean")).unionByName(limited)


def alert_flows(scored: DataFrame, rules, cooldown_s: float = K.ALERT_COOLDOWN_S) -> DataFrame:
    """Every flow with its allowlist rule and, where it raises an alert, whether the pair's
    cooldown and the limit over all pairs let it pass (``admitted``; null where there is nothing to check)."""
    return route_alerts(routing.allowlist_match(scored, rules), cooldown_s)
