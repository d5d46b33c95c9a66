"""Alert rules over prediction and request tables, as event-time windows."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens import constants as K
from wirelens.functions.time import micros
from wirelens.operators.skew import exact_percentile


def _slot(ts: str, seconds: int) -> Column:
    width = seconds * 1_000_000
    return (F.floor(micros(F.col(ts)) / width) * width).cast("long")


def share_window(rows: DataFrame, bad: Column, size_s: int, slide_s: int, limit: float, ts: str = "ts") -> DataFrame:
    """Share of ``bad`` rows over sliding windows and whether it exceeds ``limit``.

    Rows are first counted per slide step; only those counts are copied into the
    size/slide windows they belong to, so the data itself is never multiplied.
    """
    if size_s % slide_s:
        raise ValueError("the window must be a whole number of slides")
    steps = rows.groupBy(_slot(ts, slide_s).alias("slot")).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("bad"))
    back = F.sequence(F.lit(0), F.lit(size_s // slide_s - 1))
    spread = steps.select(
        F.explode(F.transform(back, lambda i: F.col("slot") - i * (slide_s * 1_000_000))).alias("window_us"), "n", "bad")
    windows = spread.groupBy("window_us").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    share = F.col("bad") / F.col("n")
    return windows.withColumns({"share": share, "firing": (share > limit).cast("int")})


def attack_rate_window(predictions: DataFrame, size_s=300, slide_s=60, limit=0.1) -> DataFrame:
    return share_window(predictions, F.col("prediction") != K.BENIGN, size_s, slide_s, limit)


def error_rate_window(requests: DataFrame, size_s=300, slide_s=60, limit=0.01) -> DataFrame:
    return share_window(requests, F.col("status") >= 500, size_s, slide_s, limit)


def latency_p95_window(predictions: DataFrame, size_s=300, limit=0.5, p=0.95) -> DataFrame:
    """Exact latency percentile per window and whether it exceeds ``limit`` seconds."""
    slotted = predictions.select(_slot("ts", size_s).alias("window_us"), "latency_s")
    out = exact_percentile(slotted, ["window_us"], "latency_s", p, "latency")
    return out.withColumn("firing", (F.col("latency") > limit).cast("int"))


def silence_detect(up: DataFrame, events: DataFrame, slot_s=300, ts: str = "ts") -> DataFrame:
    """Windows in which the source was up (``up`` has rows) but ``events`` has none, and windows
    between the first and last sign of life in which the source itself was down."""
    width = slot_s * 1_000_000
    alive = up.groupBy(_slot(ts, slot_s).alias("window_us")).agg(F.count("*").alias("signs"))
    span = alive.agg(F.min("window_us").alias("lo"), F.max("window_us").alias("hi")).where("lo IS NOT NULL")
    slots = span.select(F.explode(F.sequence("lo", "hi", F.lit(width))).alias("window_us"))
    counted = events.groupBy(_slot(ts, slot_s).alias("window_us")).agg(F.count("*").alias("events"))
    state = F.when(F.col("signs").isNull(), "down").when(F.col("events").isNull(), "silent")
    return (slots.join(alive, "window_us", "left").join(counted, "window_us", "left")
            .select("window_us", state.alias("state")).where(F.col("state").isNotNull()))


def sustained_for(windows: DataFrame, step_s: int, for_s: int) -> DataFrame:
    """Stretches of consecutive firing windows that last at least ``for_s``.

    Works on one row per window step, so the single ordered pass is over time steps, not data.
    """
    step = step_s * 1_000_000
    order = Window.orderBy("window_us")
    run = windows.where("firing = 1").withColumn(
        "_run", F.col("window_us") - F.row_number().over(order) * step)
    out = run.groupBy("_run").agg(F.min("window_us").alias("from_us"), F.max("window_us").alias("to_us"),
                                  F.count("*").alias("windows"))
    return out.where(F.col("to_us") - F.col("from_us") >= for_s * 1_000_000).drop("_run")
