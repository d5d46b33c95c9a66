"""Counters and histograms as monitored services expose them: samples of totals that only grow, until a restart."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def counter_rate(samples: DataFrame, series: list[str], size_s: int, us: str = "us", value: str = "value") -> DataFrame:
    """Increase per second of every series in windows of ``size_s``, from at least two samples inside the window.

    A sample below the one before it means that the counter began anew; what had been counted is not lost.
    The increase between the first and the last sample is carried on to the ends of the window where they
    lie near (within 1.1 of the mean distance of samples, else half of it), but not below zero.  A window needs the
    samples of its own time only, so a series is spread over as many tasks as it has windows.
    """
    width = size_s * 1_000_000
    slot = (F.floor(F.col(us) / width) * width).cast("long")
    placed = samples.select(*series, slot.alias("window_us"), F.col(us).alias("_us"), F.col(value).cast("double").alias("_v"))
    before = F.lag("_v").over(Window.partitionBy("window_us", *series).orderBy("_us", "_v"))
    stepped = placed.withColumn("_lost", F.when(F.col("_v") < before, before).otherwise(F.lit(0.0)))
    found = stepped.groupBy("window_us", *series).agg(
        F.count("*").alias("n"), F.min("_us").alias("_first"), F.max("_us").alias("_last"),
        F.min(F.struct("_us", "_v")).alias("_begin"), F.max(F.struct("_us", "_v")).alias("_end"), F.sum("_lost").alias("_lost"))
    found = found.where(F.col("_last") > F.col("_first")).withColumns({
        "_increase": F.col("_end._v") - F.col("_begin._v") + F.col("_lost"), "_span": (F.col("_last") - F.col("_first")) / 1e6})
    mean = F.col("_span") / (F.col("n") - 1)

    def carried(distance: Column) -> Column:
        return F.when(distance < mean * 1.1, distance).otherwise(mean / 2)
    to_zero = F.when(F.col("_increase") > 0, F.col("_span") * F.col("_begin._v") / F.col("_increase"))
    ahead = carried(F.least((F.col("_first") - F.col("window_us")) / 1e6, to_zero))
    behind = carried((F.col("window_us") + width - F.col("_last")) / 1e6)
    rate = F.col("_increase") * ((F.col("_span") + ahead + behind) / F.col("_span")) / size_s
    return found.select("window_us", *series, "n", rate.alias("rate"))


def merged_buckets(rates: DataFrame, by: list[str], bound: str = "le") -> DataFrame:
    """Rates of cumulative buckets summed over all other series: histograms of one layout merge by addition."""
    return rates.groupBy(*by, bound).agg(F.sum("rate").alias("rate"))


def histogram_quantile(buckets: DataFrame, by: list[str], p: float, name: str, bound: str = "le") -> DataFrame:
    """The ``p`` quantile of cumulative buckets, values spread evenly inside a bucket.

    Null without an infinite bucket, with fewer than two or with nothing counted; the last finite bound if the
    quantile lies beyond it.  A histogram has as many rows as its layout has buckets.
    """
    held = buckets.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(bound).alias("le"), "rate"))).alias("_b"))
    # sums of carried rates may dip by a rounding; cumulative counts never fall
    rising = F.transform("_b", lambda x, i: F.struct(x["le"].alias("le"), F.array_max(
        F.transform(F.slice("_b", F.lit(1), i + 1), lambda y: y["rate"])).alias("rate")))
    held = held.withColumn("_b", rising).withColumn("_n", F.size("_b"))
    held = held.withColumn("_total", F.element_at("_b", -1)["rate"]).withColumn("_rank", F.col("_total") * p)
    held = held.withColumn("_i", F.size(F.filter("_b", lambda x: x["rate"] < F.col("_rank"))))
    at = lambda i, field, other: F.coalesce(F.get("_b", i)[field], F.lit(other))
    low, under = at(F.col("_i") - 1, "le", 0.0), at(F.col("_i") - 1, "rate", 0.0)
    high, upto = at(F.col("_i"), "le", 0.0), at(F.col("_i"), "rate", 0.0)
    inside = F.when(high <= 0, high).otherwise(low + (high - low) * ((F.col("_rank") - under) / (upto - under)))
    value = F.when((F.element_at("_b", -1)["le"] == float("inf")) & (F.col("_n") > 1) & (F.col("_total") > 0),
                   F.when(F.col("_i") >= F.col("_n") - 1, at(F.col("_n") - 2, "le", 0.0)).otherwise(inside))
    return held.select(*by, F.col("_total").alias("rate"), value.alias(name))


def latency_p95_histogram(samples: DataFrame, size_s: int = 300, limit: float = 0.5, p: float = 0.95, series=("instance",)) -> DataFrame:
    """The latency rule on what a service exposes: cumulative buckets (series, le, us, value), restarts included."""
    rates = counter_rate(samples, [*series, "le"], size_s)
    out = histogram_quantile(merged_buckets(rates, ["window_us"]), ["window_us"], p, "latency")
    return out.withColumn("firing", (F.col("latency") > limit).cast("int"))
