"""Analytics over intrusion-detection alerts.

Flat input columns: event_id, ts, sid, severity, signature, category, src_ip, dest_ip.
(ts, event_id) is arrival order wherever "first" or "last" matters.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens import constants as K
from wirelens.functions.text import contains_any, or_default
from wirelens.functions.time import instant, micros
from wirelens.operators.skew import rank_within

SEQ = ["ts", "event_id"]


def _seq() -> Column:
    return F.struct(*SEQ)


def ids_alert_record(events: DataFrame) -> DataFrame:
    """Alert events of a nested sensor log as flat records."""
    return events.where(F.col("event_type") == "alert").select(
        "timestamp", F.lit("ids_alert").alias("type"), "alert.severity", "alert.signature",
        "alert.signature_id", "alert.category", "src_ip", "src_port", "dest_ip", "dest_port", "proto",
        "community_id")


def event_type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def lookback_filter(alerts: DataFrame, as_of: datetime, back: timedelta, ts: str = "ts") -> DataFrame:
    """Rows no older than ``back`` before ``as_of``; the bound reaches the file scan."""
    return alerts.where(F.col(ts) >= instant(alerts, ts, as_of, back))


def severity_filter(alerts: DataFrame, severity: int) -> DataFrame:
    return alerts.where(F.col("severity") == severity)


def sid_suppress(alerts: DataFrame, sids) -> DataFrame:
    """Drop listed signature ids: a list becomes a set test, a table an anti-join.  A null id is not listed."""
    if isinstance(sids, DataFrame):
        return alerts.join(sids.select("sid").distinct(), "sid", "left_anti")
    return alerts.where(F.col("sid").isNull() | ~F.col("sid").isin(*sids)) if sids else alerts


def sid_rate_limit(alerts: DataFrame, limits: list[tuple[int, int, int]]) -> DataFrame:
    """``limits`` holds (sid, count, seconds): keep the first ``count`` alerts per source and
    fixed window of ``seconds``.  Other signatures pass.  The largest count is a constant, so
    Spark cuts every group to that many rows before the shuffle."""
    if not limits:
        return alerts
    listed = alerts.where(F.col("sid").isin(*[s for s, _, _ in limits]))
    seconds = F.coalesce(*[F.when(F.col("sid") == s, F.lit(sec)) for s, _, sec in limits])
    count = F.coalesce(*[F.when(F.col("sid") == s, F.lit(c)) for s, c, _ in limits])
    slot = F.floor(micros(F.col("ts")) / (seconds * 1e6))
    place = F.row_number().over(Window.partitionBy("sid", "src_ip", "_slot").orderBy(*SEQ))
    kept = (listed.withColumn("_slot", slot).withColumn("_place", place)
            .where(F.col("_place") <= max(c for _, c, _ in limits))
            .where(F.col("_place") <= count).drop("_slot", "_place"))
    return alerts.where(F.col("sid").isNull() | ~F.col("sid").isin(*[s for s, _, _ in limits])).unionByName(kept)


def classify_notify() -> Column:
    return (F.when(F.col("severity") == 1, "CRITICAL").when(F.col("severity") == 2, "WARNING")
            .when(F.contains("signature", F.lit("HUNTING")), "HUNTING").otherwise("INFO"))


def classify_review(known=K.INFRA_SIDS) -> Column:
    signature = F.col("signature")
    return (F.when(F.col("sid").isin(*known), "KNOWN_INFRA")
            .when(contains_any(signature, K.STREAM_MARKERS), "STREAM_NOISE")
            .when(F.col("severity") == 1, "ACTION_REQUIRED").when(F.col("severity") == 2, "REVIEW")
            .when(F.contains(signature, F.lit("HUNTING")), "HUNTING")
            .when(F.contains(signature, F.lit("INFO")), "INFORMATIONAL").otherwise("UNCLASSIFIED"))


def review_reason(known=K.INFRA_SIDS) -> Column:
    """Reason text of the review class; known signatures answer with their own name."""
    names = F.create_map(*[F.lit(x) for sid, name in known.items() for x in (sid, name)])
    texts = F.create_map(*[F.lit(x) for pair in K.REVIEW_REASONS.items() for x in pair])
    return F.coalesce(names[F.col("sid").cast("int")], texts[classify_review(known)])


def alert_key() -> Column:
    return F.concat_ws(":", F.col("sid").cast("string"), or_default(F.col("src_ip"), ""),
                       or_default(F.col("dest_ip"), ""))


def dedup_sent(alerts: DataFrame, sent: DataFrame) -> DataFrame:
    """Alerts whose key was not sent before; repeats within the run stay."""
    return alerts.withColumn("key", alert_key()).join(sent.select("key"), "key", "left_anti")


def sent_keys_update(sent: DataFrame, new_alerts: DataFrame, since=None, keep: int | None = None) -> DataFrame:
    """Key store (key, last_ts) after a run: every key seen so far.  ``since`` forgets keys last seen
    before it, ``keep`` all but so many most recent ones (ties by key); their alerts are sent again."""
    fresh = new_alerts.select(alert_key().alias("key"), F.col("ts").alias("last_ts"))
    store = (sent.select("key", "last_ts").unionByName(fresh)
             .groupBy("key").agg(F.max("last_ts").alias("last_ts")))
    if since is not None:
        store = store.where(F.col("last_ts") >= since)
    return store if keep is None else store.orderBy(F.col("last_ts").desc(), "key").limit(keep)


def notify_digest(alerts: DataFrame, top: int = 5) -> DataFrame:
    """Per notify class its size and the ``top`` signatures with count and first sample."""
    sample = F.min_by(F.struct("sid", "severity", "src_ip", "dest_ip"), _seq())
    per_signature = alerts.groupBy(classify_notify().alias("class"), "signature").agg(
        F.count("*").alias("alerts"), sample.alias("sample"), F.min(_seq()).alias("_first"))
    ranked = per_signature.withColumns({
        "class_alerts": F.sum("alerts").over(Window.partitionBy("class")),
        "place": F.row_number().over(
            Window.partitionBy("class").orderBy(F.col("alerts").desc(), F.col("_first")))})
    return ranked.where(F.col("place") <= top).select(
        "class", "class_alerts", "place", "signature", "alerts", "sample.*")


def review_class_counts(alerts: DataFrame, show_all: bool = False) -> DataFrame:
    """Alerts per review class in report order, with the time span of all shown alerts."""
    if not show_all:
        alerts = sid_suppress(alerts, list(K.INFRA_SIDS))
    counts = alerts.groupBy(classify_review().alias("class")).agg(
        F.count("*").alias("alerts"), F.min("ts").alias("_lo"), F.max("ts").alias("_hi"))
    everything = Window.partitionBy()
    order = F.array_position(F.array(*[F.lit(c) for c in K.REVIEW_CLASSES]), F.col("class"))
    return counts.select(order.cast("int").alias("place"), "class", "alerts",
                         F.min("_lo").over(everything).alias("first_ts"),
                         F.max("_hi").over(everything).alias("last_ts"))


def review_top_sids(alerts: DataFrame, top: int = 15) -> DataFrame:
    """The most frequent signature ids with the details first seen."""
    meta = F.min_by(F.struct("signature", "severity", "category", classify_review().alias("class")), _seq())
    return (alerts.groupBy("sid").agg(F.count("*").alias("alerts"), meta.alias("m"), F.min(_seq()).alias("_first"))
            .orderBy(F.col("alerts").desc(), "_first").limit(top).select("sid", "alerts", "m.*"))


ACTIONABLE = ["ACTION_REQUIRED", "REVIEW", "UNCLASSIFIED"]


def review_actionable(alerts: DataFrame, last: int = 30) -> DataFrame:
    """The last ``last`` actionable alerts (classes in order, then arrival), one per sid and pair."""
    place = F.array_position(F.array(*[F.lit(c) for c in ACTIONABLE]), F.col("class"))
    recent = (alerts.withColumn("class", classify_review()).where(F.col("class").isin(*ACTIONABLE))
              .withColumn("_place", place)
              .orderBy(F.col("_place").desc(), *[F.col(c).desc() for c in SEQ]).limit(last))
    first = Window.partitionBy("sid", "src_ip", "dest_ip").orderBy("_place", *SEQ)
    return (recent.withColumn("_n", F.row_number().over(first)).where("_n = 1")
            .withColumn("reason", review_reason()).drop("_n", "_place"))


def export_actionable(alerts: DataFrame) -> DataFrame:
    return (sid_suppress(alerts, list(K.INFRA_SIDS))
            .withColumn("class", classify_review())
            .where(F.col("class").isin(*ACTIONABLE, "HUNTING"))
            .withColumn("reason", review_reason()))


def alert_detail(alerts: DataFrame, last: int = 20) -> DataFrame:
    """The last ``last`` alerts in full; the cut comes first, known and noise rows leave after it."""
    recent = alerts.orderBy(*[F.col(c).desc() for c in SEQ]).limit(last)
    return (recent.withColumn("class", classify_review())
            .where(~F.col("class").isin("KNOWN_INFRA", "STREAM_NOISE"))
            .withColumn("reason", review_reason()))


def overnight_signatures(alerts: DataFrame, suppressed=tuple(K.INFRA_SIDS)) -> DataFrame:
    """Count per signature of the alerts that are not suppressed, with severity and sid first seen."""
    first = F.min_by(F.struct("severity", "sid"), _seq())
    return (sid_suppress(alerts, list(suppressed)).groupBy("signature")
            .agg(F.count("*").alias("alerts"), first.alias("m"), F.min(_seq()).alias("first"))
            .select("signature", "alerts", "m.*", "first"))


def status_tier(actionable: Column) -> Column:
    return F.when(actionable == 0, "GREEN").when(actionable < 10, "YELLOW").otherwise("RED")


def overnight_summary(alerts: DataFrame, suppressed=tuple(K.INFRA_SIDS)) -> DataFrame:
    """One row: all alerts, actionable ones, distinct actionable signatures and the status."""
    acts = F.col("sid").isNull() | ~F.col("sid").isin(*suppressed) if suppressed else F.lit(True)  # as ``sid_suppress`` keeps them
    out = alerts.agg(F.count("*").alias("total"), F.count_if(acts).alias("actionable"),
                     F.count_distinct(F.when(acts, F.col("signature"))).alias("signatures"))
    return out.withColumn("status", status_tier(F.col("actionable")))


def overnight_top5(alerts: DataFrame, top: int = 5) -> DataFrame:
    return (overnight_signatures(alerts).orderBy(F.col("alerts").desc(), "first").limit(top)
            .select("signature", "alerts", "severity", "sid"))


def handoff_issues(checks: DataFrame) -> DataFrame:
    """Issue rows for the checks that fail.  ``checks``: (name, value, healthy, template); a
    ``%s`` in the template stands for the value."""
    text = F.replace(F.col("template"), F.lit("%s"), F.col("value").cast("string"))
    return checks.where(~F.col("healthy")).select("name", text.alias("issue"))


def loki_rows(events: DataFrame, timestamp: Column, line: Column, as_of: datetime, keep=()) -> DataFrame:
    """(nanosecond string, raw line) per event; an unreadable time becomes ``as_of``."""
    us = F.unix_micros(F.coalesce(F.try_to_timestamp(timestamp), F.lit(as_of).cast("timestamp")))
    return events.select(*keep, us.alias("us"), (us * 1000).cast("string").alias("ns"), line.alias("line"))


def push_batches(rows: DataFrame, row_id: str, size: int = K.LOKI_BATCH_SIZE, shards: int = 1,
                 labels: dict[str, str] | None = None) -> DataFrame:
    """Push documents of at most ``size`` entries, in time order inside an hour and shard.

    Hours and shards are filled side by side; the rank inside them is taken over minutes, so
    no task sorts more than one minute of one shard.  ``rows`` needs us, ns and line.
    """
    placed = rows.withColumns({
        "hour": F.floor(F.col("us") / 3_600_000_000).cast("long"),
        "minute": F.floor(F.col("us") / 60_000_000).cast("long"),
        "shard": F.pmod(F.col(row_id), F.lit(shards)).cast("int")})
    ranked = rank_within(placed, ["hour", "shard"], "minute", [F.col("us"), F.col(row_id)], "_rank", "_n")
    entries = F.array_sort(F.collect_list(F.struct("_rank", F.array("ns", "line").alias("entry"))))
    batches = (ranked.groupBy("hour", "shard", F.floor(F.col("_rank") / size).cast("int").alias("batch"))
               .agg(F.count("*").alias("entries"), entries.alias("_e")))
    label = F.struct(*[F.lit(v).alias(k) for k, v in (labels or {"job": "eve"}).items()])
    stream = F.struct(label.alias("stream"), F.transform("_e", lambda e: e.getField("entry")).alias("values"))
    return batches.select(
        "hour", "shard", "batch", "entries",
        F.col("_e")[0].getField("entry")[0].alias("first_ns"),
        F.element_at("_e", -1).getField("entry")[0].alias("last_ns"),
        F.to_json(F.struct(F.array(stream).alias("streams"))).alias("payload"))
