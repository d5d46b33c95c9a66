"""Streaming forms of the alerting, analytics and triage paths."""

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from wirelens import constants as K
from wirelens.functions.time import micros
from wirelens.operators import flow_records, ids_alerts, lessons as L, routing, triage
from wirelens.plans.flow_alerting import AnomalyModel, route_alerts, score_flows
from wirelens.session import cut_lineage, use_utc
from wirelens.sources.eve import CORRUPT, flow_records as flows_of_events, good_lines
from wirelens.sources.store import append_once, load_mark, save_mark, src_lessons, update_lessons


def stream_microbatch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str,
                      seconds: float | None = 5, mode: str = "append") -> StreamingQuery:
    """Hand the stream to ``write(batch, batch_id)`` every ``seconds``; ``None`` processes what is
    there and stops.  The size of a batch is bounded by the source's maxFilesPerTrigger."""
    use_utc(stream.sparkSession)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def scored_stream(events: DataFrame, model: AnomalyModel, rules: list[dict],
                  min_packets: int = K.LIVE_MIN_PACKETS) -> DataFrame:
    """Sensor events to tiered flows: the batch operators on a stream, no state involved."""
    flows = flow_records.min_packets_filter(flows_of_events(events), min_packets)
    scored = score_flows(flow_records.eve_features_25(flows), model)
    return routing.allowlist_exclude(scored, rules).where(F.col("severity").isNotNull())


def stream_score_flows(events: DataFrame, model: AnomalyModel, rules: list[dict], out: str, checkpoint: str,
                       seconds: float | None = 5) -> StreamingQuery:
    """Every tiered flow as a payload with ``admitted``: true for the alerts to send, false for those that the
    pair's cooldown or the limit over all pairs holds back, null for warnings, which are only logged.

    Batches are judged in the order they arrive and by event time inside a batch.  Admissions that still count
    (a few for each window of the limit) are kept beside the checkpoint for the next batch, and those
    before a batch too, so that a replayed batch is judged as it was.
    """
    return stream_microbatch(scored_stream(events, model, rules), routing_batch(model, out, f"{checkpoint}/routing"),
                             checkpoint, seconds)


def routing_batch(model: AnomalyModel, out: str, marks: str, cooldown_s: float = K.ALERT_COOLDOWN_S):
    """foreachBatch body of the alert stream."""
    reach = int(max(cooldown_s, K.ALERT_WINDOW_S) * 1e6)

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        done = load_mark(spark, marks)
        earlier = done.get("before" if done.get("batch", -1) >= batch_id else "after") or []
        routed = cut_lineage(route_alerts(cut_lineage(batch), cooldown_s, earlier))
        append_once(out)(routing.alert_payload(routed, model.threshold, ["admitted"]), batch_id)
        passed = routed.where("admitted").select(micros(F.col("ts")).alias("us"), routing.pair_key().alias("pair"))
        newest = max([e[0] for e in earlier] + [passed.agg(F.max("us")).first()[0] or 0])
        recent = passed.where(F.col("us") >= newest - reach).collect()  # at most the limit for each window of reach
        after = [e for e in earlier if e[0] >= newest - reach] + [list(r) for r in recent]
        save_mark(spark, marks, batch=batch_id, before=earlier, after=after)
    return write


def stream_dedup_alerts(alerts: DataFrame, keep: str = "1 hour") -> DataFrame:
    """One alert per key within the watermark delay; repeats inside a run go too."""
    keyed = alerts.withColumn("key", ids_alerts.alert_key()).withWatermark("ts", keep)
    return keyed.dropDuplicatesWithinWatermark(["key"])


def stream_attack_rate(predictions: DataFrame, size: str = "5 minutes", slide: str = "1 minute",
                       limit: float = 0.1, delay: str = "1 minute") -> DataFrame:
    """Share of non-benign predictions per sliding window, given out once the window is complete."""
    counts = (predictions.withWatermark("ts", delay).groupBy(F.window("ts", size, slide).alias("w"))
              .agg(F.count("*").alias("n"), F.count_if(F.col("prediction") != K.BENIGN).alias("bad")))
    share = F.col("bad") / F.col("n")
    return counts.select(F.unix_micros("w.start").alias("window_us"), "n", "bad", share.alias("share"),
                         (share > limit).cast("int").alias("firing"))


def stream_counters(events: DataFrame, *by: str) -> DataFrame:
    """Running counts for an update-mode sink."""
    return events.groupBy(*by).agg(F.count("*").alias("events"))


def triage_batch(store: str, marks: str, queue: str, model_text: Callable[[DataFrame], DataFrame] | None = None,
                 now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)):
    """foreachBatch body of the triage stream.

    The queue part of a batch is one folder, so a replay replaces it.  Lesson hits are added
    once, to the newest lessons: a store version holds the number of the last batch whose hits are in it.  ``model_text`` adds the
    model's answer (column ``model_text``) to alerts without a lesson; without it the model counts as down.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, moment = batch.sparkSession, now()
        lessons = src_lessons(spark, store)
        compact = triage.compact_alert(batch)
        down = compact if model_text else compact.withColumn("model_text", F.lit(None).cast("string"))
        judged = triage.classify_cascade(down, lessons, model_up=model_text is not None, ask=model_text)
        entries = triage.queue_entries(judged, F.lit(L.iso(moment)))
        append_once(queue)(entries, batch_id)
        written = spark.read.schema(entries.schema).json(f"{queue}/batch={batch_id}")
        update_lessons(spark, store, lambda newest: L.lesson_hits(newest, written.select("triage.lesson_id"), moment), batch_id)
        done = load_mark(spark, marks)
        if done.get("batch", -1) < batch_id:
            top = written.agg(F.max("alert_id")).first()[0]
            save_mark(spark, marks, batch=batch_id, last_alert_id=top or done.get("last_alert_id"))
    return write


def stream_triage(alerts: DataFrame, store: str, marks: str, queue: str, checkpoint: str,
                  seconds: float | None = 5, **options) -> StreamingQuery:
    readable = (good_lines(alerts) if CORRUPT in alerts.columns else alerts).where(F.col("id").isNotNull())
    return stream_microbatch(readable, triage_batch(store, marks, queue, **options), checkpoint, seconds)
