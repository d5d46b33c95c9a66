"""Streams over the tables, run until nothing is left to read; results must equal SQL over the whole table."""

from pyspark.sql import DataFrame, functions as F

from wirelens.catalog.flows import DAY
from wirelens.catalog.packets import ACTIVE_S, AGED, IDLE_S, KEY
from wirelens.catalog.registry import oracle, query
from wirelens.operators import packets as P
from wirelens.session import scratch_folder
from wirelens.sources import views
from wirelens.streaming import jobs, rules, state

DELAY_S = 60


def _drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything an available-now run of the stream gives out, one folder per batch."""
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession, "stream")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")
    jobs.stream_microbatch(stream, write, f"{folder}/checkpoint", None, mode).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out/*")


def _keyed_state(spark):
    for name, value in state.ROCKSDB.items():
        spark.conf.set(name, value)


@query("stream_counters")
def _(spark, sf):
    counts = jobs.stream_counters(views.stream_table(spark, sf, "events"), "event_type")
    return _drained(counts, "update").groupBy("event_type").agg(F.max("events").alias("events"))


oracle("stream_counters", [], "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")


@query("stream_attack_rate")
def _(spark, sf):
    p = views.predictions(spark, sf, views.stream_table)
    rates = _drained(jobs.stream_attack_rate(p, "5 hours", "1 hour", 0.25, f"{DELAY_S} seconds"))
    return rates.withColumn("share", F.round("share", 6))


oracle("stream_attack_rate", ["v_predictions"], f"""SELECT window_us, n, bad, round(CAST(bad AS DOUBLE) / n, 6) AS share,
 CASE WHEN CAST(bad AS DOUBLE) / n > 0.25 THEN 1 ELSE 0 END AS firing
 FROM (SELECT (h - i) * 3600000000 AS window_us, count(*) AS n, count(*) FILTER (prediction <> 'BENIGN') AS bad
 FROM (SELECT *, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM v_predictions), range(5) AS t(i) GROUP BY 1)
 WHERE window_us + 18000000000 <= (SELECT max(epoch_us(ts)) FROM v_predictions) - {DELAY_S} * 1000000""")


@query("stream_dedup_alerts")
def _(spark, sf):
    alerts = views.ids_alerts(spark, sf, views.stream_table)
    return _drained(jobs.stream_dedup_alerts(alerts, "365 days").select("key"))


oracle("stream_dedup_alerts", ["v_ids_alerts"], """SELECT DISTINCT sid || ':' || src_ip || ':' || dest_ip AS key
 FROM v_ids_alerts""")


@query("stream_cooldown")
def _(spark, sf):
    _keyed_state(spark)
    alerts = views.ids_alerts(spark, sf, views.stream_table)
    out = _drained(state.stream_cooldown(alerts, DAY, "event_id", ("src_ip", "dest_ip")))
    return out.select(F.col("row").alias("event_id"), F.col("admitted").cast("int").alias("admitted"))


oracle("stream_cooldown", ["v_ids_alerts"], """SELECT event_id, CASE WHEN event_id = first AND c.t0 IS NOT NULL THEN 1 ELSE 0 END
 AS admitted FROM (SELECT * FROM ev WHERE t0 <= (SELECT max(t0) FROM ev) - 60000000) ev LEFT JOIN chain c ON c.src_ip = ev.src_ip AND c.dest_ip = ev.dest_ip AND c.t0 = ev.t0
 JOIN (SELECT src_ip, dest_ip, t0, min(event_id) AS first FROM ev GROUP BY ALL) m
 ON m.src_ip = ev.src_ip AND m.dest_ip = ev.dest_ip AND m.t0 = ev.t0""", {
    "ev": "SELECT event_id, src_ip, dest_ip, epoch_us(ts) AS t0 FROM v_ids_alerts",
    "chain": f"""SELECT src_ip, dest_ip, min(t0) AS t0 FROM ev GROUP BY 1, 2 UNION ALL
 SELECT c.src_ip, c.dest_ip, min(e.t0) AS t0 FROM chain c JOIN ev e ON e.src_ip = c.src_ip AND e.dest_ip = c.dest_ip
 AND e.t0 >= c.t0 + {DAY}::BIGINT * 1000000 GROUP BY c.src_ip, c.dest_ip, c.t0"""}, recursive=True)


@query("stream_flow_sessions")
def _(spark, sf):
    _keyed_state(spark)
    packets = views.packets(spark, sf, views.stream_table)
    flows = _drained(state.stream_flow_sessions(packets, IDLE_S * 4, ACTIVE_S, f"{DELAY_S} seconds"))
    return flows.select(*P.KEY, "start_us", "end_us", (F.col("fwd_pkts") + F.col("bwd_pkts")).alias("packets"))


# a flow is out once the watermark has passed its idle limit or the packet that finds it too old
oracle("stream_flow_sessions", ["v_packets"], f"""SELECT {KEY}, start_us, end_us, packets FROM (SELECT *,
 lead(start_us) OVER (PARTITION BY {KEY} ORDER BY start_us) AS later FROM aged)
 WHERE later / 1000 < (SELECT max(us) FROM keyed) / 1000 - {DELAY_S} * 1000
 OR (end_us + {IDLE_S * 4}::BIGINT * 1000000) / 1000 < (SELECT max(us) FROM keyed) / 1000 - {DELAY_S} * 1000""", AGED, recursive=True)


@query("stream_silence")
def _(spark, sf):
    _keyed_state(spark)
    p = views.predictions(spark, sf, views.stream_table).withColumn("job", F.col("event_id") % 3)
    out = _drained(rules.stream_silence(p, F.col("prediction") == "DoS", ["job"], 3600, f"{DELAY_S} seconds"))
    return out.select("job", "window_us", "state")


oracle("stream_silence", ["v_predictions"], f"""SELECT job, window_us, CASE WHEN signs IS NULL THEN 'down' ELSE 'silent' END AS state
 FROM (SELECT job, unnest(generate_series(a, (SELECT (max(epoch_us(ts)) - {DELAY_S}000000) // 3600000000 - 1 FROM v_predictions) * 3600000000, 3600000000))
   AS window_us FROM (SELECT job, min(window_us) AS a FROM slots GROUP BY job))
 LEFT JOIN (SELECT job, window_us, count(*) AS signs, count(*) FILTER (prediction = 'DoS') AS events FROM slots GROUP BY ALL) USING (job, window_us)
 WHERE coalesce(events, 0) = 0""", {
    "slots": "SELECT event_id % 3 AS job, prediction, epoch_us(ts) // 3600000000 * 3600000000 AS window_us FROM v_predictions"})


@query("stream_sustained")
def _(spark, sf):
    _keyed_state(spark)
    p = views.predictions(spark, sf, views.stream_table)
    return _drained(rules.attack_rate_rule(p, size_s=18_000, step_s=3600, limit=0.25, for_s=10_800, delay=f"{DELAY_S} seconds"))


# a stretch is told when it has lasted three hours and again when a later window has ended it
oracle("stream_sustained", ["v_predictions"], f"""SELECT 'attack_rate' AS rule, from_us,
 CASE WHEN state = 'firing' THEN from_us + 10800000000 ELSE to_us END AS to_us, CASE WHEN state = 'firing' THEN 4 ELSE windows END AS windows, state
 FROM (SELECT min(window_us) AS from_us, max(window_us) AS to_us, count(*) AS windows FROM (
  SELECT window_us, window_us - row_number() OVER (ORDER BY window_us) * 3600000000 AS g FROM rates WHERE firing)
  GROUP BY g HAVING max(window_us) - min(window_us) >= 10800000000), (VALUES ('firing'), ('resolved')) AS s(state)
 WHERE state = 'firing' OR to_us < (SELECT max(window_us) FROM rates)""", {
    "rates": f"""SELECT window_us, CAST(count(*) FILTER (prediction <> 'BENIGN') AS DOUBLE) / count(*) > 0.25 AS firing
 FROM (SELECT prediction, (epoch_us(ts) // 3600000000 - i) * 3600000000 AS window_us FROM v_predictions, range(5) AS t(i)) GROUP BY 1
 HAVING window_us + 18000000000 <= (SELECT max(epoch_us(ts)) FROM v_predictions) - {DELAY_S}000000"""})
