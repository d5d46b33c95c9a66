"""Sources and sinks: tables written as landed files in the shared folder and read back."""

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.catalog.alerts import eve_lines
from wirelens.catalog.flows import ALLOW_SQL, SQL_25, rounded, scored_ctes
from wirelens.catalog.registry import oracle, query
from wirelens.catalog.triage import CTES, V as TRIAGE, _FLAT_SQL, _flat, _queue, _store
from wirelens.operators import flow_records as R
from wirelens.plans.flow_alerting import fit_anomaly_model
from wirelens.session import scratch_folder
from wirelens.sources import eve, store, tables, views
from wirelens.streaming import jobs


def _iso(us):
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+0000")


def _land_flows(spark, sf) -> str:
    """Flow events as sensor log lines, every seventh line broken."""
    f = views.eve_flow(spark, sf)
    line = F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+0000").alias("timestamp"), F.lit("flow").alias("event_type"),
        F.col("flow_id").cast("string").alias("flow_id"), "src_ip", F.col("dst_ip").alias("dest_ip"), "src_port",
        F.col("dst_port").alias("dest_port"), "proto",
        F.struct("pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient", _iso(F.col("start_us")).alias("start"),
                 _iso(F.col("end_us")).alias("end"), "age").alias("flow")))
    path = scratch_folder(spark, "eve")
    f.select(F.when(F.col("flow_id") % 7 == 0, F.substring(line, 1, 40)).otherwise(line).alias("value")).write.text(path)
    return path


_PICKED = ["Flow Duration", "Flow Bytes/s", "Flow IAT Mean", "Average Packet Size"]


@query("src_eve_batch")
def _(spark, sf):
    events = eve.good_lines(eve.src_eve_batch(spark, _land_flows(spark, sf)))
    features = R.eve_features_25(R.min_packets_filter(eve.flow_records(events)))
    return features.select(F.col("flow_id").cast("long").alias("flow_id"), "quality", *rounded(_PICKED))


_D = "CASE WHEN greatest(end_us - start_us, 0) = 0 AND age > 0 THEN age * 1000000 ELSE greatest(end_us - start_us, 0) END"
oracle("src_eve_batch", ["v_eve_flow"], f"""SELECT flow_id, CASE WHEN pkts_toserver + pkts_toclient >= 5 AND _d > 0 THEN 'full'
 ELSE 'partial' END AS quality, """ + ", ".join(
    f'round(CAST({SQL_25[n]} AS DOUBLE), {0 if "IAT" in n or "Duration" in n else 6}) AS "{n}"' for n in _PICKED)
    + f" FROM (SELECT *, {_D} AS _d FROM v_eve_flow WHERE flow_id % 7 <> 0 AND pkts_toserver + pkts_toclient >= 2)")


@query("src_eve_alerts")
def _(spark, sf):
    path = scratch_folder(spark, "eve")
    a = views.ids_alerts(spark, sf)
    a.select(F.when(F.col("k") % 10 == 3, "{broken").otherwise(eve_lines()).alias("value")).write.text(path)
    got = eve.src_eve_alerts(spark, path)
    return got.select(F.unix_micros("ts").alias("us"), "sid", "severity", "signature", "category", "src_ip", "dest_ip")


oracle("src_eve_alerts", ["v_ids_alerts"], """SELECT epoch_us(ts) AS us, sid, severity, signature, category, src_ip, dest_ip
 FROM v_ids_alerts WHERE k % 10 <> 3""")


@query("src_flow_table")
def _(spark, sf):
    """CSV files with columns in different order, one group without a price."""
    folder = scratch_folder(spark, "table")
    o = views.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("label"))
    for i, columns in enumerate((["row_id", "price", "label"], ["label", "price", "row_id"], ["label", "row_id"])):
        o.where(F.col("row_id") % 3 == i).select(*columns).write.option("header", True).csv(f"{folder}/part{i}")
    got = tables.src_flow_table(spark, folder, ["row_id", "price"])
    return got.select(F.col("row_id").cast("long").alias("row_id"), "label", F.round("price", 2).alias("price"))


oracle("src_flow_table", [], """SELECT o_orderkey AS row_id, o_orderstatus AS label,
 round(CASE WHEN o_orderkey % 3 <> 2 THEN CAST(o_totalprice AS DOUBLE) END, 2) AS price FROM orders""")


@query("src_queue")
def _(spark, sf):
    path = scratch_folder(spark, "queue")
    entries = _queue(spark, sf)
    store.append_json(entries.where("queued_at < '2024-01-15'"), path)
    store.append_json(entries.where("queued_at >= '2024-01-15'"), path)
    return eve.src_queue(spark, path).select("alert_id", "alert.rule_id", "alert.full_log", "triage.severity", "triage.action",
                                             "queued_at")


oracle("src_queue", TRIAGE, """SELECT id AS alert_id, rule_id, full_log, severity, action, queued_at
 FROM judged""", CTES)


@query("src_lessons")
def _(spark, sf):
    root = scratch_folder(spark, "lessons")
    store.save_lessons(_store(spark, sf), root)
    again = store.src_lessons(spark, root)
    store.save_lessons(again.withColumn("hits", F.col("hits") + 1), root)  # replaces the table it reads
    return _flat(store.src_lessons(spark, root))


oracle("src_lessons", TRIAGE, f"SELECT {_FLAT_SQL} FROM (SELECT * REPLACE (hits + 1 AS hits) FROM store)", CTES)


@query("stream_score_flows")
def _(spark, sf):
    """Live alerting over landed files: the model is fitted on the batch table, alerts come from the stream."""
    landed = _land_flows(spark, sf)
    batch = R.eve_features_25(R.min_packets_filter(views.eve_flow(spark, sf), K.LIVE_MIN_PACKETS))
    model = fit_anomaly_model(batch)
    folder = scratch_folder(spark, "alerts")
    jobs.stream_score_flows(eve.src_eve_stream(spark, landed), model, views.ALLOW_RULES, f"{folder}/out",
                            f"{folder}/checkpoint", None).awaitTermination()
    schema = "flow_id string, severity string, src_ip string, ratio double"
    return spark.read.schema(schema).json(f"{folder}/out/*").select(F.col("flow_id").cast("long").alias("flow_id"),
                                                                   "severity", "src_ip", "ratio")


oracle("stream_score_flows", ["v_eve_flow"], f"""SELECT flow_id, severity, src_ip, round_even(score / t, 2) AS ratio FROM tiered
 WHERE severity IS NOT NULL AND flow_id % 7 <> 0 AND ({ALLOW_SQL}) IS NULL""", scored_ctes())
