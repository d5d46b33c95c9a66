"""Intrusion-detection alert analytics, push batches and metric windows."""

from datetime import timedelta

from pyspark.sql import functions as F

from wirelens import constants as K, schemas
from wirelens.catalog.registry import oracle, query
from wirelens.operators import counters as C, ids_alerts as A, metric_windows as M
from wirelens.sources import views

V = ["v_ids_alerts"]
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
KNOWN = ", ".join(str(s) for s in K.INFRA_SIDS)
STREAMS = ", ".join(str(s) for s in K.STREAM_SIDS)
NOTIFY_SQL = """CASE WHEN severity = 1 THEN 'CRITICAL' WHEN severity = 2 THEN 'WARNING'
 WHEN contains(signature, 'HUNTING') THEN 'HUNTING' ELSE 'INFO' END"""
REVIEW_SQL = f"""CASE WHEN sid IN ({KNOWN}) THEN 'KNOWN_INFRA'
 WHEN {' OR '.join(f"contains(signature, '{m}')" for m in K.STREAM_MARKERS)} THEN 'STREAM_NOISE'
 WHEN severity = 1 THEN 'ACTION_REQUIRED' WHEN severity = 2 THEN 'REVIEW'
 WHEN contains(signature, 'HUNTING') THEN 'HUNTING' WHEN contains(signature, 'INFO') THEN 'INFORMATIONAL'
 ELSE 'UNCLASSIFIED' END"""
REASON_SQL = ("CASE " + " ".join(f"WHEN sid = {s} THEN '{n}'" for s, n in K.INFRA_SIDS.items())
              + " ".join(f" WHEN class = '{c}' THEN '{r}'" for c, r in K.REVIEW_REASONS.items()) + " END")
CLASSED = {"classed": f"SELECT *, {REVIEW_SQL} AS class FROM v_ids_alerts"}


def _alerts(spark, sf):
    return views.ids_alerts(spark, sf)


def _recent(spark, sf, **back):
    return A.lookback_filter(_alerts(spark, sf), views.AS_OF, timedelta(**back))


@query("lookback_filter")
def _(spark, sf):
    return _recent(spark, sf, days=4, hours=8).select("event_id", "ts")


oracle("lookback_filter", V, f"""SELECT event_id, ts FROM v_ids_alerts
 WHERE ts >= {AS_OF_SQL} - INTERVAL 104 HOUR""")


@query("severity_filter")
def _(spark, sf):
    return A.severity_filter(_alerts(spark, sf), 1).select("event_id", "sid")


oracle("severity_filter", V, "SELECT event_id, sid FROM v_ids_alerts WHERE severity = 1")


@query("sid_suppress")
def _(spark, sf):
    return A.sid_suppress(_alerts(spark, sf), [*K.INFRA_SIDS, *K.STREAM_SIDS]).select("event_id", "sid")


oracle("sid_suppress", V, f"SELECT event_id, sid FROM v_ids_alerts WHERE sid NOT IN ({KNOWN}, {STREAMS})")

LIMITS = [(2210020, 1, 86_400 * 3), (2024012, 2, 86_400 * 10), (2024050, 1, 86_400 * 30)]


@query("sid_rate_limit")
def _(spark, sf):
    return A.sid_rate_limit(_alerts(spark, sf), LIMITS).select("event_id", "sid", "src_ip")


_CASE = "CASE " + " ".join(f"WHEN sid = {s} THEN {{}}" for s, _, _ in LIMITS) + " END"
oracle("sid_rate_limit", V, f"""SELECT event_id, sid, src_ip FROM (SELECT *, row_number() OVER (
 PARTITION BY sid, src_ip, floor(epoch_us(ts) / ({_CASE.format(*[sec for _, _, sec in LIMITS])} * 1000000.0))
 ORDER BY ts, event_id) AS n, {_CASE.format(*[c for _, c, _ in LIMITS])} AS lim FROM v_ids_alerts)
 WHERE lim IS NULL OR n <= lim""")


@query("classify_notify")
def _(spark, sf):
    return _alerts(spark, sf).select("event_id", A.classify_notify().alias("class"))


oracle("classify_notify", V, f"SELECT event_id, {NOTIFY_SQL} AS class FROM v_ids_alerts")


@query("classify_review")
def _(spark, sf):
    return _alerts(spark, sf).select("event_id", A.classify_review().alias("class"), A.review_reason().alias("reason"))


oracle("classify_review", V, f"SELECT event_id, class, {REASON_SQL} AS reason FROM classed", CLASSED)


@query("alert_key")
def _(spark, sf):
    return _alerts(spark, sf).select("event_id", A.alert_key().alias("key"))


oracle("alert_key", V, "SELECT event_id, sid || ':' || src_ip || ':' || dest_ip AS key FROM v_ids_alerts")

_KEYED = {"keyed": "SELECT *, sid || ':' || src_ip || ':' || dest_ip AS key FROM v_ids_alerts"}
CUT = "TIMESTAMP '2024-01-05 00:00:00'"


def _sent_and_new(spark, sf):
    alerts = _alerts(spark, sf)
    old = F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")
    sent = alerts.where(old).groupBy(A.alert_key().alias("key")).agg(F.max("ts").alias("last_ts"))
    return sent, alerts.where(~old)


@query("dedup_sent")
def _(spark, sf):
    sent, new = _sent_and_new(spark, sf)
    return A.dedup_sent(new, sent).select("event_id", "key")


oracle("dedup_sent", V, f"""SELECT event_id, key FROM keyed WHERE ts >= {CUT}
 AND key NOT IN (SELECT key FROM keyed WHERE ts < {CUT})""", _KEYED)


@query("sent_keys_update")
def _(spark, sf):
    sent, new = _sent_and_new(spark, sf)
    return A.sent_keys_update(sent, A.dedup_sent(new, sent))


oracle("sent_keys_update", V, f"""SELECT key, max(ts) AS last_ts FROM keyed WHERE ts < {CUT}
 OR key NOT IN (SELECT key FROM keyed WHERE ts < {CUT}) GROUP BY key""", _KEYED)


@query("notify_digest")
def _(spark, sf):
    return A.notify_digest(A.sid_suppress(_alerts(spark, sf), [*K.INFRA_SIDS, *K.STREAM_SIDS]))


oracle("notify_digest", V, f"""SELECT class, CAST(class_alerts AS BIGINT) AS class_alerts, CAST(place AS INT) AS place,
 signature, alerts, sid, severity, src_ip, dest_ip FROM (
 SELECT *, sum(alerts) OVER (PARTITION BY class) AS class_alerts,
  row_number() OVER (PARTITION BY class ORDER BY alerts DESC, f) AS place FROM (
  SELECT class, signature, count(*) AS alerts, min(rn) AS f, arg_min(sid, rn) AS sid, arg_min(severity, rn) AS severity,
   arg_min(src_ip, rn) AS src_ip, arg_min(dest_ip, rn) AS dest_ip
  FROM (SELECT *, {NOTIFY_SQL} AS class, row_number() OVER (ORDER BY ts, event_id) AS rn FROM v_ids_alerts
        WHERE sid NOT IN ({KNOWN}, {STREAMS})) GROUP BY class, signature)) WHERE place <= 5""")


@query("review_class_counts")
def _(spark, sf):
    return A.review_class_counts(_alerts(spark, sf), show_all=True)


oracle("review_class_counts", V, "SELECT CAST(CASE class " + " ".join(
    f"WHEN '{c}' THEN {i + 1}" for i, c in enumerate(K.REVIEW_CLASSES)) + """ END AS INT) AS place, class,
 count(*) AS alerts, (SELECT min(ts) FROM classed) AS first_ts, (SELECT max(ts) FROM classed) AS last_ts
 FROM classed GROUP BY class""", CLASSED)


@query("review_top_sids")
def _(spark, sf):
    return A.review_top_sids(A.sid_suppress(_alerts(spark, sf), list(K.INFRA_SIDS)))


oracle("review_top_sids", V, f"""SELECT sid, count(*) AS alerts, arg_min(signature, rn) AS signature,
 arg_min(severity, rn) AS severity, arg_min(category, rn) AS category, arg_min(class, rn) AS class
 FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM classed WHERE sid NOT IN ({KNOWN}))
 GROUP BY sid ORDER BY alerts DESC, min(rn) LIMIT 15""", CLASSED)

_PLACE = "CASE class WHEN 'ACTION_REQUIRED' THEN 1 WHEN 'REVIEW' THEN 2 WHEN 'UNCLASSIFIED' THEN 3 END"


@query("review_actionable")
def _(spark, sf):
    return A.review_actionable(_alerts(spark, sf)).select("event_id", "sid", "class", "reason")


oracle("review_actionable", V, f"""SELECT event_id, sid, class, {REASON_SQL} AS reason FROM (
 SELECT *, row_number() OVER (PARTITION BY sid, src_ip, dest_ip ORDER BY place, ts, event_id) AS n FROM (
 SELECT *, {_PLACE} AS place FROM classed WHERE {_PLACE} IS NOT NULL ORDER BY place DESC, ts DESC, event_id DESC
 LIMIT 30)) WHERE n = 1""", CLASSED)


@query("export_actionable")
def _(spark, sf):
    return A.export_actionable(_alerts(spark, sf)).select("event_id", "sid", "signature", "class", "reason")


oracle("export_actionable", V, f"""SELECT event_id, sid, signature, class, {REASON_SQL} AS reason FROM classed
 WHERE class IN ('ACTION_REQUIRED', 'REVIEW', 'UNCLASSIFIED', 'HUNTING')""", CLASSED)


@query("alert_detail")
def _(spark, sf):
    return A.alert_detail(_alerts(spark, sf)).select("event_id", "sid", "signature", "category", "class", "reason")


oracle("alert_detail", V, f"""SELECT event_id, sid, signature, category, class, {REASON_SQL} AS reason FROM (
 SELECT * FROM classed ORDER BY ts DESC, event_id DESC LIMIT 20)
 WHERE class NOT IN ('KNOWN_INFRA', 'STREAM_NOISE')""", CLASSED)

_NIGHT = {"night": f"SELECT * FROM v_ids_alerts WHERE ts >= {AS_OF_SQL} - INTERVAL 8 HOUR"}


def _night(spark, sf):
    return _recent(spark, sf, hours=8)


@query("overnight_summary")
def _(spark, sf):
    return A.overnight_summary(_night(spark, sf))


oracle("overnight_summary", V, f"""SELECT *, CASE WHEN actionable = 0 THEN 'GREEN' WHEN actionable < 10 THEN 'YELLOW'
 ELSE 'RED' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (sid NOT IN ({KNOWN})) AS actionable,
 count(DISTINCT signature) FILTER (sid NOT IN ({KNOWN})) AS signatures FROM night)""", _NIGHT)


@query("overnight_top5")
def _(spark, sf):
    return A.overnight_top5(_recent(spark, sf, days=10))


oracle("overnight_top5", V, f"""SELECT signature, count(*) AS alerts, arg_min(severity, rn) AS severity,
 arg_min(sid, rn) AS sid FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM v_ids_alerts
 WHERE ts >= {AS_OF_SQL} - INTERVAL 10 DAY AND sid NOT IN ({KNOWN})) GROUP BY signature
 ORDER BY alerts DESC, min(rn) LIMIT 5""")


@query("status_tier")
def _(spark, sf):
    per_hour = _alerts(spark, sf).groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count_if(~F.col("sid").isin(*K.INFRA_SIDS)).alias("actionable"))
    return per_hour.withColumn("status", A.status_tier(F.col("actionable")))


oracle("status_tier", V, f"""SELECT *, CASE WHEN actionable = 0 THEN 'GREEN' WHEN actionable < 10 THEN 'YELLOW'
 ELSE 'RED' END AS status FROM (SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour,
 count(*) FILTER (sid NOT IN ({KNOWN})) AS actionable FROM v_ids_alerts GROUP BY 1)""")


@query("handoff_issues")
def _(spark, sf):
    night = A.overnight_summary(_night(spark, sf))
    errors = views.predictions(spark, sf).agg(F.count_if(F.col("status") >= 500).alias("value"))
    checks = (night.select(F.lit("ids").alias("name"), F.col("actionable").alias("value"),
                           (F.col("actionable") == 0).alias("healthy"),
                           F.lit("%s actionable IDS alerts overnight").alias("template"))
              .unionByName(errors.select(F.lit("requests").alias("name"), "value", (F.col("value") == 0).alias("healthy"),
                                         F.lit("%s requests failed").alias("template")))
              .unionByName(night.select(F.lit("signatures").alias("name"), F.col("signatures").alias("value"),
                                        (F.col("signatures") < 1000).alias("healthy"),
                                        F.lit("%s distinct signatures").alias("template"))))
    return A.handoff_issues(checks)


oracle("handoff_issues", [*V, "v_predictions"], f"""SELECT 'ids' AS name, count(*) || ' actionable IDS alerts overnight' AS issue
 FROM night WHERE sid NOT IN ({KNOWN}) HAVING count(*) > 0
 UNION ALL SELECT 'requests', count(*) || ' requests failed' FROM v_predictions WHERE status >= 500 HAVING count(*) > 0
 UNION ALL SELECT 'signatures', count(DISTINCT signature) || ' distinct signatures' FROM night
 WHERE sid NOT IN ({KNOWN}) HAVING count(DISTINCT signature) >= 1000""", _NIGHT)


def eve_lines():
    """Sensor log lines of the alert view."""
    return F.to_json(F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+0000").alias("timestamp"), F.lit("alert").alias("event_type"),
        F.col("event_id").cast("string").alias("flow_id"), "src_ip", "dest_ip",
        F.struct("severity", "signature", F.col("sid").alias("signature_id"), "category").alias("alert")))


@query("ids_alert_record")
def _(spark, sf):
    lines = _alerts(spark, sf).select(eve_lines().alias("line"))
    events = lines.select(F.from_json("line", schemas.EVE).alias("e")).select("e.*")
    return A.ids_alert_record(events).drop("src_port", "dest_port", "proto", "community_id")


oracle("ids_alert_record", V, """SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f+0000') AS timestamp, 'ids_alert' AS type,
 severity, signature, sid AS signature_id, category, src_ip, dest_ip FROM v_ids_alerts""")


@query("event_type_counts")
def _(spark, sf):
    return A.event_type_counts(views.table(spark, sf, "events"))


oracle("event_type_counts", [], "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")


def _loki(spark, sf):
    stamp = F.when(F.col("k") % 10 == 0, "bad time").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS+0000"))
    line = F.concat_ws(" ", F.col("sid").cast("string"), "signature", "src_ip")
    return A.loki_rows(_alerts(spark, sf), stamp, line, views.AS_OF, keep=["event_id"])


_LOKI = {"rows": f"""SELECT event_id, us, CAST(us * 1000 AS VARCHAR) AS ns, line FROM (
 SELECT event_id, epoch_us(CASE WHEN k % 10 = 0 THEN {AS_OF_SQL} ELSE ts END) AS us,
 sid || ' ' || signature || ' ' || src_ip AS line FROM v_ids_alerts)"""}


@query("loki_rows")
def _(spark, sf):
    return _loki(spark, sf)


oracle("loki_rows", V, "SELECT * FROM rows", _LOKI)


@query("loki_batches")
def _(spark, sf):
    batches = A.push_batches(_loki(spark, sf), "event_id", 50, shards=2)
    return batches.withColumn("payload", F.md5("payload"))


oracle("loki_batches", V, """SELECT hour, shard, batch, count(*) AS entries, min_by(ns, r) AS first_ns,
 max_by(ns, r) AS last_ns, md5('{"streams":[{"stream":{"job":"eve"},"values":['
 || string_agg('["' || ns || '","' || line || '"]', ',' ORDER BY r) || ']}]}') AS payload
 FROM (SELECT *, CAST(floor(r / 50) AS INT) AS batch FROM (SELECT *, row_number() OVER (PARTITION BY hour, shard
  ORDER BY us, event_id) - 1 AS r FROM (SELECT *, CAST(floor(us / 3600000000) AS BIGINT) AS hour,
  CAST(event_id % 2 AS INT) AS shard FROM rows))) GROUP BY hour, shard, batch""", _LOKI)

# --- metric windows ----------------------------------------------------------
P = ["v_predictions"]
H = 3600


def _pred(spark, sf):
    return views.predictions(spark, sf)


def _window_sql(bad, size_h, limit):
    return f"""SELECT *, CAST(bad AS DOUBLE) / n AS share, CASE WHEN CAST(bad AS DOUBLE) / n > {limit} THEN 1 ELSE 0 END AS firing
 FROM (SELECT (h - i) * 3600000000 AS window_us, count(*) AS n, count(*) FILTER ({bad}) AS bad
 FROM (SELECT *, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM v_predictions), range({size_h}) AS t(i)
 GROUP BY 1)"""


_ATTACK = {"rates": _window_sql("prediction <> 'BENIGN'", 5, 0.25)}


@query("attack_rate_window")
def _(spark, sf):
    out = M.attack_rate_window(_pred(spark, sf), 5 * H, H, 0.25)
    return out.withColumn("share", F.round("share", 6))


oracle("attack_rate_window", P, "SELECT * REPLACE (round(share, 6) AS share) FROM rates", _ATTACK)


@query("error_rate_window")
def _(spark, sf):
    out = M.error_rate_window(_pred(spark, sf), 5 * H, H)
    return out.withColumn("share", F.round("share", 6))


oracle("error_rate_window", P, "SELECT * REPLACE (round(share, 6) AS share) FROM rates",
       {"rates": _window_sql("status >= 500", 5, 0.01)})


@query("latency_p95_window")
def _(spark, sf):
    out = M.latency_p95_window(_pred(spark, sf), 5 * H, 0.03)
    return out.withColumn("latency", F.round("latency", 9))


oracle("latency_p95_window", P, """SELECT window_us, n, round(l, 9) AS latency, CASE WHEN l > 0.03 THEN 1 ELSE 0 END AS firing
 FROM (SELECT CAST(floor(epoch_us(ts) / 18000000000) * 18000000000 AS BIGINT) AS window_us, count(*) AS n,
 quantile_cont(latency_s, 0.95) AS l FROM v_predictions GROUP BY 1)""")


@query("latency_p95_histogram")
def _(spark, sf):
    out = C.latency_p95_histogram(views.latency_samples(spark, sf), 5 * H, 0.03)
    return out.select("window_us", F.round("rate", 9).alias("rate"), F.round("latency", 9).alias("latency"), "firing")


oracle("latency_p95_histogram", ["v_latency_samples"], """SELECT window_us, round(total, 9) AS rate, round(latency, 9) AS latency,
 CASE WHEN latency > 0.03 THEN 1 WHEN latency IS NOT NULL THEN 0 END AS firing FROM (
 SELECT window_us, max(total) AS total, CASE WHEN max(total) > 0 THEN min(CASE WHEN le = CAST('inf' AS DOUBLE) THEN low
  ELSE low + (le - low) * (rank - under) / (r - under) END) FILTER (r >= rank AND under < rank) END AS latency
 FROM (SELECT *, 0.95 * total AS rank, lag(le, 1, 0) OVER w AS low, lag(r, 1, 0) OVER w AS under
  FROM (SELECT window_us, le, max(r) OVER (PARTITION BY window_us ORDER BY le) AS r, max(r) OVER (PARTITION BY window_us) AS total FROM merged)
  WINDOW w AS (PARTITION BY window_us ORDER BY le)) GROUP BY window_us)""", {
    "stepped": f"""SELECT *, us // {5 * H}000000 * {5 * H}000000 AS window_us, lag(value) OVER (
  PARTITION BY instance, le, us // {5 * H}000000 ORDER BY us) AS before FROM v_latency_samples""",
    "spans": """SELECT window_us, instance, le, count(*) AS n, min(us) AS a, max(us) AS b, min_by(value, us) AS v,
  CAST(max_by(value, us) - min_by(value, us) + sum(CASE WHEN value < before THEN before ELSE 0 END) AS DOUBLE) AS up,
  (max(us) - min(us)) / 1e6 AS span FROM stepped GROUP BY 1, 2, 3 HAVING max(us) > min(us)""",
    "carried": f"""SELECT *, span / (n - 1) AS mean, CASE WHEN up > 0 THEN least((a - window_us) / 1e6, span * v / up)
  ELSE (a - window_us) / 1e6 END AS ahead, (window_us + {5 * H}000000 - b) / 1e6 AS behind FROM spans""",
    "merged": f"""SELECT window_us, le, sum(up * ((span + CASE WHEN ahead < mean * 1.1 THEN ahead ELSE mean / 2 END
  + CASE WHEN behind < mean * 1.1 THEN behind ELSE mean / 2 END) / span) / {5 * H}) AS r FROM carried GROUP BY 1, 2"""})


@query("silence_detect")
def _(spark, sf):
    p = _pred(spark, sf)
    return M.silence_detect(p.where("prediction <> 'PortScan'"), p.where("prediction = 'DoS'"), 300)


oracle("silence_detect", P, """SELECT window_us, CASE WHEN s IS NULL THEN 'down' ELSE 'silent' END AS state FROM (
 SELECT unnest(generate_series((SELECT min(window_us) FROM up), (SELECT max(window_us) FROM up), 300000000)) AS window_us)
 LEFT JOIN (SELECT window_us, count(*) AS s FROM up GROUP BY 1) USING (window_us)
 LEFT JOIN (SELECT window_us, count(*) FILTER (prediction = 'DoS') AS e FROM slots GROUP BY 1) USING (window_us)
 WHERE s IS NULL OR coalesce(e, 0) = 0""", {
    "slots": "SELECT *, CAST(floor(epoch_us(ts) / 300000000) AS BIGINT) * 300000000 AS window_us FROM v_predictions",
    "up": "SELECT * FROM slots WHERE prediction <> 'PortScan'"})


@query("sustained_for")
def _(spark, sf):
    return M.sustained_for(M.attack_rate_window(_pred(spark, sf), 5 * H, H, 0.25), H, 3 * H)


oracle("sustained_for", P, """SELECT min(window_us) AS from_us, max(window_us) AS to_us, count(*) AS windows FROM (
 SELECT window_us, window_us - row_number() OVER (ORDER BY window_us) * 3600000000 AS g FROM rates WHERE firing = 1)
 GROUP BY g HAVING max(window_us) - min(window_us) >= 10800000000""", _ATTACK)
