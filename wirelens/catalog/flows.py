"""Flow records, allowlist, tiers and routed alerts."""

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.catalog.registry import oracle, query
from wirelens.functions.numeric import finite_or_zero, named, safe_div
from wirelens.functions.time import micros, parse_event_ts
from wirelens.operators import flow_records as R, preparation as P, routing, scoring
from wirelens.plans.flow_alerting import alert_flows, fit_anomaly_model, score_flows
from wirelens.session import cut_lineage
from wirelens.sources import views

V = ["v_eve_flow"]


def digits_of(name):
    """Decimals kept in a check: times run to 1e14 microseconds, so fewer are meaningful there."""
    return 0 if "IAT" in name or "Duration" in name else 6


def rounded(names):
    return [F.round(named(n), digits_of(n)).alias(n) for n in names]


# --- SQL for the 25 and 78 features -----------------------------------------
_D = "_d"
_DUR = ("CASE WHEN greatest(end_us - start_us, 0) = 0 AND age > 0 THEN age * 1000000 "
        "ELSE greatest(end_us - start_us, 0) END")


def _div(a, b):
    return f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0 END"


_PF, _PB, _BF, _BB = "pkts_toserver", "pkts_toclient", "bytes_toserver", "bytes_toclient"
SQL_25 = {
    "Flow Duration": _D, "Total Fwd Packets": _PF, "Total Backward Packets": _PB,
    "Total Length of Fwd Packets": _BF, "Total Length of Bwd Packets": _BB,
    "Fwd Packet Length Mean": _div(_BF, _PF), "Bwd Packet Length Mean": _div(_BB, _PB),
    "Flow Bytes/s": _div(f"({_BF} + {_BB})", f"({_D} / 1e6)"),
    "Flow Packets/s": _div(f"({_PF} + {_PB})", f"({_D} / 1e6)"),
    "Flow IAT Mean": _div(_D, f"greatest({_PF} + {_PB} - 1, 1)"),
    "Fwd IAT Mean": _div(_D, f"greatest({_PF} - 1, 1)"), "Bwd IAT Mean": _div(_D, f"greatest({_PB} - 1, 1)"),
    "Down/Up Ratio": _div(_PB, _PF), "Average Packet Size": _div(f"({_BF} + {_BB})", f"({_PF} + {_PB})"),
    "Subflow Fwd Bytes": _BF, "Subflow Bwd Bytes": _BB,
}
FEATURES_SQL = (
    "SELECT flow_id, src_ip, dst_ip, src_port, dst_port, proto, ts, "
    f"CASE WHEN {_PF} + {_PB} >= 5 AND _d > 0 THEN 'full' ELSE 'partial' END AS quality, "
    + ", ".join(f"CAST({SQL_25.get(n, '0')} AS DOUBLE) AS \"{n}\"" for n in K.FEATURES_25)
    + f" FROM (SELECT *, {_DUR} AS _d FROM v_eve_flow) WHERE {_PF} + {_PB} >= ")


def features_cte(minimum=K.LIVE_MIN_PACKETS):
    return {"feats": FEATURES_SQL + str(minimum)}


def sql_rounded(names):
    return ", ".join(f'round("{n}", {digits_of(n)}) AS "{n}"' for n in names)


def _flows(spark, sf, minimum=K.LIVE_MIN_PACKETS):
    return R.min_packets_filter(views.eve_flow(spark, sf), minimum)


def _features(spark, sf, minimum=K.LIVE_MIN_PACKETS):
    return R.eve_features_25(_flows(spark, sf, minimum))


@query("safe_div")
def _(spark, sf):
    f = views.eve_flow(spark, sf)
    return f.select("flow_id", F.round(safe_div(F.col(_BF), F.col(_PF)), 6).alias("zero_default"),
                    F.round(safe_div(F.col(_BB), F.col(_PB), -1.0), 6).alias("own_default"))


oracle("safe_div", V, f"""SELECT flow_id, round({_div(_BF, _PF)}, 6) AS zero_default,
 round(CASE WHEN {_PB} > 0 THEN {_BB} / {_PB} ELSE -1 END, 6) AS own_default FROM v_eve_flow""")


@query("parse_event_ts")
def _(spark, sf):
    e = views.table(spark, sf, "events")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(stamp, F.lit("-0800")))
            .when(F.col("event_id") % 4 == 1, F.concat(stamp, F.lit("+00:00")))
            .when(F.col("event_id") % 4 == 2, F.lit("not-a-date")))
    return e.select("event_id", parse_event_ts(text).alias("us"))


oracle("parse_event_ts", [], """SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(ts) + 28800000000
 WHEN 1 THEN epoch_us(ts) ELSE 0 END AS us FROM events""")


@query("flow_duration")
def _(spark, sf):
    return views.eve_flow(spark, sf).select("flow_id", R.flow_duration_us().alias("duration_us"))


oracle("flow_duration", V, f"SELECT flow_id, CAST({_DUR} AS BIGINT) AS duration_us FROM v_eve_flow")


@query("eve_features_25")
def _(spark, sf):
    f = _features(spark, sf, K.FILE_MIN_PACKETS)
    return f.select("flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "quality",
                    *rounded(K.FEATURES_25))


oracle("eve_features_25", V, f"""SELECT flow_id, src_ip, dst_ip, src_port, dst_port, proto, quality,
 {sql_rounded(K.FEATURES_25)} FROM feats""", features_cte(K.FILE_MIN_PACKETS))

_MEAN = _div(f"({_BF} + {_BB})", f"({_PF} + {_PB})")
SQL_78 = {
    "Destination Port": "dst_port", "Flow Duration": "age * 1000000", "Total Fwd Packets": _PF,
    "Total Backward Packets": _PB, "Total Length of Fwd Packets": _BF, "Total Length of Bwd Packets": _BB,
    "Fwd Packet Length Mean": _div(_BF, _PF), "Bwd Packet Length Mean": _div(_BB, _PB),
    "Flow Bytes/s": _div(f"({_BF} + {_BB})", "age"), "Flow Packets/s": _div(f"({_PF} + {_PB})", "age"),
    "Fwd Packets/s": _div(_PF, "age"), "Bwd Packets/s": _div(_PB, "age"), "Packet Length Mean": _MEAN,
    "Down/Up Ratio": _div(_PB, _PF), "Average Packet Size": _MEAN, "Avg Fwd Segment Size": _div(_BF, _PF),
    "Avg Bwd Segment Size": _div(_BB, _PB), "Subflow Fwd Packets": _PF, "Subflow Fwd Bytes": _BF,
    "Subflow Bwd Packets": _PB, "Subflow Bwd Bytes": _BB,
}


@query("eve_features_78")
def _(spark, sf):
    f = R.eve_features_78(views.eve_flow(spark, sf))
    return f.select("flow_id", *[named(n).cast("double").alias(n) for n in K.FEATURES_78])


oracle("eve_features_78", V, "SELECT flow_id, " + ", ".join(
    f'CAST(CAST({SQL_78.get(n, "0")} AS FLOAT) AS DOUBLE) AS "{n}"' for n in K.FEATURES_78) + " FROM v_eve_flow")


@query("sanitize_nonfinite")
def _(spark, sf):
    d = views.labelled(spark, sf)
    nan = F.when(F.col("f2") == 0.05, float("nan")).otherwise(F.col("f2"))
    return d.select("row_id", finite_or_zero(F.col("f1")).alias("f1"), finite_or_zero(nan).alias("f2"))


oracle("sanitize_nonfinite", ["v_labelled"], """SELECT row_id, CASE WHEN f1 IS NULL OR isinf(f1) THEN 0 ELSE f1 END AS f1,
 CASE WHEN f2 = 0.05 THEN 0 ELSE f2 END AS f2 FROM v_labelled""")


@query("flow_quality")
def _(spark, sf):
    f = views.eve_flow(spark, sf)
    return f.select("flow_id", R.flow_quality(R.flow_duration_us()).alias("quality"))


oracle("flow_quality", V, f"""SELECT flow_id, CASE WHEN {_PF} + {_PB} >= 5 AND {_DUR} > 0 THEN 'full'
 ELSE 'partial' END AS quality FROM v_eve_flow""")


@query("min_packets_filter")
def _(spark, sf):
    return _flows(spark, sf, 100).select("flow_id", R.total_packets().alias("packets"))


oracle("min_packets_filter", V, f"""SELECT flow_id, {_PF} + {_PB} AS packets FROM v_eve_flow
 WHERE {_PF} + {_PB} >= 100""")


@query("max_records_limit")
def _(spark, sf):
    f = R.max_records_limit(_features(spark, sf), 100)
    return f.select("flow_id", F.round(named("Flow Bytes/s"), 6).alias("bytes_per_s"))


oracle("max_records_limit", V, """SELECT flow_id, round("Flow Bytes/s", 6) AS bytes_per_s FROM feats
 ORDER BY ts, flow_id LIMIT 100""", features_cte())


@query("extraction_stats")
def _(spark, sf):
    return R.extraction_stats(views.eve_flow(spark, sf), 30)


oracle("extraction_stats", V, f"""SELECT count(*) AS total_processed, count(*) FILTER (ok) AS successful,
 count(*) FILTER (NOT ok) AS skipped_no_packets, CAST(0 AS BIGINT) AS skipped_parse_error,
 count(*) FILTER (ok AND good) AS quality_full, count(*) FILTER (ok AND NOT good) AS quality_partial,
 CAST(0 AS BIGINT) AS quality_degraded,
 printf('%.1f%%', round_even(100.0 * count(*) FILTER (ok) / greatest(count(*), 1), 1)) AS success_rate
 FROM (SELECT {_PF} + {_PB} >= 30 AS ok, {_PF} + {_PB} >= 5 AND {_DUR} > 0 AS good FROM v_eve_flow)""")


@query("feature_metadata_struct")
def _(spark, sf):
    f = R.feature_metadata_struct(_features(spark, sf))
    return f.select("metadata.flow_id", "metadata.src_ip", "metadata.dst_port", "metadata.quality",
                    "metadata.unavailable_count", F.size("features").alias("n"),
                    *[F.round(F.col("features")[i], 1).alias(f"f{i}") for i in (0, 5, 11, 20)])


oracle("feature_metadata_struct", V, """SELECT CAST(flow_id AS VARCHAR) AS flow_id, src_ip, dst_port, quality,
 9 AS unavailable_count, 25 AS n, round("Flow Duration", 1) AS f0, round("Fwd Packet Length Mean", 1) AS f5,
 round("Flow IAT Mean", 1) AS f11, round("Average Packet Size", 1) AS f20 FROM feats""", features_cte())


@query("feature_source_audit")
def _(spark, sf):
    f = R.feature_source_audit(_features(spark, sf))
    return f.select("source", "features", "nonzero_values", *rounded(["feature_share", "signal_share"]))


def _sum_nonzero(names):
    return " + ".join(f'count(*) FILTER ("{n}" <> 0)' for n in names)


oracle("feature_source_audit", V, " UNION ALL ".join(
    f"""SELECT '{source}' AS source, CAST({len(names)} AS BIGINT) AS features,
 CAST({_sum_nonzero(names)} AS BIGINT) AS nonzero_values, round({len(names)} / 25.0, 6) AS feature_share,
 round(({_sum_nonzero(names)}) / (count(*) * {len(names)}.0), 6) AS signal_share FROM feats"""
    for source, names in (("EXACT", K.EXACT_25), ("DERIVED", K.DERIVED_25), ("UNAVAILABLE", K.UNAVAILABLE_25))),
    features_cte())


@query("feature_subset")
def _(spark, sf):
    f = R.eve_features_78(views.eve_flow(spark, sf))
    vector = F.array(*[named(n).cast("double") for n in K.FEATURES_78])
    chosen = R.feature_subset(f.withColumn("_v", R.subset_vector(vector)), K.FEATURES_25, keep=["flow_id", "_v"])
    return chosen.select("flow_id", *[named(n).cast("double").alias(n) for n in K.FEATURES_25],
                         *[F.col("_v")[i].alias(f"at_{i}") for i in (0, 9, 24)])


def _float_78(name):
    return f"CAST(CAST({SQL_78.get(name, '0')} AS FLOAT) AS DOUBLE)"


oracle("feature_subset", V, "SELECT flow_id, " + ", ".join(
    f'{_float_78(n)} AS "{n}"' for n in K.FEATURES_25) + ", " + ", ".join(
    f"{_float_78(K.FEATURES_25[i])} AS at_{i}" for i in (0, 9, 24)) + " FROM v_eve_flow")

# --- scaled, scored, tiered -------------------------------------------------
_STATS = ", ".join(f'avg("{n}") AS "m_{n}", stddev_pop("{n}") AS "s_{n}"' for n in K.FEATURES_25)


def _z(n):
    return f'(("{n}" - "m_{n}") / CASE WHEN "s_{n}" > 0 THEN "s_{n}" ELSE 1 END)'


def scored_ctes(minimum=K.LIVE_MIN_PACKETS):
    return {
        **features_cte(minimum),
        "stats": f"SELECT {_STATS} FROM feats",
        "scored": "SELECT feats.*, (" + " + ".join(f"{_z(n)} * {_z(n)}" for n in K.FEATURES_25)
                  + ") / 25 AS score FROM feats, stats",
        "thr": "SELECT quantile_cont(score, 0.95) AS t FROM scored",
        "tiered": "SELECT scored.*, t, CASE WHEN score >= t * 2 THEN 'emergency' WHEN score > t THEN 'critical' "
                  "WHEN score >= t * 0.8 THEN 'warning' END AS severity FROM scored, thr",
    }


def _holds(rule):
    return " AND ".join(f"{k} = '{v}'" if isinstance(v, str) else f"{k} = {v}"
                        for k, v in rule.items() if k != "name")


ALLOW_SQL = "CASE " + " ".join(f"WHEN {_holds(r)} THEN '{r['name']}'" for r in views.ALLOW_RULES) + " END"


def scored_flows(spark, sf):
    """Features, score, anomaly flag, severity; model and threshold are fitted on the same table.

    Fitting reads the features three times, so their join is written out once.
    """
    features = cut_lineage(_features(spark, sf))
    model = fit_anomaly_model(features)
    return score_flows(features, model), model


@query("anomaly_score")
def _(spark, sf):
    scored, _m = scored_flows(spark, sf)
    return scored.select("flow_id", F.round("score", 6).alias("score"))


oracle("anomaly_score", V, "SELECT flow_id, round(score, 6) AS score FROM scored", scored_ctes())


@query("anomaly_threshold")
def _(spark, sf):
    scored, model = scored_flows(spark, sf)
    return scored.agg(F.count("*").alias("rows"), F.count_if(F.col("score") > model.threshold).alias("above")) \
        .withColumn("threshold", F.round(F.lit(model.threshold), 6))


oracle("anomaly_threshold", V, """SELECT count(*) AS rows, count(*) FILTER (score > t) AS above,
 round(max(t), 6) AS threshold FROM scored, thr""", scored_ctes())


@query("severity_tier")
def _(spark, sf):
    scored, _m = scored_flows(spark, sf)
    return scored.select("flow_id", "severity")


oracle("severity_tier", V, "SELECT flow_id, severity FROM tiered", scored_ctes())


@query("allowlist_match")
def _(spark, sf):
    return routing.allowlist_match(views.eve_flow(spark, sf), views.ALLOW_RULES).select("flow_id", "allow_rule")


oracle("allowlist_match", V, f"SELECT flow_id, {ALLOW_SQL} AS allow_rule FROM v_eve_flow")


@query("allowlist_match_table")
def _(spark, sf):
    rules = routing.rule_table(spark, views.ALLOW_RULES)
    return routing.allowlist_match(views.eve_flow(spark, sf), rules).select("flow_id", "allow_rule")


oracle("allowlist_match_table", V, f"SELECT flow_id, {ALLOW_SQL} AS allow_rule FROM v_eve_flow")


# every third flow gives a rule, in five shapes, and one in a thousand is a rule that names nothing known
_DERIVED = {"src_ip": "flow_id % 5 <> 1", "dst_ip": "flow_id % 5 IN (0, 1)", "src_port": "flow_id % 5 = 2", "dst_port": "flow_id % 5 IN (1, 3)",
            "proto": "flow_id % 5 = 4 AND flow_id % 2 = 0"}


@query("allowlist_match_derived")
def _(spark, sf):
    flows = views.eve_flow(spark, sf)
    rules = flows.where("flow_id % 3 = 0").select(
        F.col("flow_id").cast("int").alias("ord"), F.concat(F.lit("rule "), "flow_id").alias("name"),
        *[F.expr(f"CASE WHEN {there} THEN {k} END").alias(k) for k, there in _DERIVED.items()])
    asked = flows.withColumn("src_ip", F.expr("CASE WHEN flow_id % 11 <> 0 THEN src_ip END"))
    return routing.allowlist_match(asked, rules.where("ord % 4 <> 0 OR src_port IS NOT NULL")).select("flow_id", "allow_rule")


oracle("allowlist_match_derived", V, f"""SELECT flow_id, 'rule ' || (SELECT min(o) FROM ({" UNION ALL ".join(
    f"SELECT o FROM best b WHERE s = {s}" + "".join(f" AND b.{k} = f.{k}" for i, k in enumerate(_DERIVED) if s >> i & 1) for s in range(32))}))
 AS allow_rule FROM flows f""", {
    "flows": "SELECT * REPLACE (CASE WHEN flow_id % 11 <> 0 THEN src_ip END AS src_ip) FROM v_eve_flow",
    "rules": "SELECT flow_id AS o, " + ", ".join(f"CASE WHEN {there} THEN {k} END AS {k}" for k, there in _DERIVED.items())
             + " FROM v_eve_flow WHERE flow_id % 3 = 0",
    "best": "SELECT " + ", ".join(_DERIVED) + ", min(o) AS o, " + " + ".join(
        f"CASE WHEN {k} IS NULL THEN 0 ELSE {1 << i} END" for i, k in enumerate(_DERIVED))
            + " AS s FROM rules WHERE o % 4 <> 0 OR src_port IS NOT NULL GROUP BY " + ", ".join(_DERIVED)})


@query("allowlist_exclude")
def _(spark, sf):
    return routing.allowlist_exclude(views.eve_flow(spark, sf), views.ALLOW_RULES).select("flow_id", "dst_ip")


oracle("allowlist_exclude", V, f"SELECT flow_id, dst_ip FROM v_eve_flow WHERE ({ALLOW_SQL}) IS NULL")


def _raised(spark, sf):
    scored, model = scored_flows(spark, sf)
    raised = routing.allowlist_exclude(scored, views.ALLOW_RULES).where(F.col("severity").isin("critical", "emergency"))
    return raised, model


def payload_ctes():
    return {**scored_ctes(), "payload": f"""SELECT severity, round_even(score, 6) AS score, round_even(t, 6) AS threshold,
 round_even(score / t, 2) AS ratio, src_ip, src_port, dst_ip, dst_port, proto, CAST(flow_id AS VARCHAR) AS flow_id,
 ts AS timestamp, round_even("Flow Duration" / 1e6, 3) AS duration_s, "Total Length of Fwd Packets" AS fwd_bytes,
 "Total Length of Bwd Packets" AS bwd_bytes, "Total Fwd Packets" AS fwd_pkts, "Total Backward Packets" AS bwd_pkts
 FROM tiered WHERE severity IN ('critical', 'emergency') AND ({ALLOW_SQL}) IS NULL"""}


@query("alert_payload")
def _(spark, sf):
    raised, model = _raised(spark, sf)
    return routing.alert_payload(raised, model.threshold)


oracle("alert_payload", V, "SELECT * FROM payload", payload_ctes())


@query("alert_payload_loki")
def _(spark, sf):
    raised, model = _raised(spark, sf)
    pushed = routing.alert_payload_loki(routing.alert_payload(raised, model.threshold))
    part = {"job": "$.streams[0].stream.job", "severity": "$.streams[0].stream.severity",
            "src_ip": "$.streams[0].stream.src_ip", "nanos": "$.streams[0].values[0][0]"}
    line = F.get_json_object("payload", "$.streams[0].values[0][1]")
    return pushed.select("flow_id", *[F.get_json_object("payload", p).alias(n) for n, p in part.items()],
                         F.get_json_object(line, "$.dst_port").cast("int").alias("dst_port"),
                         F.get_json_object(line, "$.ratio").cast("double").alias("ratio"))


oracle("alert_payload_loki", V, """SELECT flow_id, 'flow-anomaly' AS job, severity, src_ip,
 CAST(epoch_us(timestamp) * 1000 AS VARCHAR) AS nanos, dst_port, ratio FROM payload""", payload_ctes())


@query("alert_syslog_line")
def _(spark, sf):
    raised, model = _raised(spark, sf)
    lines = routing.alert_syslog_line(routing.alert_payload(raised, model.threshold))
    numbers = r" score=\S+ threshold=\S+ "
    score = F.regexp_extract("line", r" score=(\S+) ", 1).cast("double")
    return lines.select("flow_id", F.regexp_replace("line", numbers, " ").alias("line"), score.alias("score"))


oracle("alert_syslog_line", V, """SELECT flow_id, '<134>flow-anomaly: severity=' || severity || ' src=' || src_ip
 || ':' || src_port || ' dst=' || dst_ip || ':' || dst_port || ' proto=' || proto
 || ' fwd_bytes=' || CAST(fwd_bytes AS BIGINT) || ' bwd_bytes=' || CAST(bwd_bytes AS BIGINT) AS line, score
 FROM payload""", payload_ctes())

DAY = 86_400


@query("alert_cooldown")
def _(spark, sf):
    flows = views.eve_flow(spark, sf).select("flow_id", "ts", "src_ip", F.col("proto").alias("dst_ip"))
    return routing.alert_cooldown(flows, 30 * DAY).select(
        "flow_id", F.col("admitted").cast("int").alias("admitted"))


oracle("alert_cooldown", V, """SELECT flow_id, CASE WHEN flow_id = f AND c.t0 IS NOT NULL THEN 1 ELSE 0 END AS admitted
 FROM ev LEFT JOIN chain c ON c.src_ip = ev.src_ip AND c.proto = ev.proto AND c.t0 = ev.t0
 JOIN (SELECT src_ip, proto, t0, min(flow_id) AS f FROM ev GROUP BY ALL) m
 ON m.src_ip = ev.src_ip AND m.proto = ev.proto AND m.t0 = ev.t0""", {
    "ev": "SELECT flow_id, src_ip, proto, epoch_us(ts) AS t0 FROM v_eve_flow",
    "chain": f"""SELECT src_ip, proto, min(t0) AS t0 FROM ev GROUP BY 1, 2 UNION ALL
 SELECT c.src_ip, c.proto, min(e.t0) AS t0 FROM chain c JOIN ev e ON e.src_ip = c.src_ip AND e.proto = c.proto
 AND e.t0 >= c.t0 + {30 * DAY}::BIGINT * 1000000 GROUP BY c.src_ip, c.proto, c.t0"""}, recursive=True)


@query("suppression_stats")
def _(spark, sf):
    scored, _m = scored_flows(spark, sf)
    routed = alert_flows(scored, views.ALLOW_RULES, cooldown_s=30 * DAY)
    return routing.suppression_stats(routed)


oracle("suppression_stats", V, """SELECT count(*) AS flows_read,
 count(*) FILTER (severity = 'warning' AND rule IS NULL) AS alerts_warning,
 count(*) FILTER (severity = 'critical' AND rule IS NULL AND adm) AS alerts_critical,
 count(*) FILTER (severity = 'emergency' AND rule IS NULL AND adm) AS alerts_emergency,
 count(*) FILTER (severity IN ('critical', 'emergency') AND rule IS NULL AND NOT adm) AS alerts_suppressed,
 count(*) FILTER (rule IS NOT NULL) AS allowlisted,
 round_even(count(*) / greatest((max(t0) - min(t0)) / 1e6, 1), 2) AS flows_per_sec
 FROM (SELECT r.*, flow_id IN (SELECT flow_id FROM firsts) AS adm FROM routed r)""", {
    **scored_ctes(),
    "routed": f"SELECT flow_id, severity, src_ip, dst_ip, epoch_us(ts) AS t0, {ALLOW_SQL} AS rule FROM tiered",
    "ev": "SELECT * FROM routed WHERE rule IS NULL AND severity IN ('critical', 'emergency')",
    "chain": f"""SELECT src_ip, dst_ip, min(t0) AS t0 FROM ev GROUP BY 1, 2 UNION ALL
 SELECT c.src_ip, c.dst_ip, min(e.t0) AS t0 FROM chain c JOIN ev e ON e.src_ip = c.src_ip AND e.dst_ip = c.dst_ip
 AND e.t0 >= c.t0 + {30 * DAY}::BIGINT * 1000000 GROUP BY c.src_ip, c.dst_ip, c.t0""",
    "firsts": """SELECT min(flow_id) AS flow_id FROM ev JOIN chain USING (src_ip, dst_ip, t0)
 GROUP BY src_ip, dst_ip, t0"""}, recursive=True)


@query("flow_alert_summary")
def flow_alert_summary(spark, sf):
    """The flagship path: records to features, score, allowlist, tier; alerts per severity."""
    scored, _m = scored_flows(spark, sf)
    kept = routing.allowlist_exclude(scored, views.ALLOW_RULES).where(F.col("severity").isNotNull())
    return kept.groupBy("severity").agg(
        F.count("*").alias("alerts"), F.countDistinct("src_ip").alias("sources"),
        F.sum(named("Total Length of Fwd Packets")).cast("long").alias("bytes_out"),
        F.round(F.max("score"), 6).alias("top_score"))


oracle("flow_alert_summary", V, f"""SELECT severity, count(*) AS alerts, count(DISTINCT src_ip) AS sources,
 CAST(sum("Total Length of Fwd Packets") AS BIGINT) AS bytes_out, round(max(score), 6) AS top_score
 FROM tiered WHERE severity IS NOT NULL AND ({ALLOW_SQL}) IS NULL GROUP BY severity""", scored_ctes())
