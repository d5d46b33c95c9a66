"""Explicit read schemas: no file is ever scanned to infer its columns."""

from pyspark.sql import types as T

_str, _int, _long, _dbl = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _struct(**fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


EVE = T.StructType(
    _struct(
        timestamp=_str, event_type=_str, flow_id=_str, src_ip=_str, src_port=_int, dest_ip=_str,
        dest_port=_int, proto=_str, community_id=_str,
    ).fields
    + [
        T.StructField("flow", _struct(
            pkts_toserver=_long, pkts_toclient=_long, bytes_toserver=_long, bytes_toclient=_long,
            start=_str, end=_str, age=_long)),
        T.StructField("alert", _struct(
            severity=_int, signature=_str, signature_id=_long, category=_str, rev=_int)),
        T.StructField("_corrupt_record", _str),
    ]
)

HIDS_ALERT = T.StructType([
    T.StructField("id", _str),
    T.StructField("timestamp", _str),
    T.StructField("rule", T.StructType([
        T.StructField("level", _int), T.StructField("id", _str), T.StructField("description", _str),
        T.StructField("groups", T.ArrayType(_str))])),
    T.StructField("agent", _struct(name=_str)),
    T.StructField("full_log", _str),
    T.StructField("data", T.MapType(_str, _str)),
    T.StructField("_corrupt_record", _str),
])

COMPACT_ALERT = T.StructType([
    T.StructField("ts", _str), T.StructField("level", _int), T.StructField("rule_id", _str),
    T.StructField("description", _str), T.StructField("groups", T.ArrayType(_str)),
    T.StructField("agent", _str), T.StructField("full_log", _str),
    T.StructField("srcip", _str), T.StructField("dstip", _str), T.StructField("srcport", _str),
    T.StructField("dstport", _str), T.StructField("title", _str), T.StructField("file", _str),
    T.StructField("command", _str), T.StructField("uid", _str), T.StructField("user", _str),
])

TRIAGE_VERDICT = T.StructType([
    T.StructField("severity", _str), T.StructField("action", _str), T.StructField("reason", _str),
    T.StructField("classifier", _str), T.StructField("lesson_id", _str),
    T.StructField("fallback", T.BooleanType()), T.StructField("coherence_corrected", T.BooleanType()),
])

QUEUE = T.StructType([
    T.StructField("alert_id", _str), T.StructField("alert", COMPACT_ALERT),
    T.StructField("triage", TRIAGE_VERDICT), T.StructField("queued_at", _str),
    T.StructField("_corrupt_record", _str),
])

LESSON = T.StructType([
    T.StructField("lesson_id", _str), T.StructField("status", _str), T.StructField("source", _str),
    T.StructField("promotion_count", _long), T.StructField("promotion_threshold", _long),
    T.StructField("pattern", T.StructType([
        T.StructField("rule_id", _str), T.StructField("agent", _str),
        T.StructField("log_keywords", T.ArrayType(_str))])),
    T.StructField("classification", _struct(severity=_str, action=_str, reason=_str)),
    T.StructField("created_at", _str), T.StructField("last_seen_at", _str),
    T.StructField("last_promoted_at", _str), T.StructField("hits", _long), T.StructField("ord", _long),
    T.StructField("_corrupt_record", _str),
])

PACKET = T.StructType([
    T.StructField("pkt_id", _long), T.StructField("ts", T.TimestampType()), T.StructField("src", _str),
    T.StructField("dst", _str), T.StructField("sport", _int), T.StructField("dport", _int),
    T.StructField("proto", _int), T.StructField("size", _int), T.StructField("flags", _int),
])

ALLOWLIST_RULE = _struct(name=_str, src_ip=_str, dst_ip=_str, src_port=_int, dst_port=_int, proto=_str)
