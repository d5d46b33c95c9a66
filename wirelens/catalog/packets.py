"""Packets to flows."""

from pyspark.sql import functions as F

from wirelens import constants as K
from wirelens.catalog.registry import oracle, query
from wirelens.functions.numeric import named
from wirelens.operators import packets as P
from wirelens.sources import views

V = ["v_packets"]
IDLE_S = 6 * 3600
ACTIVE_S = 3 * 86_400
KEY = ", ".join(P.KEY)

KEYED = """SELECT pkt_id, epoch_us(ts) AS us, size, CASE WHEN proto = 6 THEN flags ELSE 0 END AS flags,
 CASE WHEN src <= dst THEN src ELSE dst END AS ip_a, CASE WHEN src <= dst THEN dst ELSE src END AS ip_b,
 CASE WHEN src <= dst THEN sport ELSE dport END AS port_a, CASE WHEN src <= dst THEN dport ELSE sport END AS port_b,
 proto, CASE WHEN src <= dst THEN 0 ELSE 1 END AS direction FROM v_packets"""
MARKED = f"""SELECT *, sum(opens) OVER (PARTITION BY {KEY} ORDER BY us, pkt_id) AS sess FROM (
 SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY {KEY} ORDER BY us, pkt_id) <= {IDLE_S}::BIGINT * 1000000
 THEN 0 ELSE 1 END AS opens FROM keyed)"""
SESSIONS = f"SELECT *, min(us) OVER (PARTITION BY {KEY}, sess) AS start_us FROM marked"
GAPS = f"""SELECT *, coalesce(us - lag(us) OVER (PARTITION BY {KEY}, start_us ORDER BY us, pkt_id), 0) AS gap,
 us - lag(us) OVER (PARTITION BY {KEY}, start_us, direction ORDER BY us, pkt_id) AS side_gap FROM sessions"""
BASE = {"keyed": KEYED, "marked": MARKED, "sessions": SESSIONS}


def _start():
    return F.col("start_us")


@query("packet_flow_key")
def _(spark, sf):
    return P.packet_flow_key(views.packets(spark, sf))


oracle("packet_flow_key", V, "SELECT * FROM keyed", {"keyed": KEYED})


@query("flow_sessions_idle")
def _(spark, sf):
    return P.flow_sessions_idle(views.packets(spark, sf), IDLE_S)


oracle("flow_sessions_idle", V, f"""SELECT {KEY}, start_us, max(us) AS end_us, count(*) AS packets
 FROM sessions GROUP BY ALL""", BASE)


@query("flow_sessions_active")
def _(spark, sf):
    flows = P.flow_direction_totals(views.packets(spark, sf), IDLE_S * 4, ACTIVE_S)
    return flows.select(*P.KEY, "start_us", "end_us", (F.col("fwd_pkts") + F.col("bwd_pkts")).alias("packets"))


_SESSION = f"{KEY}, sess"
AGED = {
    "keyed": KEYED, "marked": MARKED.replace(f"{IDLE_S}::BIGINT", f"{IDLE_S * 4}::BIGINT"),
    "chain": f"""SELECT {_SESSION}, min(us) AS t0 FROM marked GROUP BY ALL UNION ALL
 SELECT {_SESSION}, min(us) AS t0 FROM chain JOIN marked USING ({_SESSION})
 WHERE us > t0 + {ACTIVE_S}::BIGINT * 1000000 GROUP BY {_SESSION}, t0""",
    "aged": f"""SELECT {KEY}, start_us, max(us) AS end_us, count(*) AS packets FROM (
 SELECT s.* EXCLUDE (sess), max(c.t0) AS start_us FROM marked s JOIN chain c USING ({_SESSION}) WHERE c.t0 <= s.us GROUP BY ALL)
 GROUP BY {KEY}, start_us"""}
oracle("flow_sessions_active", V, "SELECT * FROM aged", AGED, recursive=True)


@query("flow_direction_totals")
def _(spark, sf):
    return P.flow_direction_totals(views.packets(spark, sf), IDLE_S, None)


_TOTALS = """max(us) AS end_us, count(*) FILTER (direction = 0) AS fwd_pkts,
 CAST(coalesce(sum(size) FILTER (direction = 0), 0) AS BIGINT) AS fwd_bytes,
 count(*) FILTER (direction = 1) AS bwd_pkts, CAST(coalesce(sum(size) FILTER (direction = 1), 0) AS BIGINT) AS bwd_bytes"""
oracle("flow_direction_totals", V, f"""SELECT {KEY}, start_us, {_TOTALS}, max(us) - start_us AS duration_us
 FROM sessions GROUP BY {KEY}, start_us""", BASE)


def _spread_sql(value, prefix, where="true", unit=1):
    stats = {"max": "max", "min": "min", "mean": "avg", "std": "stddev_pop"}
    return ", ".join(f"coalesce({fn}({value} / {unit}) FILTER ({where}), 0) AS {prefix}_{stat}"
                     for stat, fn in stats.items())


_LENGTHS = ", ".join([_spread_sql("size", "len"), _spread_sql("size", "len_fwd", "direction = 0"),
                      _spread_sql("size", "len_bwd", "direction = 1")])
_LEN_NAMES = [f"{p}_{s}" for p in ("len", "len_fwd", "len_bwd") for s in ("max", "min", "mean", "std")]
LENGTH_CTE = {"lens": f"SELECT {KEY}, start_us, {_LENGTHS} FROM sessions GROUP BY {KEY}, start_us"}


@query("flow_pkt_len_stats")
def _(spark, sf):
    flows = P.flow_pkt_len_stats(views.packets(spark, sf), IDLE_S, None)
    return flows.select(*P.KEY, "start_us", *[F.round(n, 6).alias(n) for n in [*_LEN_NAMES, "len_var"]])


oracle("flow_pkt_len_stats", V, f"SELECT {KEY}, start_us, " + ", ".join(
    f"round({n}, 6) AS {n}" for n in _LEN_NAMES) + ", round(len_std * len_std, 6) AS len_var FROM lens",
    {**BASE, **LENGTH_CTE})

_IAT_NAMES = [f"{p}_{s}" for p in ("iat", "iat_fwd", "iat_bwd") for s in ("max", "min", "mean", "std", "total")]
_IATS = ", ".join([_spread_sql("gap", "iat"), "CAST(coalesce(sum(gap), 0) AS DOUBLE) AS iat_total"] + [
    part for side, d in (("iat_fwd", 0), ("iat_bwd", 1))
    for part in (_spread_sql("side_gap", side, f"direction = {d}"),
                 f"CAST(coalesce(sum(side_gap) FILTER (direction = {d}), 0) AS DOUBLE) AS {side}_total")])
IAT_CTE = {"gaps": GAPS, "iats": f"SELECT {KEY}, start_us, {_IATS} FROM gaps GROUP BY {KEY}, start_us"}


@query("flow_iat_stats")
def _(spark, sf):
    flows = P.flow_iat_stats(views.packets(spark, sf), IDLE_S, None)
    return flows.select(*P.KEY, "start_us", *[F.round(n, 1).alias(n) for n in _IAT_NAMES])


oracle("flow_iat_stats", V, f"SELECT {KEY}, start_us, " + ", ".join(
    f"round({n}, 1) AS {n}" for n in _IAT_NAMES) + " FROM iats", {**BASE, **IAT_CTE})

_FLAGS = ", ".join(f'count(*) FILTER (flags & {bit} <> 0) AS "{name}"' for name, bit in K.TCP_FLAG_BITS.items())
_SIDE_FLAGS = ", ".join(
    f"""CASE WHEN count(*) FILTER (direction = {d}) > 0 THEN count(*) FILTER (flags & {bit} <> 0) ELSE 0 END
 AS "{label} {flag} Flags\"""" for flag, bit in (("PSH", 8), ("URG", 32)) for label, d in (("Fwd", 0), ("Bwd", 1)))


@query("flow_tcp_flags")
def _(spark, sf):
    return P.flow_tcp_flags(views.packets(spark, sf), IDLE_S, None)


oracle("flow_tcp_flags", V, f"""SELECT {KEY}, start_us, {_FLAGS}, {_SIDE_FLAGS} FROM sessions
 GROUP BY {KEY}, start_us""", BASE)

_RATES = {
    "Flow Bytes/s": "(fwd_bytes + bwd_bytes) / secs", "Flow Packets/s": "(fwd_pkts + bwd_pkts) / secs",
    "Fwd Packets/s": "fwd_pkts / secs", "Bwd Packets/s": "bwd_pkts / secs",
    "Down/Up Ratio": "CASE WHEN fwd_pkts > 0 THEN bwd_pkts / fwd_pkts ELSE 0 END",
}
TOTALS_CTE = {"totals": f"""SELECT *, CASE WHEN end_us > start_us THEN (end_us - start_us) / 1e6 ELSE 1e-6 END AS secs
 FROM (SELECT {KEY}, start_us, {_TOTALS} FROM sessions GROUP BY {KEY}, start_us)"""}


@query("flow_rates")
def _(spark, sf):
    flows = P.flow_rates(views.packets(spark, sf), IDLE_S, None)
    return flows.select(*P.KEY, "start_us", *[F.round(named(n), 6).alias(n) for n in _RATES])


oracle("flow_rates", V, f"SELECT {KEY}, start_us, " + ", ".join(
    f'round({e}, 6) AS "{n}"' for n, e in _RATES.items()) + " FROM totals", {**BASE, **TOTALS_CTE})


def _features_sql():
    v = {"Destination Port": "port_b", "Flow Duration": "end_us - start_us", "Total Fwd Packets": "fwd_pkts",
         "Total Backward Packets": "bwd_pkts", "Total Length of Fwd Packets": "fwd_bytes",
         "Total Length of Bwd Packets": "bwd_bytes", "Min Packet Length": "len_min", "Max Packet Length": "len_max",
         "Packet Length Mean": "len_mean", "Packet Length Std": "len_std",
         "Packet Length Variance": "len_std * len_std", "Average Packet Size": "len_mean",
         "Avg Fwd Segment Size": "len_fwd_mean", "Avg Bwd Segment Size": "len_bwd_mean",
         "Subflow Fwd Packets": "fwd_pkts", "Subflow Fwd Bytes": "fwd_bytes", "Subflow Bwd Packets": "bwd_pkts",
         "Subflow Bwd Bytes": "bwd_bytes", "act_data_pkt_fwd": "fwd_pkts", "min_seg_size_forward": "len_fwd_min",
         **_RATES}
    for side in ("Fwd", "Bwd"):
        for stat in ("Max", "Min", "Mean", "Std"):
            v[f"{side} Packet Length {stat}"] = f"len_{side.lower()}_{stat.lower()}"
        for stat in ("Total", "Mean", "Std", "Max", "Min"):
            v[f"{side} IAT {stat}"] = f"iat_{side.lower()}_{stat.lower()}"
        for flag in ("PSH", "URG"):
            v[f"{side} {flag} Flags"] = f'"{side} {flag} Flags"'
    for stat in ("Mean", "Std", "Max", "Min"):
        v[f"Flow IAT {stat}"] = f"iat_{stat.lower()}"
    for name in K.TCP_FLAG_BITS:
        v[name] = f'"{name}"'
    return v



_MICROS = [n for n in K.FEATURES_78 if "IAT" in n]


@query("flow_features_78")
def _(spark, sf):
    flows = P.flow_features_78(views.packets(spark, sf), IDLE_S, None)
    return flows.select(*P.KEY, "start_us", *[
        F.round(named(n), 1 if n in _MICROS else 6).alias(n) for n in K.FEATURES_78])


_SQL_78 = _features_sql()
oracle("flow_features_78", V, f"SELECT {KEY}, start_us, " + ", ".join(
    f'round(CAST({_SQL_78.get(n, "0")} AS DOUBLE), {1 if n in _MICROS else 6}) AS "{n}"'
    for n in K.FEATURES_78) + f" FROM totals JOIN lens USING ({KEY}, start_us) JOIN iats USING ({KEY}, start_us)"
    f" JOIN flagged USING ({KEY}, start_us)",
    {**BASE, **TOTALS_CTE, **LENGTH_CTE, **IAT_CTE,
     "flagged": f"SELECT {KEY}, start_us, {_FLAGS}, {_SIDE_FLAGS} FROM sessions GROUP BY {KEY}, start_us"})
