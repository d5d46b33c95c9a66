"""Packets to flows: canonical keys, sessions and the 78 packet-level features."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens import constants as K
from wirelens.functions.numeric import named, safe_div
from wirelens.functions.time import micros
from wirelens.operators.skew import greedy_starts

KEY = ["ip_a", "ip_b", "port_a", "port_b", "proto"]
FORWARD, BACKWARD = 0, 1
TCP, UDP = 6, 17


def packet_flow_key(packets: DataFrame, keep=()) -> DataFrame:
    """Bidirectional key: the string-smaller address is side a; direction 0 runs from a to b.
    Packets that are not IP (no addresses or protocol) are dropped, so key columns are never null."""
    has_ports = F.col("proto").isin(TCP, UDP)
    sport = F.coalesce(F.when(has_ports, F.col("sport")), F.lit(0))
    dport = F.coalesce(F.when(has_ports, F.col("dport")), F.lit(0))
    forward = F.col("src") <= F.col("dst")
    return packets.dropna(subset=["src", "dst", "proto"]).select(
        "pkt_id", micros(F.col("ts")).alias("us"), "size",
        F.when(F.col("proto") == TCP, F.col("flags")).otherwise(0).alias("flags"),
        F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("ip_a"),
        F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("ip_b"),
        F.when(forward, sport).otherwise(dport).alias("port_a"),
        F.when(forward, dport).otherwise(sport).alias("port_b"),
        "proto",
        F.when(forward, FORWARD).otherwise(BACKWARD).alias("direction"), *keep,
    )


def _buckets(keyed: DataFrame, idle_us: int, width_us: int) -> DataFrame:
    """One row per (flow key, time bucket) with the session the bucket belongs to.

    A bucket is no wider than the idle limit, so no session can end inside it: the small
    bucket table alone decides where sessions start, whatever the number of packets.
    """
    summary = keyed.groupBy(*KEY, "bucket").agg(
        F.count("*").alias("packets"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.max(F.when(F.col("direction") == FORWARD, F.col("us"))).alias("last_fwd_us"),
        F.max(F.when(F.col("direction") == BACKWARD, F.col("us"))).alias("last_bwd_us"))
    timeline = Window.partitionBy(*KEY).orderBy("bucket")
    before = timeline.rowsBetween(Window.unboundedPreceding, -1)
    silence = F.col("first_us") - F.lag("last_us").over(timeline)
    opens = silence.isNull() | (silence > idle_us)
    return summary.select(
        *KEY, "bucket", "packets", "first_us", "last_us",
        F.last(F.when(opens, F.col("first_us")), ignorenulls=True).over(timeline).alias("session_us"),
        F.lag("last_us").over(timeline).alias("prior_us"),
        F.last("last_fwd_us", ignorenulls=True).over(before).alias("prior_fwd_us"),
        F.last("last_bwd_us", ignorenulls=True).over(before).alias("prior_bwd_us"),
    )


def _bucketed(packets: DataFrame, width_us: int) -> DataFrame:
    keyed = packet_flow_key(packets)
    return keyed.withColumn("bucket", F.floor(F.col("us") / width_us).cast("long"))


def _limits(idle_s, active_s):
    idle_us = int(idle_s * 1_000_000)
    active_us = int(active_s * 1_000_000) if active_s else None
    return idle_us, active_us, min(idle_us, active_us or idle_us)


def flow_sessions_idle(packets: DataFrame, idle_s: float = K.IDLE_TIMEOUT_S) -> DataFrame:
    """Sessions closed by silence longer than ``idle_s``; built from the bucket table only."""
    idle_us, _, width = _limits(idle_s, None)
    buckets = _buckets(_bucketed(packets, width), idle_us, width)
    return buckets.groupBy(*KEY, F.col("session_us").alias("start_us")).agg(
        F.max("last_us").alias("end_us"), F.sum("packets").alias("packets"))


def assign_flows(packets: DataFrame, idle_s: float = K.IDLE_TIMEOUT_S,
                 active_s: float | None = K.ACTIVE_TIMEOUT_S) -> DataFrame:
    """Packets with the start of their flow (``start_us``) and the previous packet times the
    flow carries into their bucket.  ``active_s`` also restarts a flow that grew older than it."""
    idle_us, active_us, width = _limits(idle_s, active_s)
    keyed = _bucketed(packets, width)
    buckets = _buckets(keyed, idle_us, width)
    if active_us is not None:
        buckets = _split_by_age(keyed, buckets, active_us, width)
    else:
        buckets = buckets.withColumn("restart_us", F.lit(None).cast("long")) \
                         .withColumn("open_us", F.col("session_us"))
    own = (F.col("restart_us").isNotNull() & (F.col("us") >= F.col("restart_us")))
    carried = buckets.drop("packets", "first_us", "last_us", "session_us")
    return (keyed.join(carried, [*KEY, "bucket"])
            .withColumn("start_us", F.when(own, F.col("restart_us")).otherwise(F.col("open_us")))
            .drop("restart_us", "open_us"))


def _split_by_age(keyed: DataFrame, buckets: DataFrame, active_us: int, width: int) -> DataFrame:
    """Add to each bucket the restart inside it, if any, and the flow open on entry.

    Restarts lie more than the active limit apart and buckets are no wider, so a bucket
    holds one restart at most.  Only packets of sessions older than the limit are followed.
    """
    session = [*KEY, "session_us"]
    whole = Window.partitionBy(*session)
    long_lived = buckets.withColumn("_end", F.max("last_us").over(whole)) \
        .where(F.col("_end") - F.col("session_us") > active_us).select(*KEY, "bucket", "session_us")
    events = keyed.select(*KEY, "bucket", "us").join(long_lived, [*KEY, "bucket"])
    starts = greedy_starts(events, session, "us", active_us, strict=True)
    restarts = (starts.where(F.col("us") > F.col("session_us"))
                .select(*session, F.floor(F.col("us") / width).cast("long").alias("bucket"),
                        F.col("us").alias("restart_us")))
    joined = buckets.join(restarts, [*session, "bucket"], "left")
    earlier = (Window.partitionBy(*session).orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    return joined.withColumn(
        "open_us", F.coalesce(F.last("restart_us", ignorenulls=True).over(earlier), F.col("session_us")))


def with_gaps(assigned: DataFrame, leading_zero_gap: bool = True) -> DataFrame:
    """Inter-arrival gaps in microseconds inside a flow: over all packets and per direction.

    The sort runs per (key, bucket); the first packet of a bucket takes its predecessor from
    the bucket table.  ``leading_zero_gap`` counts the first packet as a gap of 0 in the
    all-packets series (its time enters that series twice), never in the directional ones.
    """
    order = Window.partitionBy(*KEY, "bucket").orderBy("us", "pkt_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)

    def previous(direction, carried):
        mine = F.when(F.col("direction") == direction, F.col("us"))
        return F.coalesce(F.last(mine, ignorenulls=True).over(before), F.col(carried))

    def gap(prev: Column) -> Column:
        return F.when(F.col(prev) >= F.col("start_us"), F.col("us") - F.col(prev))

    return (
        assigned
        .withColumns({
            "_prev": F.coalesce(F.lag("us").over(order), F.col("prior_us")),
            "_prev_fwd": previous(FORWARD, "prior_fwd_us"),
            "_prev_bwd": previous(BACKWARD, "prior_bwd_us")})
        .withColumns({
            "gap": F.coalesce(gap("_prev"), F.lit(0)) if leading_zero_gap else gap("_prev"),
            "gap_fwd": F.when(F.col("direction") == FORWARD, gap("_prev_fwd")),
            "gap_bwd": F.when(F.col("direction") == BACKWARD, gap("_prev_bwd"))})
        .drop("_prev", "_prev_fwd", "_prev_bwd", "prior_us", "prior_fwd_us", "prior_bwd_us")
    )


def _spread(value: Column, prefix: str) -> list[Column]:
    zero = F.lit(0.0)
    return [
        F.coalesce(F.max(value).cast("double"), zero).alias(prefix + "_max"),
        F.coalesce(F.min(value).cast("double"), zero).alias(prefix + "_min"),
        F.coalesce(F.avg(value), zero).alias(prefix + "_mean"),
        F.coalesce(F.stddev_pop(value), zero).alias(prefix + "_std"),
    ]


_SIDES = {"fwd": FORWARD, "bwd": BACKWARD}


def _side(direction: int, value: Column) -> Column:
    return F.when(F.col("direction") == direction, value)


def direction_totals() -> list[Column]:
    sums = []
    for name, direction in _SIDES.items():
        sums.append(F.count(_side(direction, F.lit(1))).alias(f"{name}_pkts"))
        sums.append(F.coalesce(F.sum(_side(direction, F.col("size"))), F.lit(0)).cast("long").alias(f"{name}_bytes"))
    return [F.max("us").alias("end_us"), *sums]


def length_stats() -> list[Column]:
    size = F.col("size")
    return [*_spread(size, "len"), *_spread(_side(FORWARD, size), "len_fwd"),
            *_spread(_side(BACKWARD, size), "len_bwd")]


def iat_stats() -> list[Column]:
    series = {"iat": "gap", "iat_fwd": "gap_fwd", "iat_bwd": "gap_bwd"}
    out = []
    for prefix, column in series.items():
        out += _spread(F.col(column), prefix)
        out.append(F.coalesce(F.sum(column), F.lit(0)).cast("double").alias(prefix + "_total"))
    return out


def flag_counts() -> list[Column]:
    return [F.count(F.when(F.col("flags").bitwiseAND(bit) != 0, 1)).alias(name)
            for name, bit in K.TCP_FLAG_BITS.items()]


def aggregate_flows(packets_with_flow: DataFrame, *measures: list[Column]) -> DataFrame:
    """One row per flow.  Partial aggregation runs on the (key, bucket) partitions, so a flow
    that holds a third of all packets reaches the final step as one partial row per task."""
    return packets_with_flow.groupBy(*KEY, "start_us").agg(*[c for group in measures for c in group])


def duration_us() -> Column:
    return F.col("end_us") - F.col("start_us")


def flow_direction_totals(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S) -> DataFrame:
    flows = aggregate_flows(assign_flows(packets, idle_s, active_s), direction_totals())
    return flows.withColumn("duration_us", duration_us())


def flow_pkt_len_stats(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S) -> DataFrame:
    flows = aggregate_flows(assign_flows(packets, idle_s, active_s), length_stats())
    return flows.withColumn("len_var", F.col("len_std") * F.col("len_std"))


def flow_iat_stats(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S, leading_zero_gap=True):
    return aggregate_flows(with_gaps(assign_flows(packets, idle_s, active_s), leading_zero_gap), iat_stats())


def flow_tcp_flags(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S) -> DataFrame:
    """Flag totals of the flow; PSH and URG totals also stand for each side that sent packets."""
    flows = aggregate_flows(assign_flows(packets, idle_s, active_s), direction_totals(), flag_counts())
    return flows.select(*KEY, "start_us", *[named(n) for n in K.TCP_FLAG_BITS], *_side_flags())


def _side_flags() -> list[Column]:
    out = []
    for flag in ("PSH", "URG"):
        for label, side in (("Fwd", "fwd"), ("Bwd", "bwd")):
            value = F.when(F.col(f"{side}_pkts") > 0, named(f"{flag} Flag Count")).otherwise(0)
            out.append(value.alias(f"{label} {flag} Flags"))
    return out


def _rates() -> dict[str, Column]:
    seconds = F.when(duration_us() > 0, duration_us() / 1e6).otherwise(1e-6)
    return {
        "Flow Bytes/s": (F.col("fwd_bytes") + F.col("bwd_bytes")) / seconds,
        "Flow Packets/s": (F.col("fwd_pkts") + F.col("bwd_pkts")) / seconds,
        "Fwd Packets/s": F.col("fwd_pkts") / seconds,
        "Bwd Packets/s": F.col("bwd_pkts") / seconds,
        "Down/Up Ratio": safe_div(F.col("bwd_pkts"), F.col("fwd_pkts")),
    }


def flow_rates(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S) -> DataFrame:
    """Rates with the duration floored at one microsecond, and the down/up ratio."""
    flows = aggregate_flows(assign_flows(packets, idle_s, active_s), direction_totals())
    return flows.select(*KEY, "start_us", *[c.alias(n) for n, c in _rates().items()])


def flow_features_78(packets, idle_s=K.IDLE_TIMEOUT_S, active_s=K.ACTIVE_TIMEOUT_S,
                     leading_zero_gap=True) -> DataFrame:
    """The whole feature row per flow: one packet shuffle, one sort, one aggregation.

    Header lengths, bulk, window and active/idle groups need data a packet table lacks
    and stay 0.
    """
    gapped = with_gaps(assign_flows(packets, idle_s, active_s), leading_zero_gap)
    flows = aggregate_flows(gapped, direction_totals(), length_stats(), iat_stats(), flag_counts())
    values = {
        "Destination Port": F.col("port_b"), "Flow Duration": duration_us(),
        "Total Fwd Packets": F.col("fwd_pkts"), "Total Backward Packets": F.col("bwd_pkts"),
        "Total Length of Fwd Packets": F.col("fwd_bytes"), "Total Length of Bwd Packets": F.col("bwd_bytes"),
        "Min Packet Length": F.col("len_min"), "Max Packet Length": F.col("len_max"),
        "Packet Length Mean": F.col("len_mean"), "Packet Length Std": F.col("len_std"),
        "Packet Length Variance": F.col("len_std") * F.col("len_std"),
        "Average Packet Size": F.col("len_mean"),
        "Avg Fwd Segment Size": F.col("len_fwd_mean"), "Avg Bwd Segment Size": F.col("len_bwd_mean"),
        "Subflow Fwd Packets": F.col("fwd_pkts"), "Subflow Fwd Bytes": F.col("fwd_bytes"),
        "Subflow Bwd Packets": F.col("bwd_pkts"), "Subflow Bwd Bytes": F.col("bwd_bytes"),
        "act_data_pkt_fwd": F.col("fwd_pkts"), "min_seg_size_forward": F.col("len_fwd_min"),
        **_rates(),
    }
    for label, prefix in (("Fwd", "fwd"), ("Bwd", "bwd")):
        for stat in ("Max", "Min", "Mean", "Std"):
            values[f"{label} Packet Length {stat}"] = F.col(f"len_{prefix}_{stat.lower()}")
        for stat in ("Total", "Mean", "Std", "Max", "Min"):
            values[f"{label} IAT {stat}"] = F.col(f"iat_{prefix}_{stat.lower()}")
    for stat in ("Mean", "Std", "Max", "Min"):
        values[f"Flow IAT {stat}"] = F.col(f"iat_{stat.lower()}")
    values |= {n: named(n) for n in K.TCP_FLAG_BITS}
    flows = flows.select("*", *_side_flags())
    values |= {f"{s} {f} Flags": named(f"{s} {f} Flags") for f in ("PSH", "URG") for s in ("Fwd", "Bwd")}
    return flows.select(
        *KEY, "start_us",
        *[values.get(n, F.lit(0.0)).cast("double").alias(n) for n in K.FEATURES_78])
