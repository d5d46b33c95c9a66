"""Building blocks that keep hot groups spread over many tasks.

Windows over a raw key put that key's rows into one task.  These helpers cut a
key into ordered buckets, work per (key, bucket), and stitch the buckets
together from a per-bucket summary that partial aggregation has already shrunk.
"""

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens.session import cut_lineage


SLOTS = 4096


def join_summary(df: DataFrame, summary: DataFrame, columns: list[str], how="inner") -> DataFrame:
    """Equi-join on columns that may be null, keeping one copy of them."""
    renamed = summary.select(*[F.col(c).alias(f"_s_{c}") if c in columns else F.col(c)
                               for c in summary.columns])
    condition = F.lit(True)
    for name in columns:
        condition = condition & F.col(name).eqNullSafe(F.col(f"_s_{name}"))
    return df.join(renamed, condition, how).drop(*[f"_s_{c}" for c in columns])


def rank_within(df: DataFrame, keys: list[str], bucket: str, order: list[Column],
                rank="rank", size="group_size") -> DataFrame:
    """Exact 0-based rank inside each key, and the key's row count.

    ``bucket`` must rise with ``order``; rows are sorted per (key, bucket) and the
    offset of a bucket is the running count of the key's earlier buckets.  Keys travel as one
    struct, whose equality takes null as a value, so the sort and the join share one shuffle.
    """
    placed = df.withColumn("_part", F.struct(*keys, F.col(bucket).alias("_bucket")))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", "_part.*", "_n")
    running = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*keys)).alias(size))
    local = placed.withColumn("_pos", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    return (local.join(offsets, "_part")
            .withColumn(rank, F.col("_before") + F.col("_pos") - 1)
            .drop("_part", "_before", "_pos"))


def _bracket(p: float, accuracy: int) -> tuple[float, float]:
    margin = 2.0 / accuracy
    return max(0.0, p - margin), min(1.0, p + margin)


def exact_percentile(df: DataFrame, keys: list[str], value: str, p: float, name: str,
                     accuracy: int = 100_000) -> DataFrame:
    """Exact interpolated percentile per key, without holding a key's values in one task.

    A mergeable quantile sketch brackets the wanted rank; only values inside the bracket
    (about 4/accuracy of a large group) are sorted, everything below is just counted.
    """
    low, high = _bracket(p, accuracy)
    df = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias("_key"), F.col(value).alias("_v"))
    stats = df.groupBy("_key").agg(
        F.count("*").alias("_n"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
        F.percentile_approx("_v", [low, high], accuracy).alias("_q"))
    small = F.col("_n") <= accuracy
    stats = stats.select("_key", "_n", F.when(small, F.col("_min")).otherwise(F.col("_q")[0]).alias("_low"),
                         F.when(small, F.col("_max")).otherwise(F.col("_q")[1]).alias("_high"))
    # values below the bracket fall together into one null row per key, which sorts first
    counts = (df.join(stats, "_key").where(F.col("_v") <= F.col("_high"))
              .groupBy("_key", "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v"))
              .agg(F.count("*").alias("_c")))
    running = Window.partitionBy("_key").orderBy(F.col("_v").asc_nulls_first())
    position = F.lit(p) * (F.col("_n") - 1)
    ranked = counts.withColumn("_seen", F.sum("_c").over(running)).groupBy("_key", "_n").agg(
        F.min(F.when(F.col("_seen") > F.floor(position), F.col("_v"))).alias("_lo"),
        F.min(F.when(F.col("_seen") > F.ceil(position), F.col("_v"))).alias("_hi"))
    share = position - F.floor(position)
    return ranked.select("_key.*", F.col("_n").alias("n"),
                         (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * share).alias(name))


def global_percentile(df: DataFrame, value: str, p: float, accuracy: int = 100_000):
    """The same for a whole table, as a Python float (None for an empty table)."""
    low, high = _bracket(p, accuracy)
    df = df.select(value).where(F.col(value).isNotNull())
    n, smallest, largest, q = df.agg(
        F.count("*"), F.min(value), F.max(value), F.percentile_approx(value, [low, high], accuracy)).first()
    if n == 0:
        return None
    if n <= accuracy:
        q = [smallest, largest]
    position = p * (n - 1)
    wanted = [math.floor(position), math.ceil(position)]
    # rows below the bracket are only counted; the bracket is cut into slots, and only the slots that
    # hold the two ranks are sorted
    below = df.where(F.col(value) < q[0]).count() if n > accuracy else 0
    width = float(q[1]) - float(q[0])
    slot = F.lit(0)
    if 0 < width < math.inf:
        slot = F.least(F.floor((F.col(value) - q[0]) / width * SLOTS), F.lit(SLOTS - 1)).cast("int")
    inside = (df.where(F.col(value).between(q[0], q[1])).groupBy(value, slot.alias("_slot"))
              .agg(F.count("*").alias("_c")))
    before, found, at = below, {}, [None, None]
    for row in inside.groupBy("_slot").agg(F.sum("_c").alias("_c")).orderBy("_slot").collect():  # at most SLOTS rows
        for i, rank in enumerate(wanted):
            if before <= rank < before + row._c:
                found[row._slot], at[i] = before, row._slot
        before += row._c
    start = F.coalesce(*[F.when(F.col("_slot") == s, b) for s, b in found.items()])
    running = Window.partitionBy("_slot").orderBy(value)
    ranked = inside.where(F.col("_slot").isin(*found)).withColumn("_seen", F.sum("_c").over(running) + start)
    lo, hi = ranked.agg(*[F.min(F.when((F.col("_slot") == s) & (F.col("_seen") > rank), F.col(value)))
                          for s, rank in zip(at, wanted)]).first()
    return lo + (hi - lo) * (position - math.floor(position))


def greedy_starts(events: DataFrame, keys: list[str], us: str, gap_us: int, strict: bool) -> DataFrame:
    """Times a greedy restart rule picks: the first event of a key, then every time the first
    event that lies ``gap_us`` (``strict``: more than ``gap_us``) after the last pick.

    The rule is a linked list over event times, so instead of folding a key in one task the
    list is followed by pointer doubling: log2(picks) equi-joins on (key, time), which stay
    even however hot a key is.  Keys that span less than the gap never enter the loop.
    Returns one row (keys..., us) per pick.  Null is a key value like any other.
    """
    apart = (lambda d: d > gap_us) if strict else (lambda d: d >= gap_us)
    nodes = events.select(F.struct(*keys).alias("_key"), F.col(us).alias("us")).distinct()
    nodes = nodes.withColumn("_b", F.floor(F.col("us") / gap_us).cast("long"))

    # buckets are as wide as the gap, so a certain restart can only be the first event of a bucket
    buckets = nodes.groupBy("_key", "_b").agg(F.min("us").alias("_first"), F.max("us").alias("_last"))
    timeline = Window.partitionBy("_key").orderBy("_b")
    quiet = F.col("_first") - F.lag("_last").over(timeline)
    adjacent = F.lead("_b").over(timeline) == F.col("_b") + 1
    buckets = buckets.select(
        "_key", "_b", "_first", "_last", (quiet.isNull() | apart(quiet)).alias("_root"),
        F.when(adjacent, F.lead("_first", 2).over(timeline)).otherwise(F.lead("_first").over(timeline)).alias("_after"))
    island = Window.partitionBy("_key", "_island")
    buckets = (buckets.withColumn("_island", F.sum(F.col("_root").cast("int")).over(timeline))
               .withColumn("_until", F.max("_last").over(island))
               .withColumn("_long", apart(F.col("_until") - F.min("_first").over(island))))
    buckets = cut_lineage(buckets.select("_key", "_b", "_first", "_root", "_after", "_until", "_long"))
    roots = buckets.where("_root").select("_key", F.col("_first").alias("us"))
    if buckets.where("_long").isEmpty():
        return roots.select("_key.*", "us")

    # successor of a node: first node at or past us + gap, in the next bucket or the first one after
    # it; a node whose successor would lie past the end of its island has none
    none = F.lit(None).cast("long")
    active = nodes.join(buckets.where("_long").select("_key", "_b", "_after", "_until"), ["_key", "_b"])
    probes = active.where(apart(F.col("_until") - F.col("us"))).select(
        "_key", (F.col("us") + gap_us).alias("_at"), (F.col("_b") + 1).alias("_b"),
        F.col("us").alias("_from"), "_after", none.alias("_node"))
    targets = active.select("_key", F.col("us").alias("_at"), "_b", none.alias("_from"), none.alias("_after"),
                            F.col("us").alias("_node"))
    node_last = F.col("_node").isNotNull() if strict else F.col("_node").isNull()
    onward = (Window.partitionBy("_key", "_b").orderBy(F.col("_at").desc(), node_last)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    jumps = (
        targets.unionByName(probes)
        .withColumn("_next", F.last("_node", ignorenulls=True).over(onward))
        .where(F.col("_from").isNotNull())
        .select("_key", F.col("_from").alias("us"), F.coalesce("_next", "_after").alias("next")))
    picked, jumps = roots, cut_lineage(jumps)
    known = picked.count()
    while True:
        reached = picked.join(jumps, ["_key", "us"]).select("_key", F.col("next").alias("us"))
        picked = cut_lineage(picked.unionByName(reached).distinct())
        before, known = known, picked.count()
        if known == before:
            return picked.select("_key.*", "us")
        further = jumps.select("_key", F.col("us").alias("next"), F.col("next").alias("_far"))
        jumps = cut_lineage(jumps.join(further, ["_key", "next"]).select("_key", "us", F.col("_far").alias("next")))
