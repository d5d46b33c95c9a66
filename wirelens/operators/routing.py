"""From scored flows to routed alerts."""

import functools
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from wirelens import constants as K
from wirelens.functions.numeric import named
from wirelens.functions.text import or_default
from wirelens.functions.time import micros
from wirelens.operators.skew import greedy_starts, join_summary
from wirelens.session import cut_lineage, drop_folder, scratch_folder

MATCH_KEYS = ["src_ip", "dst_ip", "src_port", "dst_port", "proto"]


LISTED_RULES = 64  # rules of a list that are asked one after the other, as conditions of the plan
CLASSIFIER_RULES = 250_000  # rules that travel with every task, some 150 bytes each


def _shape() -> Column:
    """Which keys a rule names, as bits."""
    return sum(((F.col(k).isNotNull()).cast("int") * (1 << i) for i, k in enumerate(MATCH_KEYS)), F.lit(0))


def _slot(shape: Column, keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(shape, *[F.col(k).cast("string") for k in keys]), F.lit(slots)).cast("int")


def _named(shape: int) -> list[str]:
    return [k for i, k in enumerate(MATCH_KEYS) if shape >> i & 1]


def _slot(keys: list[str], slots: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(slots), *[F.col(k).cast("string") for k in keys]), F.lit(slots)).cast("int")


def rule_slots(rules: DataFrame, shape: int, slots: int) -> DataFrame:
    """One row: the rules that name the keys of ``shape`` as a hash table, ``slots`` lists of (keys, rule).

    Of rules with equal keys only the first can ever decide and is kept.
    """
    keys = _named(shape)
    first = rules.where(_shape() == shape).groupBy(*keys).agg(F.min(F.struct("ord", "name")).alias("rule"))
    held = first.groupBy(_slot(keys, slots).alias("slot")).agg(F.collect_list(F.struct(*keys, "rule")).alias("rules"))
    every = rules.sparkSession.range(slots).select(F.col("id").cast("int").alias("slot")).join(held, "slot", "left")
    none = F.array().cast(held.schema["rules"].dataType)
    ordered = F.array_sort(F.collect_list(F.struct("slot", F.coalesce("rules", none).alias("rules"))))
    return every.agg(F.transform(ordered, lambda s: s["rules"]).alias("slots"))


def _first_fit(column: str, shape: int) -> Column:
    """The rules of a slot that equal the flow in all keys they name; a list of at most one."""
    return F.filter(F.col(column), lambda rule: functools.reduce(Column.__and__, [rule[k] == F.col(k) for k in _named(shape)], F.lit(True)))


def _first_listed(rules: list[dict]) -> Column:
    name = F.lit(None).cast("string")
    for rule in reversed(rules):
        named_keys = [F.col(k) == F.lit(rule[k]) for k in MATCH_KEYS if rule.get(k) is not None]
        name = F.when(functools.reduce(Column.__and__, named_keys, F.lit(True)), F.lit(rule["name"])).otherwise(name)
    return name


def allowlist_match(flows: DataFrame, rules, out: str = "allow_rule") -> DataFrame:
    """Name of the first rule whose present keys all equal the flow's; an absent key is a wildcard, a null in a flow
    equals nothing.

    A short list of Python dicts becomes conditions of the plan.  Longer lists, and tables of ord, name and keys,
    become a tuple-space classifier: a hash table for
    every combination of keys that some rule names (at most 32), asked once per flow.  The tables are
    scalars of the plan, so a flow is judged in a projection and never shuffled.  That holds up to
    ``CLASSIFIER_RULES`` rules, which are counted first; a larger table is matched by one equi-join a
    combination, with the same result.
    """
    if isinstance(rules, list):
        if len(rules) <= LISTED_RULES:
            return flows.withColumn(out, _first_listed(rules))
        rules = rule_table(flows.sparkSession, rules)
    counted = {r["shape"]: r["count"] for r in rules.groupBy(_shape().alias("shape")).count().collect()}  # at most 32 rows
    if not counted:
        return flows.withColumn(out, F.lit(None).cast("string"))
    if sum(counted.values()) > CLASSIFIER_RULES:
        return _match_by_joins(flows, rules, sorted(counted), out)
    columns, looked = flows.columns, {}
    for shape, n in sorted(counted.items()):
        slots = 1 << n.bit_length()
        looked[shape] = F.get(rule_slots(rules, shape, slots).scalar(), _slot(_named(shape), slots)).alias(f"_rules{shape}")
    held = flows.select("*", *looked.values())
    rule = [F.transform(_first_fit(f"_rules{shape}", shape), lambda rule: rule["rule"]) for shape in looked]
    return held.select(*[named(c) for c in columns], F.array_min(F.concat(*rule))["name"].alias(out))


def _match_by_joins(flows: DataFrame, rules: DataFrame, shapes: list[int], out: str) -> DataFrame:
    columns = flows.columns
    candidates = []
    for shape in shapes:
        keys, hit = _named(shape), f"_rule{shape}"
        best = rules.where(_shape() == shape).groupBy(*keys).agg(F.min(F.struct("ord", "name")).alias(hit))
        flows = flows.join(best, keys, "left") if keys else flows.withColumn(hit, best.select(hit).scalar())
        candidates.append(hit)
    earliest = F.array_min(F.filter(F.array(*candidates), lambda c: c.isNotNull()))
    return flows.select(*[named(c) for c in columns], earliest.getField("name").alias(out))


def rule_table(spark, rules: list[dict]) -> DataFrame:
    rows = [(i, r["name"], *[r.get(k) for k in MATCH_KEYS]) for i, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "ord int, name string, src_ip string, dst_ip string, src_port int, dst_port int, proto string")


def allowlist_exclude(flows: DataFrame, rules) -> DataFrame:
    """Flows no rule covers; the covered ones stay scored but raise nothing."""
    return allowlist_match(flows, rules, "_allow").where(F.col("_allow").isNull()).drop("_allow")


def severity_tier(score: Column, anomaly: Column, threshold: float) -> Column:
    """Emergency by score first, then critical by the model's own flag, then warning by score."""
    return (F.when(score >= threshold * K.EMERGENCY_FACTOR, "emergency")
            .when(anomaly, "critical")
            .when(score >= threshold * K.WARN_FACTOR, "warning"))


def alert_payload(scored: DataFrame, threshold: float, keep=()) -> DataFrame:
    """The 16 alert columns, and those to ``keep``; rounding is half-even as in the published payloads."""
    return scored.select(
        "severity", F.bround("score", 6).alias("score"), F.lit(round(threshold, 6)).alias("threshold"),
        F.bround(F.col("score") / threshold, 2).alias("ratio"),
        "src_ip", "src_port", "dst_ip", "dst_port", "proto",
        F.col("flow_id").cast("string").alias("flow_id"), F.col("ts").alias("timestamp"),
        F.bround(named("Flow Duration") / 1e6, 3).alias("duration_s"),
        named("Total Length of Fwd Packets").alias("fwd_bytes"),
        named("Total Length of Bwd Packets").alias("bwd_bytes"),
        named("Total Fwd Packets").alias("fwd_pkts"), named("Total Backward Packets").alias("bwd_pkts"), *keep)


def alert_payload_loki(payload: DataFrame, job: str = "flow-anomaly") -> DataFrame:
    """Labelled push document per alert: labels, and one [nanoseconds, alert JSON] value."""
    body = [c for c in payload.columns]
    stream = F.struct(
        F.lit(job).alias("job"), "severity", or_default(F.col("src_ip"), "unknown").alias("src_ip"),
        or_default(F.col("dst_ip"), "unknown").alias("dst_ip"))
    nanos = (micros(F.col("timestamp")) * 1000).cast("string")
    line = F.to_json(F.struct(*body), {"ignoreNullFields": "false"})
    entry = F.struct(stream.alias("stream"), F.array(F.array(nanos, line)).alias("values"))
    return payload.select("flow_id", F.to_json(F.struct(F.array(entry).alias("streams"))).alias("payload"))


def alert_syslog_line(payload: DataFrame, tag: str = "flow-anomaly") -> DataFrame:
    """Priority-tagged key=value line per alert."""
    def text(name):
        return or_default(F.col(name), "None")
    line = F.concat(
        F.lit(f"<134>{tag}: severity="), text("severity"), F.lit(" score="), text("score"),
        F.lit(" threshold="), text("threshold"),
        F.lit(" src="), text("src_ip"), F.lit(":"), text("src_port"),
        F.lit(" dst="), text("dst_ip"), F.lit(":"), text("dst_port"),
        F.lit(" proto="), or_default(F.col("proto"), "unknown"),
        F.lit(" fwd_bytes="), F.bround("fwd_bytes", 0).cast("decimal(30,0)").cast("string"),
        F.lit(" bwd_bytes="), F.bround("bwd_bytes", 0).cast("decimal(30,0)").cast("string"))
    return payload.select("flow_id", line.alias("line"))


def alert_cooldown(alerts: DataFrame, cooldown_s: float = K.ALERT_COOLDOWN_S, ts: str = "ts",
                   row_id: str = "flow_id", pair=("src_ip", "dst_ip")) -> DataFrame:
    """Add ``admitted``: per pair, an alert passes if the last passed one is ``cooldown_s`` old.

    Times that pass form a linked list per pair (see ``greedy_starts``), so a pair that holds a
    third of all alerts is still followed in parallel.  Of alerts at the same instant the one
    with the smallest id passes.
    """
    pair = list(pair)
    gap = int(cooldown_s * 1_000_000)
    timed = alerts.withColumn("_us", micros(F.col(ts)))
    picks = greedy_starts(timed, pair, "_us", gap, strict=False)
    first = (timed.groupBy(*pair, "_us").agg(F.min(row_id).alias("_first")))
    chosen = join_summary(first, picks.withColumnRenamed("us", "_us"), [*pair, "_us"])
    marked = join_summary(timed, chosen.withColumn("_pick", F.lit(True)), [*pair, "_us"], "left")
    passed = F.coalesce(F.col("_pick") & (F.col("_first") == F.col(row_id)), F.lit(False))
    return marked.withColumn("admitted", passed).drop("_us", "_first", "_pick")


def pair_key(pair=("src_ip", "dst_ip")) -> Column:
    return F.to_json(F.struct(*pair), {"ignoreNullFields": "false"})


def _admitted(events: pd.DataFrame, entry, limit: int, cooldown_us: int, window_us: int) -> pd.DataFrame:
    """Admission rule over one chunk of alerts, continuing from the admissions (us, pair) in ``entry``.

    While the window is full nothing can pass, so those alerts are skipped by a search in the times.
    """
    events = events.sort_values(["us", "row"], kind="stable")
    times = events["us"].to_numpy(dtype="int64")
    us, pairs = times.tolist(), events["pair"].tolist()
    entry = sorted(entry)
    recent = deque(int(u) for u, _ in entry)
    last, picks, i = {k: int(u) for u, k in entry}, [], 0
    while i < len(us) and limit > 0:
        now, pair = us[i], pairs[i]
        while recent and recent[0] < now - window_us:
            recent.popleft()
        if len(recent) >= limit:
            # the next alert after one of the oldest leaves the window, should more than the limit be in it
            i = int(np.searchsorted(times, recent[len(recent) - limit] + window_us, side="right"))
            continue
        if now - last.get(pair, now - cooldown_us) >= cooldown_us:
            last[pair] = now
            recent.append(now)
            picks.append(i)
        i += 1
    return events.iloc[picks][["row", "us", "pair"]]


def _fold_chunk(*rule):
    def fold(events: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        out = _admitted(events, zip(entry["us"], entry["pair"]), *rule)
        out.insert(0, "chunk", events["chunk"].iloc[0] if len(events) else -1)
        return out.astype({"chunk": "int64", "us": "int64"})
    return fold


def _chunk_end(entry: list, since: int, *rule):
    """The admissions from ``since`` on, of one chunk and of those before it."""
    def end(parts):
        passed = _admitted(pd.concat(list(parts)), entry, *rule)
        known = [*entry, *zip(passed["us"].tolist(), passed["pair"].tolist())]
        yield pd.DataFrame([e for e in known if e[0] >= since], columns=["us", "pair"]).astype({"us": "int64", "pair": "object"})
    return end


def alert_rate_limit(alerts: DataFrame, cooldown_s: float = K.ALERT_COOLDOWN_S, limit: int = K.ALERTS_PER_WINDOW,
                     window_s: float = K.ALERT_WINDOW_S, ts: str = "ts", row_id: str = "flow_id",
                     pair=("src_ip", "dst_ip"), chunk_rows: int = 200_000, earlier=()) -> DataFrame:
    """Add ``admitted``: the pair's cooldown has passed and fewer than ``limit`` alerts were
    admitted in the trailing window over all pairs.  A rejected alert starts no cooldown.

    The rule is one sequence over all alerts, so it cannot be split by pair.  The ordered
    alerts are cut into chunks of bounded size that are folded side by side, each from the
    admissions known for the time before it.  Chunks whose entry state turns out different are
    folded again.  A silence longer than the state reaches back settles everything after it, so on
    quiet traffic that is all.  Under constant load the admissions of one chunk shift those of every
    later one; then the chunks are walked in order, one task each, that hand on nothing but the admissions still in
    reach, and are folded side by side once more from what was found.  So the number of jobs is that of the chunks at
    most, and each chunk is read four times at most.  Only (time, id, pair) takes part.

    ``earlier`` holds (microseconds, ``pair_key``) of admissions before these alerts, as a stream knows them.
    An alert without a time is not admitted.
    """
    spark = alerts.sparkSession
    cooldown_us, window_us = int(cooldown_s * 1e6), int(window_s * 1e6)
    reach, rule = max(cooldown_us, window_us), (limit, cooldown_us, window_us)
    slim = alerts.where(F.col(ts).isNotNull()).select(
        F.col(row_id).alias("row"), micros(F.col(ts)).alias("us"), pair_key(pair).alias("pair"))
    if cooldown_us > 0:  # of a pair's alerts at one instant only the first can pass
        slim = slim.groupBy("us", "pair").agg(F.min("row").alias("row")).select("row", "us", "pair")
    chunks = max(1, -(-slim.count() // chunk_rows))
    folder = scratch_folder(spark, "chunks")
    ordered = slim.repartitionByRange(chunks, F.col("us"), F.col("row").asc_nulls_last())
    ordered.select(F.spark_partition_id().cast("long").alias("chunk"), "us", "row", "pair").write.partitionBy("chunk").parquet(folder)
    schema = T.StructType([T.StructField("us", T.LongType()), T.StructField("row", slim.schema["row"].dataType),
                           T.StructField("pair", T.StringType())])
    events = spark.read.schema(T.StructType([*schema, T.StructField("chunk", T.LongType())])).parquet(folder).select(
        "chunk", "us", "row", "pair")
    bounds = cut_lineage(events.groupBy("chunk").agg(F.min("us").alias("first_us")).repartition(1))
    known = spark.createDataFrame([tuple(e) for e in earlier], "us long, pair string")
    before = cut_lineage(bounds.join(known, F.col("us") >= F.col("first_us") - reach).select("chunk", "us", "pair"))

    def run(part: DataFrame, entry: DataFrame) -> DataFrame:
        fresh = entry.select(F.col("chunk").alias("chunk"), "us", "pair")
        return cut_lineage(part.groupBy("chunk").cogroup(fresh.groupBy("chunk")).applyInPandas(
            _fold_chunk(*rule), T.StructType([T.StructField("chunk", T.LongType()), schema["row"], schema["us"], schema["pair"]])))

    def entry_states(admitted: DataFrame) -> DataFrame:
        """Admissions of earlier chunks that still matter when a chunk begins, one row each.
        Chunks and admissions meet per reach-wide slot of time, each at most in two slots."""
        slots = bounds.withColumn("_b", F.explode(F.array(
            F.floor(F.col("first_us") / reach), F.floor(F.col("first_us") / reach) - 1)))
        near = admitted.select(F.col("chunk").alias("_from"), "us", "pair", F.floor(F.col("us") / reach).alias("_b"))
        return (slots.join(near, "_b").where((F.col("us") >= F.col("first_us") - reach) & (F.col("_from") < F.col("chunk")))
                .select("chunk", "us", "pair").unionByName(before))

    def walked(first: int, now: DataFrame) -> DataFrame:
        """Entry states of all chunks, exact from chunk ``first`` on, whose own is exact already."""
        order = [tuple(r) for r in bounds.where(F.col("chunk") >= first).select("chunk", "first_us").orderBy("chunk").collect()]
        state = [(r.us, r.pair) for r in now.where(F.col("chunk") == first).collect()]
        found = [(first, *e) for e in state]
        for (chunk, _), (later, first_us) in zip(order, order[1:]):
            one = spark.read.schema(schema).parquet(f"{folder}/chunk={chunk}").coalesce(1)
            state = [tuple(r) for r in one.mapInPandas(_chunk_end(state, first_us - reach, *rule), "us long, pair string").collect()]
            found += [(later, *e) for e in state]
        exact = spark.createDataFrame(found, "chunk long, us long, pair string")
        return cut_lineage(now.where(F.col("chunk") < first).unionByName(exact))

    admitted, entry, passes = run(events, before), before, 1
    while True:
        now = cut_lineage(entry_states(admitted))
        changed = cut_lineage(now.exceptAll(entry).unionByName(entry.exceptAll(now)).select("chunk").distinct())
        first = changed.agg(F.min("chunk")).first()[0]
        if first is None:
            break
        if passes == 2:
            now = walked(first, now)
            changed = bounds.where(F.col("chunk") >= first).select("chunk")
        again = run(events.join(changed, "chunk"), now.join(changed, "chunk", "left_semi"))
        admitted = cut_lineage(admitted.join(changed, "chunk", "left_anti").unionByName(again))
        entry, passes = now, passes + 1
    drop_folder(spark, folder)
    passed = admitted.select(F.col("row").alias(row_id), F.lit(True).alias("admitted"))
    return alerts.join(passed, row_id, "left").withColumn("admitted", F.coalesce("admitted", F.lit(False)))


def suppression_stats(routed: DataFrame) -> DataFrame:
    """One row of counters over flows with severity, allow_rule and admitted (null: not checked)."""
    seconds = (F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6
    open_flow = F.col("allow_rule").isNull()

    def passed(severity):
        return F.count_if(open_flow & (F.col("severity") == severity) & F.col("admitted"))
    return routed.agg(
        F.count("*").alias("flows_read"),
        F.count_if(open_flow & (F.col("severity") == "warning")).alias("alerts_warning"),
        passed("critical").alias("alerts_critical"), passed("emergency").alias("alerts_emergency"),
        F.count_if(open_flow & F.col("severity").isin("critical", "emergency") & ~F.col("admitted"))
        .alias("alerts_suppressed"),
        F.count_if(~open_flow).alias("allowlisted"),
        F.bround(F.count("*") / F.greatest(seconds, F.lit(1.0)), 2).alias("flows_per_sec"))
