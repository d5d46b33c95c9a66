import json
import os
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import functions as F

from conftest import rows
from wirelens import constants as K, schemas
from wirelens.operators import ids_alerts, metric_windows as M, packets as P, preparation, routing
from wirelens.plans.flow_alerting import AnomalyModel
from wirelens.sources import eve, store, views
from wirelens.streaming import jobs, rules, state

NOON = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)


def one_by_one(spark, parts, folder):
    """Tables as a stream that takes one of them per micro-batch, in the given order."""
    source = folder / "parts"
    for i, part in enumerate(parts):
        staging = folder / f"staging{i}"
        part.coalesce(1).write.parquet(str(staging))
        source.mkdir(exist_ok=True)
        (file,) = staging.glob("*.parquet")
        target = source / f"{i:03d}.parquet"
        target.write_bytes(file.read_bytes())
        os.utime(target, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def drain(stream, folder, mode="append"):
    """Run a stream over what is there, collecting batches as files."""
    out = str(folder / "out")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/b{batch_id}")
    jobs.stream_microbatch(stream, write, str(folder / "cp"), None, mode).awaitTermination(180)
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)


def staged(spark, df, folder):
    """A table written as files and opened again as a stream."""
    df.coalesce(2).write.parquet(str(folder / "in"))
    return spark.readStream.schema(df.schema).parquet(str(folder / "in"))


def seconds(*values):
    return [NOON + timedelta(seconds=v) for v in values]


def test_cooldown_admits_like_the_batch_form(spark, tmp_path):
    data = [(i, ts, "a", "b") for i, ts in enumerate(seconds(0, 5, 61, 70, 130))] + [(9, NOON, "a", "c")]
    schema = "flow_id long, ts timestamp, src_ip string, dst_ip string"
    df = spark.createDataFrame(data, schema)
    end = spark.createDataFrame([(99, NOON + timedelta(days=1), "z", "z")], schema)
    want = routing.alert_cooldown(df)
    # alerts come out of order, one micro-batch each, all inside the watermark
    parts = [df.where(F.col("flow_id") == i) for i in (3, 0, 4, 2, 9, 1)] + [end, end]
    got = drain(state.stream_cooldown(one_by_one(spark, parts, tmp_path), delay="10 minutes"), tmp_path)
    got = got.where("row <> 99")
    assert rows(got.where("admitted").select("row")) == [(0,), (2,), (4,), (9,)]
    assert rows(got.select("row", "admitted")) == rows(want.select("flow_id", "admitted"))


def test_flow_sessions_out_of_order(spark, tmp_path):
    names = [f.name for f in schemas.PACKET.fields]
    sample = packet_table(spark, "/root/testdata/sf0.001").select(*names).limit(1)

    def packet(i, second, proto=6):
        return sample.withColumns({"pkt_id": F.lit(i).cast("long"), "proto": F.lit(proto),
                                   "ts": F.lit(NOON + timedelta(seconds=second)).cast("timestamp")}) \
            .select(*[F.col(c).cast(sample.schema[c].dataType).alias(c) for c in names])
    times = {1: 0, 2: 20, 3: 10, 4: 200, 5: 190, 6: 240}
    whole = reduce(lambda a, b: a.unionByName(b), [packet(i, t) for i, t in times.items()])
    parts = [packet(i, t) for i, t in times.items()] + [packet(7, 90_000, 99), packet(8, 90_001, 99)]
    got = drain(state.stream_flow_sessions(one_by_one(spark, parts, tmp_path), 15, 600, "60 seconds"), tmp_path)
    want = P.flow_direction_totals(whole, 15, 600)
    columns = [*P.KEY, "start_us", "end_us", "fwd_pkts", "fwd_bytes", "bwd_pkts", "bwd_bytes"]
    assert rows(got.where("proto <> 99").select(*columns)) == rows(want.select(*columns)) and want.count() == 3


def packet_table(spark, sf):
    return views.packets(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))


def test_flow_sessions_equal_batch(spark, sf, tmp_path):
    packets = packet_table(spark, sf)
    late = packets.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("proto", F.lit(99))
    end = late.withColumn("pkt_id", F.lit(-1).cast("long"))
    whole = packets.unionByName(end).select(*[f.name for f in schemas.PACKET.fields])
    got = drain(state.stream_flow_sessions(staged(spark, whole, tmp_path), 86_400, 3 * 86_400), tmp_path)
    want = P.flow_direction_totals(packets, 86_400, 3 * 86_400)
    columns = [*P.KEY, "start_us", "end_us", "fwd_pkts", "fwd_bytes", "bwd_pkts", "bwd_bytes"]
    assert rows(got.where("proto <> 99").select(*columns)) == rows(want.select(*columns))


def test_sessions_of_many_keys_share_few_states(spark, sf, tmp_path):
    sample = packet_table(spark, sf).select(*[f.name for f in schemas.PACKET.fields]).limit(1)
    types = {f.name: f.dataType for f in sample.schema}

    def packets(n, ids, src, ts, **more):
        made = sample.drop("pkt_id").crossJoin(spark.range(n).select(F.col("id").alias("pkt_id")))
        columns = {"sport": F.col("pkt_id") % ids, "src": F.lit(src), "dst": F.lit("9.9.9.9"), "ts": ts, **more}
        return made.withColumns({k: (F.lit(v) if not hasattr(v, "cast") else v).cast(types[k]) for k, v in columns.items()}) \
            .select(*types)
    when = F.timestamp_seconds(F.lit(1_704_100_000) + F.col("pkt_id") % 13 * 100 + F.floor(F.col("pkt_id") / 500) * 7)
    many = packets(4000, 500, "1.1.1.1", when, proto=6)
    first, second = many.where("pkt_id % 3 <> 0"), many.where("pkt_id % 3 = 0")
    end = packets(1, 1, "2.2.2.2", F.lit("2030-01-01").cast("timestamp"), proto=99)
    out, stream = str(tmp_path / "out"), state.stream_flow_sessions(
        one_by_one(spark, [first, second, end, end], tmp_path), 150, 400, "1 hour", buckets=8)
    run = jobs.stream_microbatch(stream, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/b{i}"), str(tmp_path / "cp"), None)
    run.awaitTermination(180)
    got = spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(out)
    columns = [*P.KEY, "start_us", "end_us", "fwd_pkts", "fwd_bytes", "bwd_pkts", "bwd_bytes"]
    want = P.flow_direction_totals(many, 150, 400)
    assert rows(got.where("proto <> 99").select(*columns)) == rows(want.select(*columns)) and want.count() > 500
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in run.recentProgress) < 100  # 500 keys


def test_cooldown_pairs_of_one_bucket(spark, tmp_path):
    schema = "flow_id long, ts timestamp, src_ip string, dst_ip string"
    data = [(i, NOON + timedelta(seconds=i * 7 % 600), f"s{i % 5}" if i % 5 else None, "d") for i in range(200)]
    df = spark.createDataFrame(data, schema)
    end = spark.createDataFrame([(999, NOON + timedelta(days=1), "z", "z")], schema)
    parts = [df.where(F.col("flow_id") % 3 == i) for i in (2, 0, 1)] + [end, end]
    got = drain(state.stream_cooldown(one_by_one(spark, parts, tmp_path), delay="20 minutes", buckets=1), tmp_path)
    assert rows(got.where("row <> 999").select("row", "admitted")) == rows(
        routing.alert_cooldown(df).select("flow_id", "admitted"))


def test_idle_sessions_equal_batch(spark, sf, tmp_path):
    packets = packet_table(spark, sf)
    end = packets.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp")).withColumn("proto", F.lit(99))
    got = drain(state.stream_idle_sessions(staged(spark, packets.unionByName(end), tmp_path), 6 * 3600), tmp_path)
    want = P.flow_sessions_idle(packets, 6 * 3600)
    columns = [*P.KEY, "start_us", "end_us", "packets"]
    assert rows(got.where("proto <> 99").select(*columns)) == rows(want.select(*columns))


def test_attack_rate_equals_batch(spark, sf, tmp_path):
    p = views.predictions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    end = p.limit(1).withColumn("ts", F.lit("2030-01-01").cast("timestamp"))
    stream = jobs.stream_attack_rate(staged(spark, p.unionByName(end), tmp_path), "5 hours", "1 hour", 0.25)
    want = M.attack_rate_window(p, 5 * 3600, 3600, 0.25)
    cut = 1_893_456_000_000_000 - 6 * 3_600_000_000
    assert rows(drain(stream, tmp_path).where(F.col("window_us") < cut)) == rows(want)


def test_dedup_keeps_one_per_key(spark, sf, tmp_path):
    alerts = views.ids_alerts(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drain(jobs.stream_dedup_alerts(staged(spark, alerts, tmp_path), "60 days"), tmp_path)
    assert got.count() == alerts.select(ids_alerts.alert_key()).distinct().count()


def test_counters_update(spark, sf, tmp_path):
    e = views.table(spark, sf, "events")
    got = drain(jobs.stream_counters(staged(spark, e, tmp_path), "event_type"), tmp_path, "update")
    assert rows(got) == rows(ids_alerts.event_type_counts(e))


def eve_flow_line(i, pkts=10, **extra):
    return json.dumps({"timestamp": "2026-03-25T10:00:00.000000+00:00", "event_type": "flow", "flow_id": str(i),
                       "src_ip": "10.0.0.1", "dest_ip": "10.0.0.2", "src_port": 1000 + i, "dest_port": 443, "proto": "TCP",
                       "flow": {"pkts_toserver": pkts, "pkts_toclient": 1, "bytes_toserver": 100 * pkts,
                                "bytes_toclient": 10, "age": 5}, **extra})


def test_scored_stream_follows_new_files(spark, tmp_path):
    landing, out, cp = tmp_path / "eve", str(tmp_path / "alerts"), str(tmp_path / "cp")
    landing.mkdir()
    scaler = preparation.Scaler(K.FEATURES_25, [0.0] * 25, [1000.0] * 25)
    model = AnomalyModel(scaler, 1.0)
    (landing / "one.json").write_text("\n".join([eve_flow_line(1), "broken {", eve_flow_line(2, 1), eve_flow_line(3)]))

    def run():
        events = eve.src_eve_stream(spark, str(landing), 1)
        jobs.stream_score_flows(events, model, [{"name": "x", "src_port": 1003}], out, cp, None).awaitTermination(180)
        return sorted(r.flow_id for r in spark.read.json(out).select("flow_id").collect())
    assert run() == ["1"]
    (landing / "two.json").write_text(eve_flow_line(7))
    assert run() == ["1", "7"]
    assert run() == ["1", "7"]


def test_scored_stream_keeps_cooldown_and_limit_across_batches(spark, tmp_path):
    landing, out, cp = tmp_path / "eve", str(tmp_path / "alerts"), str(tmp_path / "cp")
    landing.mkdir()
    model = AnomalyModel(preparation.Scaler(K.FEATURES_25, [0.0] * 25, [1000.0] * 25), 1.0)

    def run(name, flows):
        (landing / name).write_text("\n".join(
            eve_flow_line(i, src_ip=src, timestamp=f"2026-03-25T10:{s // 60:02d}:{s % 60:02d}.000000+00:00") for i, s, src in flows))
        jobs.stream_score_flows(eve.src_eve_stream(spark, str(landing), 1), model, [], out, cp, None).awaitTermination(180)
        return sorted(int(r.flow_id) for r in spark.read.json(out).where("admitted").collect())
    assert run("one.json", [(i, i, f"10.0.0.{i}") for i in range(12)] + [(50, 5, "10.0.0.0")]) == [*range(12)]
    assert run("two.json", [(i, i, f"10.0.0.{i}") for i in range(12, 24)] + [(51, 15, "10.0.0.1")]) == [*range(20)]
    assert run("three.json", [(60, 62, "10.0.0.23"), (61, 63, "10.0.0.23")]) == [*range(20), 60]
    assert spark.read.json(out).count() == 28


def hids_line(i, log):
    return json.dumps({"id": f"{i:06d}", "timestamp": "2026-01-01T00:00:00.000+0000", "full_log": log,
                       "rule": {"level": 10, "id": "510", "description": "d", "groups": ["g"]}, "agent": {"name": "pi0"}})


def test_triage_stream_counts_hits_once(spark, tmp_path):
    landing = tmp_path / "hids"
    landing.mkdir()
    paths = [str(tmp_path / n) for n in ("store", "marks", "queue")]
    lesson = spark.createDataFrame([("abc12345", 1, "authoritative", "operator", 1, 3, "510", "pi0", ["trojaned version"],
                                     "noise", "ignore", "", "2026-01-01T00:00:00Z", "2026-01-01T00:00:00Z", None, 0)],
                                   "lesson_id string, ord long, status string, source string, promotion_count long, "
                                   "promotion_threshold long, rule_id string, agent string, log_keywords array<string>, "
                                   "severity string, action string, reason string, created_at string, "
                                   "last_seen_at string, last_promoted_at string, hits long")
    store.save_lessons(lesson, paths[0])
    (landing / "a.json").write_text("\n".join([hids_line(1, "Trojaned\tversion of x"), "bad", hids_line(2, "other")]))

    def run():
        jobs.stream_triage(eve.hids_stream(spark, str(landing)), *paths, str(tmp_path / "cp"), None).awaitTermination(180)
    run()
    run()
    queue = eve.src_queue(spark, paths[2] + "/*")
    assert rows(queue.select("alert_id", "triage.classifier", "triage.severity")) == [
        ("000001", "lesson-cache", "noise"), ("000002", "fallback-health", "high")]
    assert store.src_lessons(spark, paths[0]).first().hits == 1
    # a replayed batch leaves queue and hits as they are
    batch = eve.good_lines(eve.read_json_lines(spark, str(landing), schemas.HIDS_ALERT)).where("id is not null")
    jobs.triage_batch(*paths)(batch, 0)
    assert store.src_lessons(spark, paths[0]).first().hits == 1
    assert eve.src_queue(spark, paths[2] + "/*").count() == 2
    assert store.load_mark(spark, paths[1])["last_alert_id"] == "000002"


def test_silence_is_told_while_a_key_receives_nothing(spark, tmp_path):
    def signs(*values):
        return spark.createDataFrame([(job, NOON + timedelta(minutes=m), hit) for job, m, hit in values], "job string, ts timestamp, hit boolean")
    # b stops after its first slot; only a moves the watermark on
    parts = [signs(("a", 1, True), ("b", 2, True)), signs(("a", 6, False), ("a", 12, True)), signs(("a", 31, True)), signs(("a", 40, True)), signs(("a", 41, True))]
    out = drain(rules.stream_silence(one_by_one(spark, parts, tmp_path), F.col("hit"), ["job"], 300, "1 minute"), tmp_path)
    start = int(NOON.timestamp()) // 60
    got = sorted((r.job, r.window_us // 60_000_000 - start, r.state) for r in out.collect())
    assert got == [("a", 5, "silent"), ("a", 15, "down"), ("a", 20, "down"), ("a", 25, "down"), ("a", 35, "down")] + [("b", m, "down") for m in range(5, 40, 5)]


def test_sustained_stream_equals_batch(spark, sf, tmp_path):
    p = views.predictions(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    end = p.limit(1).withColumns({"ts": F.lit("2030-01-01").cast("timestamp"), "prediction": F.lit("BENIGN")})
    out = drain(rules.attack_rate_rule(staged(spark, p.unionByName(end), tmp_path), size_s=18_000, step_s=3600, limit=0.2, for_s=7200), tmp_path)
    want = M.sustained_for(M.attack_rate_window(p, 18_000, 3600, 0.2), 3600, 7200)
    ended = out.where("state = 'resolved'").select("from_us", "to_us", "windows")
    assert rows(ended) == rows(want) and want.count() > 0
    assert out.where("state = 'firing' AND to_us - from_us = 7200000000").count() == want.count()
