import json
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from wirelens import constants as K, schemas
from wirelens.operators import flow_records as R, ids_alerts, lessons as L
from wirelens.operators.preparation import Scaler
from wirelens.sources import eve, store, tables


def flow(up, down, **more):
    return {"event_type": "flow", "flow": {"pkts_toserver": up, "pkts_toclient": down, "bytes_toserver": 2000,
                                           "bytes_toclient": 1000, **more}}


def write(path, lines):
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")
    return str(path)


def test_mixed_event_file(spark, tmp_path):
    path = write(tmp_path / "eve.json", [
        flow(5, 3, start="2026-03-25T10:00:00.000000+00:00", end="2026-03-25T10:00:02.000000+00:00", age=2),
        {"event_type": "alert", "alert": {"signature": "test"}}, "not json {", flow(1, 0, age=0)])
    events = eve.src_eve_batch(spark, path)
    bad = events.where(F.col("_corrupt_record").isNotNull() & F.col("event_type").isNull())
    assert bad.select("event_type", "_corrupt_record").collect()[0][1] == "not json {"
    flows = eve.flow_records(eve.good_lines(events))
    stats = R.extraction_stats(flows, 2).first()
    assert (stats.total_processed, stats.successful, stats.skipped_no_packets) == (2, 1, 1)
    assert R.eve_features_25(R.min_packets_filter(flows, 2)).count() == 1


def test_stats_count_corrupt_lines(spark, tmp_path):
    path = write(tmp_path / "eve.json", [flow(5, 3, age=1), "broken", flow(2, 2, age=1)])
    events = eve.src_eve_batch(spark, path)
    flat = events.select("flow.*", "_corrupt_record").withColumns(
        {"start_us": F.lit(0), "end_us": F.lit(0)})
    s = R.extraction_stats(flat, 2, corrupt="_corrupt_record").first()
    assert (s.total_processed, s.skipped_parse_error, s.successful) == (2, 1, 2)


def test_max_records(spark, tmp_path):
    path = write(tmp_path / "eve.json", [flow(5, 5, age=1)] * 10)
    features = R.eve_features_25(eve.flow_records(eve.src_eve_batch(spark, path)))
    assert R.max_records_limit(features, 3).count() == 3


def test_alert_scan_skips_incomplete_events(spark, tmp_path):
    good = {"timestamp": "2026-03-31T18:45:57.973895-0700", "event_type": "alert", "src_ip": "a", "dest_ip": "b",
            "alert": {"signature_id": 1, "severity": 1, "signature": "s"}}
    path = write(tmp_path / "eve.json", [good, "x", {**good, "timestamp": "never"}, {**good, "alert": {"severity": 1}},
                                         {"event_type": "dns"}])
    alerts = eve.src_eve_alerts(spark, path)
    assert alerts.count() == 1
    assert alerts.select(F.unix_micros("ts")).first()[0] == 1775007957973895


def test_ids_record(spark, tmp_path):
    path = write(tmp_path / "eve.json", [
        {"timestamp": "t", "event_type": "alert", "src_ip": "a", "src_port": 1, "dest_ip": "b", "dest_port": 2, "proto": "TCP",
         "community_id": "c", "alert": {"severity": 2, "signature": "s", "signature_id": 9, "category": "k"}}, flow(1, 1)])
    out = rows(ids_alerts.ids_alert_record(eve.src_eve_batch(spark, path)))
    assert out == [("t", "ids_alert", 2, "s", 9, "k", "a", 1, "b", 2, "TCP", "c")]


def test_flow_table_prefers_parquet_and_merges_shards(spark, tmp_path):
    spark.createDataFrame([(1.0, "BENIGN")], "a double, Label string").write.parquet(str(tmp_path / "train-0.parquet"))
    spark.createDataFrame([(2.0, 3.0, "DoS")], "a double, b double, Label string").write.parquet(
        str(tmp_path / "train-1.parquet"))
    (tmp_path / "x.csv").write_text("a,Label\n9,DoS\n")
    got = tables.src_flow_table(spark, str(tmp_path))
    assert sorted(r.a for r in got.collect()) == [1.0, 2.0] and set(got.columns) == {"a", "b", "Label"}


def test_flow_table_csv(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "one.csv").write_text(" a, Label\n1.5,BENIGN\nInfinity,DoS\n")
    (tmp_path / "raw" / "two.csv").write_text(" a, Label\n2.5,DoS\n")
    got = tables.src_flow_table(spark, str(tmp_path), features=["a"])
    assert sorted(r[0] for r in got.collect()) == [1.5, 2.5, float("inf")]
    with pytest.raises(FileNotFoundError):
        tables.src_flow_table(spark, str(tmp_path / "none"))


def test_flow_table_columns_meet_by_name(spark, tmp_path):
    csv, shards = tmp_path / "csv", tmp_path / "shards"
    csv.mkdir()
    (csv / "one.csv").write_text("a,b,Label\n1,2,x\n")
    (csv / "two.csv").write_text("b, a,Label\n3.5,4,y\n")
    (csv / "three.csv").write_text("Label,a\nz,5\n")
    want = [("x", 1.0, 2.0), ("y", 4.0, 3.5), ("z", 5.0, None)]
    for features in (["a", "b"], None):
        got = tables.src_flow_table(spark, str(csv), features)
        assert rows(got.select("Label", F.col("a").cast("double"), "b")) == want
    spark.createDataFrame([(1, "x")], "a long, Label string").coalesce(1).write.parquet(str(shards / "train-0.parquet"))
    spark.createDataFrame([(2.5, "y")], "a double, Label string").coalesce(1).write.parquet(str(shards / "train-1.parquet"))
    assert rows(tables.src_flow_table(spark, str(shards)).select("Label", "a")) == [("x", 1.0), ("y", 2.5)]


def test_dimension_files(spark, tmp_path):
    good = tmp_path / "scaler.json"
    good.write_text(json.dumps({"mean": [1.0] * 25, "scale": [2.0] * 25, "features": K.FEATURES_25}))
    assert tables.load_scaler(spark, str(good)).scale == [2.0] * 25
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"mean": [1.0] * 25, "scale": [2.0] * 25, "features": K.FEATURES_25[::-1]}))
    with pytest.raises(ValueError, match="mismatch"):
        tables.load_scaler(spark, str(bad))
    rules = tmp_path / "allow.json"
    rules.write_text(json.dumps({"_comment": "x", "rules": [
        {"name": "dns", "description": "d", "dst_port": 53}, {"name": "ntp", "dst_port": 123}]}, indent=1))
    assert tables.load_allowlist(spark, str(rules)) == [{"name": "dns", "dst_port": 53}, {"name": "ntp", "dst_port": 123}]
    assert tables.load_allowlist(spark, str(tmp_path / "missing.json")) == []


def test_threshold_file(spark, tmp_path):
    path = write(tmp_path / "threshold.config", [
        "# comment suppress sig_id 5", "suppress gen_id 1, sig_id 11", "suppress gen_id 1, sig_id 12", "",
        "threshold gen_id 1, sig_id 13, type limit, track by_src, count 5, seconds 60"])
    assert rows(tables.sid_suppress_config(spark, path)) == [(11,), (12,)]
    assert tables.sid_limit_config(spark, path) == [(13, 5, 60)]


def test_notify_log(spark, tmp_path):
    path = write(tmp_path / "n.log", ["2026-01-01 07:00:00 message sent (3 chars)", "2026-01-01 07:00:00 nothing new",
                                      "2025-12-31 22:59:59 message sent", "garbage sent", "2026-01-01 00:00:00 sent"])
    assert tables.notify_log_scan(spark, path, datetime(2026, 1, 1, 7)) == 2
    assert tables.notify_log_scan(spark, str(tmp_path / "no.log"), datetime(2026, 1, 1, 7)) == 0


def lesson(spark, **over):
    base = dict(lesson_id="a", ord=1, status="pending", source="reviewer", promotion_count=1, promotion_threshold=3,
                rule_id="510", agent="pi0", log_keywords=["foo", "bar"], severity="noise", action="log", reason="r",
                created_at="2026-01-01T00:00:00Z", last_seen_at="2026-01-01T00:00:00Z", last_promoted_at=None, hits=0)
    flat = store.flatten_lessons(spark.createDataFrame([], schemas.LESSON)).schema
    row = {**base, **over}
    return spark.createDataFrame([tuple(row[c] for c in L.COLUMNS)], flat)


def test_lesson_store_round_trip_and_versions(spark, tmp_path):
    root = str(tmp_path / "lessons")
    assert store.src_lessons(spark, root).count() == 0
    store.save_lessons(lesson(spark), root)
    again = store.src_lessons(spark, root)
    assert again.first().asDict() == lesson(spark).first().asDict()
    # read and replace in one job, the old version stays readable until the new one is complete
    for hits in (1, 2, 3):
        store.save_lessons(store.src_lessons(spark, root).withColumn("hits", F.lit(hits).cast("long")), root)
    assert store.src_lessons(spark, root).first().hits == 3
    # an unfinished version is ignored
    (tmp_path / "lessons" / "version=99").mkdir()
    assert store.src_lessons(spark, root).first().hits == 3


def test_two_writers_of_a_lesson_store_lose_no_change(spark, tmp_path):
    root, calls = str(tmp_path / "lessons"), []
    store.save_lessons(lesson(spark, lesson_id="first"), root)

    def add(name):
        return lambda lessons: lessons.unionByName(lesson(spark, lesson_id=name))

    def interrupted(lessons):  # another writer commits after this one has read
        calls.append(lessons.count())
        if len(calls) < 3:
            store.update_lessons(spark, root, add(f"other{len(calls)}"))
        return add("own")(lessons)
    assert store.update_lessons(spark, root, interrupted) == 4 and calls == [1, 2, 3]
    assert sorted(r.lesson_id for r in store.src_lessons(spark, root).collect()) == ["first", "other1", "other2", "own"]
    assert sorted(p.name for p in (tmp_path / "lessons").iterdir()) == ["version=3", "version=4"]  # nothing staged stays

    def always(lessons):
        store.save_lessons(lessons, root)
        return add("never")(lessons)
    with pytest.raises(store.StoreConflict):
        store.update_lessons(spark, root, always, attempts=2)
    with pytest.raises(store.StoreConflict):
        store.save_lessons(lesson(spark), root, base=1)
    assert store.src_lessons(spark, root).count() == 4


def test_writers_side_by_side(spark, tmp_path):
    root = str(tmp_path / "lessons")
    store.save_lessons(lesson(spark, hits=0), root)

    def hit(_):
        return store.update_lessons(spark, root, lambda lessons: lessons.withColumn("hits", F.col("hits") + 1), attempts=40)
    with ThreadPoolExecutor(3) as pool:
        numbers = list(pool.map(hit, range(6)))
    assert sorted(numbers) == list(range(2, 8)) and store.src_lessons(spark, root).first().hits == 6


def test_batch_of_a_store_is_applied_once(spark, tmp_path):
    root = str(tmp_path / "lessons")
    more = lambda lessons: lessons.withColumn("hits", F.col("hits") + 1)
    assert store.applied_batch(spark, root) == -1
    store.save_lessons(lesson(spark, hits=0), root)
    for batch in (0, 0, 1, 0, None, 1):  # a version without a batch of its own takes over the number
        store.update_lessons(spark, root, more, batch)
    assert store.src_lessons(spark, root).first().hits == 3 and store.applied_batch(spark, root) == 1
    older = str(tmp_path / "older")  # a store of the form before
    for name in ("version=1", "version=2-batch-7"):
        store.nest_lessons(lesson(spark, hits=0)).write.json(f"{older}/{name}")
    assert store.applied_batch(spark, older) == 7 and store.update_lessons(spark, older, more, 8) == 3
    assert store.applied_batch(spark, older) == 8 and store.src_lessons(spark, older).first().hits == 1


def test_reader_whose_version_is_removed_begins_again(spark, tmp_path):
    root, calls = str(tmp_path / "lessons"), []
    store.save_lessons(lesson(spark, hits=0), root)

    def late(lessons):
        if not calls:
            for _ in range(3):  # the version that has been read is removed before it is computed with
                store.update_lessons(spark, root, lambda x: x.withColumn("hits", F.col("hits") + 1))
        calls.append(1)
        return lessons.withColumn("hits", F.col("hits") + 10)
    assert store.update_lessons(spark, root, late) == 5 and len(calls) == 2
    assert store.src_lessons(spark, root).first().hits == 13
    assert sorted(p.name for p in (tmp_path / "lessons").iterdir()) == ["version=4", "version=5"]


def test_lesson_file_skips_corrupt_lines(spark, tmp_path):
    path = write(tmp_path / "lessons.jsonl", [{"lesson_id": "a", "status": "pending", "promotion_count": 1},
                                              "this is not json", {"lesson_id": "b", "status": "pending"}])
    got = store.src_lesson_file(spark, path).orderBy("ord").select("lesson_id").collect()
    assert [r.lesson_id for r in got] == ["a", "b"]
    assert store.src_lesson_file(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_artifacts_and_marks(spark, tmp_path):
    root = str(tmp_path / "art")
    store.save_prep_artifacts(spark, root, ["BENIGN", "DoS"], Scaler(["x", "y"], [1.0, 2.0], [3.0, 4.0]))
    assert store.load_prep_artifacts(spark, root) == (["BENIGN", "DoS"], Scaler(["x", "y"], [1.0, 2.0], [3.0, 4.0]))
    marks = str(tmp_path / "marks")
    assert store.load_mark(spark, marks) == {}
    store.save_mark(spark, marks, last_alert_id="7")
    assert store.load_mark(spark, marks) == {"last_alert_id": "7"}


def test_append_keeps_earlier_lines(spark, tmp_path):
    path = str(tmp_path / "log")
    for i in (1, 2):
        store.append_json(spark.createDataFrame([(i,)], "n int"), path)
    assert rows(spark.read.schema("n int").json(path)) == [(1,), (2,)]
    once = store.append_once(str(tmp_path / "once"))
    for _ in range(2):
        once(spark.createDataFrame([(5,)], "n int"), 0)
    assert rows(spark.read.schema("n int").json(str(tmp_path / "once" / "batch=0"))) == [(5,)]
