from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from test_sources import lesson
from wirelens.functions.text import normalize_action, normalize_severity, normalize_ws
from wirelens.operators import lessons as L, triage as T

NOW = datetime(2026, 6, 1)
ALERT = "id string, rule_id string, agent string, full_log string, level int, model_text string"


def alert(spark, log, rule="510", agent="pi0", level=10, model=None):
    return spark.createDataFrame([("1", rule, agent, log, level, model)], ALERT)


def matches(spark, log, store, status="authoritative", **where):
    return L.lesson_match(alert(spark, log, **where), store, status).first().lesson is not None


@pytest.fixture(scope="module")
def trojan(spark):
    return lesson(spark, status="authoritative", log_keywords=["trojaned version", "generic"])


def test_lesson_matching(spark, trojan):
    log = "Trojaned version of file '/bin/echo' detected. Signature: bash (Generic)."
    assert matches(spark, log, trojan) and matches(spark, log.upper(), trojan)
    assert not matches(spark, log, trojan, agent="pi1") and not matches(spark, log, trojan, rule="999")
    assert not matches(spark, "some other event", trojan) and not matches(spark, "Trojaned version of file", trojan)
    pending = lesson(spark, log_keywords=["trojaned version"])
    assert not matches(spark, log, pending) and matches(spark, log, pending, status=None)
    assert matches(spark, "anything", lesson(spark, status="authoritative", log_keywords=[]))
    nothing = lesson(spark, status="authoritative", rule_id=None, agent=None, log_keywords=None)
    assert matches(spark, "x", nothing, rule=None, agent=None) and not matches(spark, "x", nothing)


def test_whitespace_in_log_and_keyword(spark):
    store = lesson(spark, status="authoritative", rule_id="533", log_keywords=["netstat listening ports", "tcp6 0 0 :::2049"])
    log = "ossec: output: 'netstat listening ports':\ntcp6       0      0 :::2049                 :::*"
    assert matches(spark, log, store, rule="533")
    tabs = lesson(spark, status="authoritative", rule_id="533", log_keywords=["tcp6\t0\t0\t:::2049"])
    assert matches(spark, "tcp6 0 0 :::2049 LISTEN", tabs, rule="533")
    wide = spark.createDataFrame([("a  b　 ",)], "t string")
    assert wide.select(normalize_ws(F.col("t"))).first()[0] == "a b"


def test_first_lesson_of_a_long_pattern_group(spark):
    store = lesson(spark, lesson_id="x0", ord=0, status="authoritative", log_keywords=["absent"])
    store = store.unionByName(store.crossJoin(spark.range(1, 700)).withColumns({
        "ord": F.col("id"), "lesson_id": F.concat(F.lit("x"), "id"),
        "log_keywords": F.array(F.concat(F.lit("w"), "id"))}).drop("id"))
    logs = [("1", "510", "w7 w5 w8"), ("2", "510", "none"), ("3", "511", "w5"), (None, "510", "w650 x"), ("1", "510", "quiet"),
            ("1", "510", "w7 w5 w8"), ("4", "510", None), ("5", None, "w5")]
    alerts = spark.createDataFrame([(i, rule, "pi0", log, 1, None) for i, rule, log in logs], ALERT)
    got = L.lesson_match(alerts, store)
    assert rows(got.select("id", "full_log", "lesson.lesson_id")) == rows(spark.createDataFrame(
        [("1", "w7 w5 w8", "x5"), ("2", "none", None), ("3", "w5", None), (None, "w650 x", "x6"), ("1", "quiet", None),
         ("1", "w7 w5 w8", "x5"), ("4", None, None), ("5", "w5", None)], "a string, b string, c string"))


def test_lesson_match_against_brute_force(spark, monkeypatch):
    words = ["a", "ab", "abc", "abcd", "xabcdy", "café", "日本語", "日本語テキスト", "net stat", "one two three", "two  Three four",
             " ab ", "", "ee tw", "𝒳𝒴𝒵𝒲 end", "c d"]
    patterns = [[w] for w in words] + [[words[i], words[(i * 7 + 3) % len(words)]] for i in range(len(words))]
    logs = [None, "", "x", "one two three four", "netstat net  stat", "zabcdz", "XABCDY ab", "日本語テキスト", "café ab", "abc\td",
            "𝒳𝒴𝒵𝒲 end", "abc d e"] + words
    store = lesson(spark).limit(0)
    one = lesson(spark, status="authoritative").drop("ord", "lesson_id", "log_keywords")
    listed = spark.createDataFrame([(i, f"{i}", p) for i, p in enumerate(reversed(patterns))],
                                   "ord long, lesson_id string, log_keywords array<string>")
    store = store.unionByName(one.crossJoin(listed))
    store = store.where("lesson_id <> '19'")  # the pattern without a keyword would hide later ones
    held = {int(r.lesson_id): r.log_keywords for r in store.collect()}
    alerts = spark.createDataFrame([(f"{i}", "510", "pi0", log, 1, None) for i, log in enumerate(logs)], ALERT)

    def flat(t):
        return " ".join((t or "").split()).lower()
    want = [min((k for k, p in held.items() if all(flat(w) in flat(log) for w in p)), default=None) for log in logs]
    got = {int(r.id): r.lesson and int(r.lesson.lesson_id) for r in L.lesson_match(alerts, store).collect()}
    assert got == dict(enumerate(want)) and len(set(want)) > 8
    monkeypatch.setattr(L, "LOG_BYTES", 300)  # logs of one rule over several tasks, its store in several parts
    monkeypatch.setattr(L, "WORD_BYTES", 40)
    assert {int(r.id): r.lesson and int(r.lesson.lesson_id) for r in L.lesson_match(alerts, store).collect()} == got


def lesson_ids(spark, *patterns):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(patterns)],
                               "i int, rule_id string, agent string, log_keywords array<string>, severity string, action string")
    return [r[0] for r in df.orderBy("i").select(L.lesson_id()).collect()]


def test_lesson_id(spark):
    a, b, c, d, e = lesson_ids(
        spark, ("510", "pi0", ["foo", "bar"], "noise", "log"), ("510", "pi0", ["BAR", " Foo"], "noise", "log"),
        ("511", "pi0", ["foo", "bar"], "noise", "log"), ("510", "pi0", ["foo", "bar"], "high", "investigate"),
        (None, None, None, None, None))
    assert a == b and len({a, c, d, e}) == 4 and len(a) == 16
    import hashlib
    assert a == hashlib.sha1(b"510|pi0|bar,foo|noise|log").hexdigest()[:16]
    assert e == hashlib.sha1(b"||||").hexdigest()[:16]


def observed(spark, *verdicts):
    return spark.createDataFrame([(i, "510", "pi0", ["foo"], s, a, "test") for i, (s, a) in enumerate(verdicts)],
                                 "seq long, rule_id string, agent string, log_keywords array<string>, severity string, "
                                 "action string, reason string")


def test_ingest_and_promote(spark):
    empty = lesson(spark).limit(0)
    one = L.lesson_ingest(empty, observed(spark, *[("noise", "log")] * 3), NOW)
    r = one.first()
    assert one.count() == 1 and (r.status, r.promotion_count, r.hits) == ("pending", 3, 0)
    two = L.lesson_ingest(one, observed(spark, ("noise", "log"), ("high", "investigate")), NOW)
    assert sorted(r.promotion_count for r in two.collect()) == [1, 4]
    assert two.where("ord is null").count() == 0
    store = lesson(spark, lesson_id="a", promotion_count=3).unionByName(lesson(spark, lesson_id="b", promotion_count=2)) \
        .unionByName(lesson(spark, lesson_id="c", promotion_count=5)) \
        .unionByName(lesson(spark, lesson_id="d", promotion_count=10, status="authoritative"))
    promoted = {r.lesson_id: r for r in L.lesson_promote(store, NOW).collect()}
    assert [promoted[k].status for k in "abcd"] == ["authoritative", "pending", "authoritative", "authoritative"]
    assert promoted["a"].last_promoted_at == "2026-06-01T00:00:00Z" and promoted["d"].last_promoted_at is None


def test_prune(spark):
    old, new = "2020-01-01T00:00:00Z", "2099-01-01T00:00:00Z"
    cases = [("pending", old, 0), ("pending", new, 0), ("authoritative", old, 0), ("authoritative", old, 5)]
    store = lesson(spark).limit(0)
    for i, (status, seen, hits) in enumerate(cases):
        store = store.unionByName(lesson(spark, lesson_id=str(i), status=status, last_seen_at=seen, hits=hits))
    store = store.unionByName(lesson(spark, lesson_id="4", last_seen_at="", created_at=new))
    assert rows(L.lesson_prune(store, NOW).select("lesson_id")) == [("1",), ("3",), ("4",)]


def test_prefix_commands(spark):
    store = lesson(spark, lesson_id="abcd1").unionByName(lesson(spark, lesson_id="abxx2"))
    assert L.lesson_find_prefix(store, "abc").first().lesson_id == "abcd1"
    for prefix in ("ab", "zz"):
        with pytest.raises(LookupError):
            L.lesson_find_prefix(store, prefix)
    assert rows(L.lesson_reject(store, "abx").select("lesson_id")) == [("abcd1",)]
    assert L.lesson_manual_promote(store, "abx", NOW).where("status = 'authoritative'").count() == 1
    bad = observed(spark, ("terrible", "log"))
    with pytest.raises(ValueError, match="invalid"):
        L.lesson_add(store, bad, NOW)
    added = L.lesson_add(store, observed(spark, (" High", "ESCALATE ")), NOW).where("source = 'operator'").first()
    assert (added.status, added.severity, added.action) == ("authoritative", "high", "escalate")


def test_vocabulary(spark):
    words = spark.createDataFrame([("HIGH",), ("[critical]",), ("noise!",), ("root",), ("",), (None,)], "t string")
    assert [r[0] for r in words.select(normalize_severity(F.col("t"))).collect()] == ["high", "critical", "noise", None, None, None]
    words = spark.createDataFrame([("Investigate",), ("ESCALATE NOW",), ("execute",), (None,), ("catalog",)], "t string")
    assert [r[0] for r in words.select(normalize_action(F.col("t"))).collect()] == ["investigate", "escalate", None, None, "log"]


def test_coherence(spark):
    cases = [("noise", "investigate", "ignore", True), ("critical", "log", "escalate", True), ("low", "escalate", "log", True),
             ("low", "ignore", "ignore", False), ("high", "ignore", "investigate", True),
             ("medium", "investigate", "investigate", False), ("high", "escalate", "escalate", False),
             ("critical", "escalate", "escalate", False)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s string, a string, want string, fixed boolean")
    got = df.select("i", "want", "fixed", T.enforce_coherence(F.col("s"), F.col("a")).alias("v"))
    assert got.where("v.action <> want or v.corrected <> fixed").count() == 0


def test_levels(spark):
    levels = spark.createDataFrame([(None,), (0,), (3,), (6,), (9,), (15,), (16,)], "l int")
    got = [tuple(r) for r in levels.select(T.level_severity(F.col("l")), T.level_action(F.col("l"))).collect()]
    assert got == [("noise", "ignore"), ("noise", "ignore"), ("low", "ignore"), ("medium", "log"), ("high", "escalate"),
                   ("critical", "escalate"), ("low", "escalate")]


def test_cascade(spark, trojan):
    def judge(df, **kw):
        r = T.classify_cascade(df, trojan, **kw).first()
        return r.classifier, r.severity, r.action
    text = "some text\n severity : High | x\nACTION: investigate"
    assert judge(alert(spark, "trojaned version generic", model=text)) == ("lesson-cache", "noise", "ignore")
    assert judge(alert(spark, "x", model=text)) == ("model", "high", "investigate")
    assert judge(alert(spark, "x", model=text), model_up=False) == ("fallback-health", "high", "escalate")
    assert judge(alert(spark, "x")) == ("fallback-error", "high", "escalate")
    assert judge(alert(spark, "x", model="SEVERITY: odd")) == ("fallback-parse", "high", "escalate")
    assert judge(alert(spark, "x", level=16)) == ("fallback-error", "low", "log")


def test_model_is_asked_on_misses_only(spark, trojan):
    both = alert(spark, "trojaned version generic").drop("model_text").unionByName(alert(spark, "x").drop("model_text"))
    asked = []

    def ask(misses):
        asked.extend(r.full_log for r in misses.collect())
        return misses.withColumn("model_text", F.lit("SEVERITY: low\nACTION: log"))
    got = T.classify_cascade(both, trojan, ask=ask)
    assert rows(got.select("full_log", "classifier")) == [("trojaned version generic", "lesson-cache"), ("x", "model")]
    assert asked == ["x"]


def test_watermarks(spark):
    df = spark.createDataFrame([(f"{i:03d}",) for i in range(30)], "id string")
    assert rows(T.new_since_id(df, "004", 10)) == [(f"{i:03d}",) for i in range(5, 15)]
    assert rows(T.new_since_id(df, None, 3)) == [("027",), ("028",), ("029",)]
    assert T.advance_watermark(T.new_since_id(df, "004", 10), "id", "004").first().mark == "014"
    assert T.new_since_id(df, "004").count() == 25 and T.new_since_id(df, None).count() == 30
    assert T.advance_watermark(df.limit(0), "id", "004").first().mark == "004"


def test_review_answers(spark):
    answer = '{"alert_id":"1","correct_severity":"High","correct_action":"log","log_keywords":["A ","b","c","d"],"reason":"r"}'
    texts = [f"[{answer}]", f'{{"results":[{answer},{answer}]}}', f'{{"verifications":3,"items":[{answer}]}}',
             '{"x":[]}', "nope", '{"alerts":{}}', ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    got = T.parse_review_json(df, keep=["i"])
    assert rows(got.select("i", "place")) == [(0, 0), (1, 0), (1, 1), (2, 0)]
    entries = T.queue_entries(T.classify_cascade(
        alert(spark, "x").withColumns({"ts": F.lit("t"), "description": F.lit("d")}), lesson(spark).limit(0)),
        F.lit("2026-01-01T00:00:00Z"))
    found = T.review_disagreements(got.where("i = 0"), entries).first()
    assert (found.log_keywords, found.severity, found.action, found.rule_id) == (["a", "b", "c", "d"], "high", "log", "510")
    assert T.review_disagreements(got.where("i = 0"), entries, most_words=3).first().log_keywords == ["a", "b", "c"]
    agree = got.where("i = 0").withColumn("correct_action", F.lit("escalate"))
    assert T.review_disagreements(agree, entries).count() == 0
