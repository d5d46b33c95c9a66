"""Host-alert triage and the lesson store."""

from datetime import timedelta

from pyspark.sql import functions as F

from wirelens import constants as K, schemas
from wirelens.catalog.registry import oracle, query
from wirelens.functions.text import normalize_action, normalize_severity, normalize_ws
from wirelens.functions.time import iso_utc
from wirelens.operators import lessons as L, triage as T
from wirelens.session import cut_lineage
from wirelens.sources import views

V = ["v_hids", "v_lessons"]


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


# --- inputs --------------------------------------------------------------------
def _hids(spark, sf):
    return views.hids(spark, sf)


def _store(spark, sf):
    """The learned store in the full flat form."""
    base = views.lessons(spark, sf)
    seen = iso_utc(F.col("last_seen"))
    return base.withColumns({
        "lesson_id": L.lesson_id(), "source": F.when(F.col("hits") > 1, "operator").otherwise("reviewer"),
        "reason": F.lit("seen"), "created_at": seen, "last_seen_at": seen,
        "last_promoted_at": F.lit(None).cast("string")}).select(*L.COLUMNS)


def _judged(spark, sf):
    return T.classify_cascade(_hids(spark, sf), _store(spark, sf))


def _queue(spark, sf):
    return T.queue_entries(_judged(spark, sf).withColumn("ts", iso_utc(F.col("ts"))), F.col("ts"))


def sha_id(rule, agent, kw, sev, act):
    return f"""substr(sha1(coalesce({rule}, '') || '|' || coalesce({agent}, '') || '|' ||
 list_aggregate(list_sort([lower(trim(regexp_replace(x, '\\s+', ' ', 'g'))) FOR x IN {kw}]), 'string_agg', ',')
 || '|' || coalesce({sev}, '') || '|' || coalesce({act}, '')), 1, 16)"""


ISO = "strftime({}, '%Y-%m-%dT%H:%M:%SZ')"
LEVEL_SEV = "CASE WHEN {0} <= 2 THEN 'noise' WHEN {0} <= 5 THEN 'low' WHEN {0} <= 8 THEN 'medium' " \
            "WHEN {0} <= 11 THEN 'high' WHEN {0} <= 15 THEN 'critical' ELSE 'low' END"
LEVEL_ACT = "CASE WHEN {0} >= 9 THEN 'escalate' WHEN {0} >= 7 THEN 'investigate' WHEN {0} >= 4 THEN 'log' ELSE 'ignore' END"


def vocab(x, words):
    return "CASE " + " ".join(f"WHEN contains(lower({x}), '{w}') THEN '{w}'" for w in words) + " END"


SEV_LINE = "regexp_extract(model_text, '(?im)^\\s*SEVERITY\\s*:\\s*(.+?)(?:\\n|$|\\|)', 1)"
ACT_LINE = "regexp_extract(model_text, '(?im)^\\s*ACTION\\s*:\\s*(.+?)(?:\\n|$|\\|)', 1)"
COHERENT = """CASE WHEN {s} = 'noise' THEN 'ignore' WHEN {s} = 'critical' THEN 'escalate'
 WHEN {s} = 'low' AND {a} NOT IN ('log', 'ignore') THEN 'log' WHEN {s} = 'high' AND {a} = 'ignore' THEN 'investigate'
 ELSE {a} END"""

CTES = {
    "store": f"""SELECT {sha_id('rule_id', 'agent', 'log_keywords', 'severity', 'action')} AS lesson_id, ord, status,
 CASE WHEN hits > 1 THEN 'operator' ELSE 'reviewer' END AS source, promotion_count, promotion_threshold, rule_id, agent,
 log_keywords, severity, action, 'seen' AS reason, {ISO.format('last_seen')} AS created_at,
 {ISO.format('last_seen')} AS last_seen_at, CAST(NULL AS VARCHAR) AS last_promoted_at, hits FROM v_lessons""",
    "matched": """SELECT id, min(ord) AS ord FROM (SELECT *, trim(lower(regexp_replace(full_log, '\\s+', ' ', 'g'))) AS lg
 FROM v_hids) h JOIN store s ON s.rule_id = h.rule_id AND s.agent = h.agent AND s.status = 'authoritative'
 AND contains(lg, s.log_keywords[1]) AND contains(lg, s.log_keywords[2]) GROUP BY id""",
    "raw_verdict": f"""SELECT h.*, s.lesson_id, s.severity AS l_sev, s.action AS l_act,
 {vocab(SEV_LINE, K.SEVERITIES)} AS m_sev, {vocab(ACT_LINE, K.ACTIONS)} AS m_act
 FROM v_hids h LEFT JOIN matched m USING (id) LEFT JOIN store s ON s.ord = m.ord""",
    "first_verdict": f"""SELECT *, CASE WHEN lesson_id IS NOT NULL THEN 'lesson-cache' WHEN model_text IS NULL THEN 'fallback-error'
  WHEN m_sev IS NOT NULL AND m_act IS NOT NULL THEN 'model' ELSE 'fallback-parse' END AS classifier,
 CASE WHEN lesson_id IS NOT NULL THEN l_sev WHEN m_sev IS NOT NULL AND m_act IS NOT NULL THEN m_sev
  ELSE {LEVEL_SEV.format('level')} END AS severity,
 CASE WHEN lesson_id IS NOT NULL THEN l_act WHEN m_sev IS NOT NULL AND m_act IS NOT NULL THEN m_act
  ELSE {LEVEL_ACT.format('level')} END AS first_action FROM raw_verdict""",
    "judged": f"""SELECT *, {COHERENT.format(s='severity', a='first_action')} AS action,
 {ISO.format('ts')} AS queued_at FROM first_verdict""",
    "relevant": """SELECT * FROM judged WHERE severity IN ('critical', 'high', 'medium')
 OR action IN ('escalate', 'investigate')""",
}
SINCE = "2024-01-20T00:00:00Z"


def sql(name, body, views_=V, extra=None):
    oracle(name, views_, body, {**CTES, **(extra or {})})


# --- alerts ---------------------------------------------------------------------
@query("compact_alert")
def _(spark, sf):
    h = _hids(spark, sf)
    raw = F.to_json(F.struct(
        "id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSXX").alias("timestamp"),
        F.struct("level", F.col("rule_id").alias("id"), "description",
                 F.when(F.col("k") % 2 == 0, F.array(F.lit("ossec"), F.lit("rootcheck"))).alias("groups")).alias("rule"),
        F.struct(F.col("agent").alias("name")).alias("agent"), F.repeat("full_log", 20).alias("full_log"),
        F.when(F.col("k") % 3 == 0, F.create_map(F.lit("srcip"), F.lit("10.0.0.1"), F.lit("other"), F.lit("x"))).alias("data")))
    parsed = h.select(F.from_json(raw, schemas.HIDS_ALERT).alias("a")).select("a.*")
    c = T.compact_alert(parsed)
    return c.select("id", "ts", "level", "rule_id", "description", F.size("groups").alias("groups"), "agent", "full_log",
                    "srcip", "user")


sql("compact_alert", """SELECT id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, level, rule_id, description,
 CASE WHEN k % 2 = 0 THEN 2 ELSE 0 END AS groups, agent, repeat(full_log, 20) AS full_log,
 CASE WHEN k % 3 = 0 THEN '10.0.0.1' END AS srcip, CAST(NULL AS VARCHAR) AS "user" FROM v_hids""")


@query("new_since_id")
def _(spark, sf):
    return T.new_since_id(_hids(spark, sf), "000000000123").select("id", "rule_id")


sql("new_since_id", "SELECT id, rule_id FROM v_hids WHERE id > '000000000123'")


@query("advance_watermark")
def _(spark, sf):
    return T.advance_watermark(T.new_since_id(_hids(spark, sf), "000000000123"), "id", "000000000123")


sql("advance_watermark", """SELECT max(id) AS mark FROM v_hids WHERE id > '000000000123' """)


@query("normalize_ws")
def _(spark, sf):
    docs = views.table(spark, sf, "documents")
    text = normalize_ws(F.col("text"))
    return docs.select("doc_id", F.md5(text).alias("digest"), F.length(text).alias("chars"))


# spelled-out Unicode white space: RE2's \s is ASCII only
_WS = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
oracle("normalize_ws", [], f"""SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INT) AS chars
 FROM (SELECT doc_id, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM documents)""")


@query("normalize_severity")
def _(spark, sf):
    token = F.when(F.col("k") % 5 == 0, "[CRITICAL]").otherwise(F.element_at(F.split("model_text", "\n"), 1))
    return _hids(spark, sf).select("id", normalize_severity(token).alias("severity"))


sql("normalize_severity", f"""SELECT id, {vocab("t", K.SEVERITIES)} AS severity FROM (SELECT id,
 CASE WHEN k % 5 = 0 THEN '[CRITICAL]' ELSE split_part(model_text, chr(10), 1) END AS t FROM v_hids)""")


@query("normalize_action")
def _(spark, sf):
    token = F.when(F.col("k") % 5 == 0, "catalog of items").when(F.col("k") % 5 == 1, "Investigate!") \
        .otherwise(F.col("model_text"))
    return _hids(spark, sf).select("id", normalize_action(token).alias("action"))


sql("normalize_action", f"""SELECT id, {vocab("t", K.ACTIONS)} AS action FROM (SELECT id, CASE k % 5
 WHEN 0 THEN 'catalog of items' WHEN 1 THEN 'Investigate!' ELSE model_text END AS t FROM v_hids)""")


@query("level_fallback")
def _(spark, sf):
    return _hids(spark, sf).select("id", T.level_severity(F.col("level")).alias("severity"),
                                   T.level_action(F.col("level")).alias("action"))


sql("level_fallback", f"""SELECT id, {LEVEL_SEV.format('level')} AS severity, {LEVEL_ACT.format('level')} AS action
 FROM v_hids""")


@query("parse_verdict_text")
def _(spark, sf):
    return _hids(spark, sf).select("id", T.verdict_severity(F.col("model_text")).alias("severity"),
                                   T.verdict_action(F.col("model_text")).alias("action"))


sql("parse_verdict_text", "SELECT id, m_sev AS severity, m_act AS action FROM raw_verdict")


@query("enforce_coherence")
def _(spark, sf):
    h = _hids(spark, sf)
    words = [F.element_at(F.array(*[F.lit(w) for w in vocab_]), (F.col("k") % n + 1).cast("int"))
             for vocab_, n in ((K.SEVERITIES, 5), (K.ACTIONS, 4))]
    fixed = h.select("id", T.enforce_coherence(*words).alias("v"))
    return fixed.select("id", "v.severity", "v.action", F.col("v.corrected").cast("int").alias("corrected"))


sql("enforce_coherence", f"""SELECT id, s AS severity, f AS action, CASE WHEN f = a THEN 0 ELSE 1 END AS corrected FROM (
 SELECT *, {COHERENT.format(s='s', a='a')} AS f FROM (SELECT id, [{quoted(K.SEVERITIES)}][k % 5 + 1] AS s,
 [{quoted(K.ACTIONS)}][k % 4 + 1] AS a FROM v_hids))""")


@query("lesson_match")
def _(spark, sf):
    return L.lesson_match(_hids(spark, sf), _store(spark, sf)).select(
        "id", "lesson.ord", "lesson.lesson_id", "lesson.severity", "lesson.action")


sql("lesson_match", """SELECT h.id, s.ord, s.lesson_id, s.severity, s.action FROM v_hids h LEFT JOIN matched m USING (id)
 LEFT JOIN store s ON s.ord = m.ord""")


@query("lesson_match_long_text")
def _(spark, sf):
    """Whole documents as logs of four rules, every passage a lesson of each rule."""
    docs = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 4).cast("string").alias("rule_id"),
        F.lit("docs").alias("agent"), F.col("text").alias("full_log"))
    passages = views.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("ord"), F.explode(F.array(*[F.lit(str(i)) for i in range(4)])).alias("rule_id"),
        F.lit("docs").alias("agent"), F.array("text").alias("log_keywords"),
        F.lit("noise").alias("severity"), F.lit("ignore").alias("action"), F.lit("authoritative").alias("status"))
    store = passages.withColumn("lesson_id", L.lesson_id())
    return (L.lesson_match(docs, store).where(F.col("lesson").isNotNull())
            .select(F.col("id").alias("doc_id"), F.col("lesson.ord").alias("item_id"), "lesson.lesson_id"))


oracle("lesson_match_long_text", [], f"""SELECT d.doc_id, min(item_id) AS item_id,
 arg_min({sha_id('CAST(d.doc_id % 4 AS VARCHAR)', "'docs'", '[b.text]', "'noise'", "'ignore'")}, item_id) AS lesson_id
 FROM documents d JOIN benchmark b ON contains(lower(trim(regexp_replace(d.text, '\\s+', ' ', 'g'))),
 lower(trim(regexp_replace(b.text, '\\s+', ' ', 'g')))) GROUP BY d.doc_id""")


@query("classify_cascade")
def _(spark, sf):
    return _judged(spark, sf).select("id", "severity", "action", "classifier", "lesson_id",
                                     F.col("coherence_corrected").cast("int").alias("corrected"))


sql("classify_cascade", """SELECT id, severity, action, classifier, lesson_id,
 CASE WHEN action = first_action THEN 0 ELSE 1 END AS corrected FROM judged""")


@query("lesson_hits")
def _(spark, sf):
    return L.lesson_hits(_store(spark, sf), _judged(spark, sf), views.AS_OF).select("lesson_id", "hits", "last_seen_at")


sql("lesson_hits", """SELECT s.lesson_id, s.hits + coalesce(n, 0) AS hits,
 CASE WHEN n IS NULL THEN s.last_seen_at ELSE '2024-01-31T00:00:00Z' END AS last_seen_at FROM store s LEFT JOIN
 (SELECT lesson_id, count(*) AS n FROM judged WHERE lesson_id IS NOT NULL GROUP BY 1) j USING (lesson_id)""")


@query("queue_entries")
def _(spark, sf):
    return _queue(spark, sf).select("alert_id", "alert.rule_id", "alert.level", "alert.full_log", "triage.severity",
                                    "triage.classifier", "queued_at")


sql("queue_entries", """SELECT id AS alert_id, rule_id, level, full_log, severity, classifier, queued_at FROM judged""")


@query("relevant_entries")
def _(spark, sf):
    return T.relevant_entries(_queue(spark, sf), SINCE).select("alert_id", "triage.severity", "triage.action")


sql("relevant_entries", f"SELECT id AS alert_id, severity, action FROM relevant WHERE queued_at > '{SINCE}'")


@query("severity_breakdown")
def _(spark, sf):
    return T.severity_breakdown(_queue(spark, sf))


sql("severity_breakdown", "SELECT severity, count(*) AS alerts FROM judged GROUP BY severity")


@query("report_rows")
def _(spark, sf):
    return T.report_rows(T.relevant_entries(_queue(spark, sf), SINCE))


sql("report_rows", f"""SELECT 'header' AS section, '' AS alert_id, '- Alerts analyzed: **' || count(*) || '**' AS line FROM r
 UNION ALL SELECT 'header', '', '- Severity breakdown: ' || string_agg(severity || '=' || n, ', ' ORDER BY severity)
 FROM (SELECT severity, count(*) AS n FROM r GROUP BY severity)
 UNION ALL SELECT 'audit', id, '- `' || id || '` [' || severity || '/' || action || '] ' || agent || ' lvl' || level
 || ': ' || description FROM r""", extra={"r": f"SELECT * FROM relevant WHERE queued_at > '{SINCE}'"})

_ITEM = """'{"alert_id":"' || id || '","rule_id":"' || rule_id || '","agent":"' || agent || '","level":' || level
 || ',"description":"' || description || '","full_log":"' || replace(replace(full_log, chr(9), '\\t'), chr(10), '\\n')
 || '","first_severity":"' || severity || '","first_action":"' || action || '"}'"""


@query("review_items_json")
def _(spark, sf):
    items = cut_lineage(T.review_items(T.relevant_entries(_queue(spark, sf))))
    return T.review_documents(items).withColumn("json", F.md5("json"))


sql("review_items_json", f"""SELECT day, document, count(*) AS items,
 md5('[' || string_agg(item, ',' ORDER BY r) || ']') AS json FROM (
 SELECT substr(queued_at, 1, 10) AS day, {_ITEM} AS item, row_number() OVER (PARTITION BY substr(queued_at, 1, 10)
 ORDER BY queued_at, id) - 1 AS r, CAST(floor(r / 50) AS INT) AS document FROM relevant) GROUP BY day, document""")


def _responses(spark, sf):
    """Reviewer responses: one JSON text per reviewed alert, in the shapes reviewers use."""
    h = _hids(spark, sf)
    k = F.col("k")
    words = F.array(F.concat(F.lit(" K="), k.cast("string"), F.lit(" ")), F.lit("Rule"), F.lit(""), F.lit("check"), F.lit("x"))
    answer = F.to_json(F.array(F.struct(
        F.col("id").alias("alert_id"), F.when(k % 3 == 0, "High!").when(k % 3 == 1, "noise").otherwise("unsure")
        .alias("correct_severity"), F.when(k % 2 == 0, "investigate").otherwise("ignore").alias("correct_action"),
        F.when(k % 7 != 0, words).alias("log_keywords"), F.concat(F.lit("because "), k.cast("string")).alias("reason"))))
    text = (F.when(k % 6 == 0, answer).when(k % 6 == 1, F.concat(F.lit('{"verifications":'), answer, F.lit("}")))
            .when(k % 6 == 2, F.concat(F.lit('{"items":'), answer, F.lit("}")))
            .when(k % 6 == 3, F.concat(F.lit('{"verifications":"none","alerts":'), answer, F.lit("}")))
            .when(k % 6 == 4, F.concat(F.lit('{"other":'), answer, F.lit("}"))).otherwise("not json"))
    return h.select(F.col("id").alias("response_id"), text.alias("response"))


_ANSWERS = {"answers": """SELECT id AS alert_id, CASE k % 3 WHEN 0 THEN 'High!' WHEN 1 THEN 'noise' ELSE 'unsure' END AS correct_severity,
 CASE WHEN k % 2 = 0 THEN 'investigate' ELSE 'ignore' END AS correct_action, k, 'because ' || k AS reason
 FROM v_hids WHERE k % 6 IN (0, 1, 2, 3)"""}


@query("parse_review_json")
def _(spark, sf):
    a = T.parse_review_json(_responses(spark, sf), keep=["response_id"])
    return a.select("response_id", "place", "alert_id", "correct_severity", "correct_action", "reason",
                    F.coalesce(F.size("log_keywords"), F.lit(-1)).alias("words"))


sql("parse_review_json", """SELECT alert_id AS response_id, 0 AS place, alert_id, correct_severity, correct_action, reason,
 CASE WHEN k % 7 <> 0 THEN 5 ELSE -1 END AS words FROM answers""", extra=_ANSWERS)


def _observed(spark, sf):
    answers = T.parse_review_json(_responses(spark, sf), keep=["response_id"])
    return T.review_disagreements(answers, _queue(spark, sf), keep=["response_id"])


_OBSERVED = {**_ANSWERS, "observed": f"""SELECT a.alert_id, j.rule_id, j.agent, ['k=' || a.k, 'rule', 'check', 'x'] AS log_keywords,
 s AS severity, correct_action AS action, reason FROM (SELECT *, {vocab('correct_severity', K.SEVERITIES)} AS s FROM answers) a
 JOIN judged j ON j.id = a.alert_id WHERE s IS NOT NULL AND a.k % 7 <> 0
 AND NOT (s = j.severity AND correct_action = j.action)"""}


@query("review_disagreements")
def _(spark, sf):
    return _observed(spark, sf).select("alert_id", "rule_id", "agent", F.array_join("log_keywords", ",").alias("words"),
                                       "severity", "action", "reason")


sql("review_disagreements", """SELECT alert_id, rule_id, agent, array_to_string(log_keywords, ',') AS words, severity, action,
 reason FROM observed""", extra=_OBSERVED)


@query("lesson_id")
def _(spark, sf):
    h = _hids(spark, sf).withColumns({
        "log_keywords": F.array(F.concat(F.lit("  K =\t"), F.col("k").cast("string")), F.col("description"), F.lit("Abc")),
        "severity": T.level_severity(F.col("level")), "action": T.level_action(F.col("level"))})
    return h.select("id", L.lesson_id().alias("lesson_id"))


sql("lesson_id", f"""SELECT id, {sha_id('rule_id', 'agent', 'kws', 'sev', 'act')} AS lesson_id FROM (SELECT *,
 ['  K =' || chr(9) || k, description, 'Abc'] AS kws, {LEVEL_SEV.format('level')} AS sev, {LEVEL_ACT.format('level')} AS act
 FROM v_hids)""")


def _ingested(spark, sf):
    observed = _observed(spark, sf).withColumn("seq", F.col("alert_id").cast("long"))
    again = _store(spark, sf).where("ord % 2 = 0").select(
        F.col("ord").alias("seq"), "rule_id", "agent", "log_keywords", "severity", "action", "reason")
    return L.lesson_ingest(_store(spark, sf), observed.select(again.columns).unionByName(again), views.AS_OF)


_INGEST = {**_OBSERVED, "incoming": f"""SELECT *, {sha_id('rule_id', 'agent', 'log_keywords', 'severity', 'action')} AS lesson_id
 FROM (SELECT CAST(alert_id AS BIGINT) AS seq, rule_id, agent, log_keywords, severity, action, reason FROM observed
 UNION ALL SELECT ord, rule_id, agent, log_keywords, severity, action, reason FROM store WHERE ord % 2 = 0)""",
    "batch": """SELECT lesson_id, count(*) AS n, min(seq) AS seq, arg_min(rule_id, seq) AS rule_id, arg_min(agent, seq) AS agent,
 arg_min(log_keywords, seq) AS log_keywords, arg_min(severity, seq) AS severity, arg_min(action, seq) AS action,
 arg_min(reason, seq) AS reason FROM incoming GROUP BY lesson_id""",
    "grown": """SELECT coalesce(s.lesson_id, b.lesson_id) AS lesson_id, CASE WHEN s.ord IS NULL
  THEN (SELECT max(ord) FROM store) + 1 + b.seq ELSE s.ord END AS ord, coalesce(s.status, 'pending') AS status,
 coalesce(s.source, 'reviewer') AS source, coalesce(s.promotion_count, 0) + coalesce(b.n, 0) AS promotion_count,
 coalesce(s.promotion_threshold, 3) AS promotion_threshold, coalesce(s.rule_id, b.rule_id) AS rule_id,
 coalesce(s.agent, b.agent) AS agent, coalesce(s.log_keywords, b.log_keywords) AS log_keywords,
 coalesce(s.severity, b.severity) AS severity, coalesce(s.action, b.action) AS action, coalesce(s.reason, b.reason) AS reason,
 coalesce(s.created_at, '2024-01-31T00:00:00Z') AS created_at, CASE WHEN b.n IS NULL THEN s.last_seen_at
  ELSE '2024-01-31T00:00:00Z' END AS last_seen_at, s.last_promoted_at, coalesce(s.hits, 0) AS hits
 FROM store s FULL JOIN batch b ON s.lesson_id = b.lesson_id""",
    "promoted": """SELECT * REPLACE (CASE WHEN due THEN 'authoritative' ELSE status END AS status,
 CASE WHEN due THEN '2024-01-31T00:00:00Z' ELSE last_promoted_at END AS last_promoted_at) FROM (SELECT *,
 status = 'pending' AND promotion_count >= promotion_threshold AS due FROM grown)"""}
_FLAT = ["lesson_id", "ord", "status", "source", "promotion_count", "promotion_threshold", "rule_id", "agent", "severity",
         "action", "reason", "created_at", "last_seen_at", "last_promoted_at", "hits"]


def _flat(df):
    return df.select(*_FLAT, F.array_join("log_keywords", ",").alias("words"))


_FLAT_SQL = ", ".join(_FLAT) + ", array_to_string(log_keywords, ',') AS words"


@query("lesson_ingest")
def _(spark, sf):
    return _flat(_ingested(spark, sf))


sql("lesson_ingest", f"SELECT {_FLAT_SQL} FROM grown", extra=_INGEST)


@query("lesson_promote")
def _(spark, sf):
    return _flat(L.lesson_promote(_ingested(spark, sf), views.AS_OF))


sql("lesson_promote", f"SELECT {_FLAT_SQL} FROM promoted", extra=_INGEST)



@query("lesson_prune")
def _(spark, sf):
    return _flat(L.lesson_prune(_store(spark, sf), views.AS_OF + timedelta(days=89, hours=22), 90))


sql("lesson_prune", f"""SELECT {_FLAT_SQL} FROM store WHERE NOT (last_seen_at < '2024-01-30T22:00:00Z'
 AND (status = 'pending' OR (status = 'authoritative' AND hits = 0)))""")


@query("lesson_list")
def _(spark, sf):
    return L.lesson_list(_store(spark, sf), "pending")


sql("lesson_list", """SELECT lesson_id, status, promotion_count || '/' || promotion_threshold AS promotions, hits,
 substr(source, 1, 12) AS source, 'r' || rule_id || ' ' || agent || ' [' || substr(array_to_string(log_keywords, ','), 1, 30)
 || '] -> ' || severity || '/' || action AS pattern FROM store WHERE status = 'pending'""")


def _prefix(spark, sf):
    return _store(spark, sf).orderBy("ord").first().lesson_id[:8]


@query("lesson_find_prefix")
def _(spark, sf):
    return _flat(L.lesson_find_prefix(_store(spark, sf), _prefix(spark, sf)))


sql("lesson_find_prefix", f"SELECT {_FLAT_SQL} FROM store ORDER BY ord LIMIT 1")


@query("lesson_manual_promote")
def _(spark, sf):
    return _flat(L.lesson_manual_promote(_store(spark, sf), _prefix(spark, sf), views.AS_OF))


sql("lesson_manual_promote", f"""SELECT {_FLAT_SQL} FROM (SELECT * REPLACE (
 CASE WHEN due THEN 'authoritative' ELSE status END AS status,
 CASE WHEN due THEN '2024-01-31T00:00:00Z' ELSE last_promoted_at END AS last_promoted_at) FROM (
 SELECT *, ord = (SELECT min(ord) FROM store) AND status <> 'authoritative' AS due FROM store))""")


@query("lesson_reject")
def _(spark, sf):
    return _flat(L.lesson_reject(_store(spark, sf), _prefix(spark, sf)))


sql("lesson_reject", f"SELECT {_FLAT_SQL} FROM store WHERE ord > (SELECT min(ord) FROM store)")


@query("lesson_add")
def _(spark, sf):
    given = (_hids(spark, sf).where("agent = 'pi2'").groupBy("rule_id", "agent")
             .agg(F.min("id").cast("long").alias("seq"))
             .select("seq", "rule_id", "agent", F.array(F.lit(" Rule Check "), F.lit("")).alias("log_keywords"),
                     F.lit(" HIGH").alias("severity"), F.lit("Escalate ").alias("action"), F.lit("by hand").alias("reason")))
    return _flat(L.lesson_add(_store(spark, sf), given, views.AS_OF))


sql("lesson_add", f"""SELECT {_FLAT_SQL} FROM store UNION ALL SELECT
 {sha_id('rule_id', 'agent', "['rule check']", "'high'", "'escalate'")}, (SELECT max(ord) FROM store) + 1 + min(CAST(id AS BIGINT)),
 'authoritative', 'operator', 1, 3, rule_id, agent, 'high', 'escalate', 'by hand', '2024-01-31T00:00:00Z',
 '2024-01-31T00:00:00Z', '2024-01-31T00:00:00Z', 0, 'rule check' FROM v_hids WHERE agent = 'pi2' GROUP BY rule_id, agent""")


@query("lesson_stats")
def _(spark, sf):
    return L.lesson_stats(_store(spark, sf))


sql("lesson_stats", """SELECT CASE WHEN grouping(status) = 0 THEN 'status' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END
 AS "by", coalesce(status, source, '') AS value, count(*) AS lessons, CAST(sum(hits) AS BIGINT) AS hits FROM store
 GROUP BY GROUPING SETS ((status), (source), ())""")


@query("lesson_top")
def _(spark, sf):
    return L.lesson_top(_store(spark, sf))


sql("lesson_top", """SELECT lesson_id, hits, agent, rule_id, severity, action FROM store WHERE hits > 0
 ORDER BY hits DESC, ord LIMIT 5""")


@query("escalations")
def _(spark, sf):
    return T.escalations(_queue(spark, sf), SINCE)


sql("escalations", f"""SELECT id AS alert_id, queued_at, '[' || upper(severity) || '] ' || agent || ' rule ' || rule_id || ': '
 || description AS headline, substr(full_log, 1, 120) AS preview, 'via: ' || classifier || ' at ' || queued_at AS via
 FROM judged WHERE queued_at > '{SINCE}' AND (action = 'escalate' OR severity = 'critical')""")
