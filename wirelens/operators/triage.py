"""Triage of host alerts: compaction, verdicts, queue and review."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from wirelens import constants as K
from wirelens.functions.text import (ACTION_LINE, SEVERITY_LINE, normalize_action, normalize_severity)
from wirelens.operators.lessons import lesson_match
from wirelens.operators.skew import rank_within
from wirelens.session import cut_lineage


def compact_alert(raw: DataFrame, log_chars: int | None = None) -> DataFrame:
    """Nested host alert to the flat form that is queued: id plus one column per kept field.
    Optional data keys are null where absent.  Logs stay whole, since lessons match
    anywhere in them; ``log_chars`` cuts them for display."""
    log = F.coalesce(F.col("full_log"), F.lit(""))
    return raw.select(
        "id", F.substring(F.coalesce("timestamp", F.lit("")), 1, 19).alias("ts"),
        F.col("rule.level").alias("level"), F.col("rule.id").alias("rule_id"),
        F.col("rule.description").alias("description"),
        F.coalesce(F.col("rule.groups"), F.array().cast("array<string>")).alias("groups"),
        F.col("agent.name").alias("agent"),
        (log if log_chars is None else F.substring(log, 1, log_chars)).alias("full_log"),
        *[F.element_at("data", k).alias(k) for k in K.ALERT_DATA_KEYS])


def new_since_id(alerts: DataFrame, last_id: str | None, cap: int | None = None) -> DataFrame:
    """Alerts after ``last_id``, all of them without one.  With a ``cap`` only the first ones in id order
    (the rest wait for the next run), and without a last id the newest ones."""
    fresh = alerts if last_id is None else alerts.where(F.col("id") > last_id)
    if cap is None:
        return fresh
    return fresh.orderBy(F.col("id").desc() if last_id is None else F.col("id")).limit(cap)


def advance_watermark(processed: DataFrame, column: str, before: str | None) -> DataFrame:
    """One row with the new high-water mark; an empty run keeps the old one."""
    return processed.agg(F.coalesce(F.max(column), F.lit(before)).alias("mark"))


def level_severity(level: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in K.LEVEL_SEVERITY.items() for x in pair])
    return F.coalesce(table[F.coalesce(level, F.lit(0))], F.lit("low"))


def level_action(level: Column) -> Column:
    level = F.coalesce(level, F.lit(0))
    return (F.when(level >= 9, "escalate").when(level >= 7, "investigate").when(level >= 4, "log")
            .otherwise("ignore"))


def verdict_severity(text: Column) -> Column:
    return normalize_severity(F.regexp_extract(text, SEVERITY_LINE, 1))


def verdict_action(text: Column) -> Column:
    return normalize_action(F.regexp_extract(text, ACTION_LINE, 1))


def enforce_coherence(severity: Column, action: Column) -> Column:
    """Struct (severity, action, corrected): the action a severity demands."""
    demanded = (F.when(severity == "noise", "ignore").when(severity == "critical", "escalate")
                .when((severity == "low") & ~F.coalesce(action.isin("log", "ignore"), F.lit(False)), "log")
                .when((severity == "high") & (action == "ignore"), "investigate").otherwise(action))
    return F.struct(severity.alias("severity"), demanded.alias("action"),
                    (~demanded.eqNullSafe(action)).alias("corrected"))


def classify_cascade(alerts: DataFrame, lessons: DataFrame, model_up: bool = True, model_text: str = "model_text",
                     ask: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Verdict per compact alert: lesson cache, else the model's answer, else the rule level.

    ``model_text`` holds the model's answer; null means the call failed.  ``ask`` adds that column to
    the alerts that no lesson matches, so the model never sees the others; these are matched once and kept.
    Adds severity, action, reason, classifier, lesson_id, fallback and coherence_corrected.
    """
    matched = lesson_match(alerts, lessons)
    if ask is not None:
        matched = cut_lineage(matched)
        unasked = F.lit(None).cast("string").alias(model_text)
        missed = F.col("lesson").isNull()
        matched = (matched.where(~missed).select("*", unasked)
                   .unionByName(ask(matched.where(missed)).select(*matched.columns, model_text)))
    hit = F.col("lesson.lesson_id").isNotNull()
    text, level = F.col(model_text), F.col("level")
    sev, act = verdict_severity(text), verdict_action(text)
    answered = F.lit(model_up) & sev.isNotNull() & act.isNotNull()
    classifier = (F.when(hit, "lesson-cache").when(~F.lit(model_up), "fallback-health")
                  .when(text.isNull(), "fallback-error").when(answered, "model").otherwise("fallback-parse"))
    judged = matched.withColumns({
        "classifier": classifier,
        "_sev": F.when(hit, F.col("lesson.severity")).when(answered, sev).otherwise(level_severity(level)),
        "_act": F.when(hit, F.col("lesson.action")).when(answered, act).otherwise(level_action(level))})
    by_level = F.concat(F.lit("Classified from rule.level="), F.coalesce(level, F.lit(0)).cast("string"))
    reason = (F.when(F.col("classifier") == "lesson-cache",
                     F.concat(F.lit("lesson cache hit ("), F.substring("lesson.lesson_id", 1, 8), F.lit(")")))
              .when(F.col("classifier") == "model", "model classification")
              .when(F.col("classifier") == "fallback-health", F.concat(by_level, F.lit(" (model unhealthy).")))
              .when(F.col("classifier") == "fallback-error", F.concat(by_level, F.lit(" (model error).")))
              .otherwise(F.concat(by_level, F.lit(" (model output unparseable)."))))
    fixed = enforce_coherence(F.col("_sev"), F.col("_act"))
    return (judged.withColumn("_v", fixed)
            .select(*[c for c in matched.columns if c != "lesson"], F.col("_v.severity").alias("severity"), F.col("_v.action").alias("action"),
                    reason.alias("reason"), "classifier", F.col("lesson.lesson_id").alias("lesson_id"),
                    F.startswith(F.col("classifier"), F.lit("fallback")).alias("fallback"),
                    F.col("_v.corrected").alias("coherence_corrected")))


_VERDICT = ["severity", "action", "reason", "classifier", "lesson_id", "fallback", "coherence_corrected"]
_ALERT = ["ts", "level", "rule_id", "description", "groups", "agent", "full_log", *K.ALERT_DATA_KEYS]


def queue_entries(judged: DataFrame, queued_at: Column) -> DataFrame:
    """Nested queue rows: alert_id, alert{}, triage{}, queued_at."""
    have = set(judged.columns)
    empty = F.lit(None).cast("string")
    alert = [F.col(c) if c in have else
             (F.array().cast("array<string>") if c == "groups" else empty).alias(c) for c in _ALERT]
    return judged.select(F.col("id").alias("alert_id"), F.struct(*alert).alias("alert"),
                         F.struct(*_VERDICT).alias("triage"), queued_at.alias("queued_at"))


def relevant_entries(queue: DataFrame, since: str | None = None) -> DataFrame:
    """Entries after ``since`` (string order) that deserve a report."""
    severity, action = F.lower("triage.severity"), F.lower("triage.action")
    keep = severity.isin("critical", "high", "medium") | action.isin("escalate", "investigate")
    if since is not None:
        keep = keep & (F.col("queued_at") > since)
    return queue.where(keep)


def severity_breakdown(entries: DataFrame) -> DataFrame:
    severity = F.coalesce(F.col("triage.severity"), F.lit("unknown"))
    return entries.groupBy(severity.alias("severity")).agg(F.count("*").alias("alerts")).orderBy("severity")


def report_rows(entries: DataFrame) -> DataFrame:
    """Report as rows (section, alert_id, line): two header lines and one audit line per entry."""
    counts = severity_breakdown(entries)
    parts = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("severity", "alerts"))),
        lambda s: F.concat(s.getField("severity"), F.lit("="), s.getField("alerts").cast("string"))), ", ")
    head = counts.agg(F.coalesce(F.sum("alerts"), F.lit(0)).alias("n"), parts.alias("parts"))
    lines = F.array(F.concat(F.lit("- Alerts analyzed: **"), F.col("n").cast("string"), F.lit("**")),
                    F.concat(F.lit("- Severity breakdown: "), F.col("parts")))
    header = head.select(F.lit("header").alias("section"), F.lit("").alias("alert_id"),
                         F.explode(lines).alias("line"))
    audit = entries.select(
        F.lit("audit").alias("section"), "alert_id",
        F.format_string("- `%s` [%s/%s] %s lvl%s: %s", "alert_id", "triage.severity", "triage.action",
                        "alert.agent", F.col("alert.level").cast("string"), "alert.description").alias("line"))
    return header.unionByName(audit)


def review_items(entries: DataFrame) -> DataFrame:
    """One JSON object per entry, as handed to a reviewer."""
    item = F.struct("alert_id", "alert.rule_id", "alert.agent", "alert.level", "alert.description",
                    "alert.full_log", F.col("triage.severity").alias("first_severity"),
                    F.col("triage.action").alias("first_action"))
    return entries.select("alert_id", "queued_at", F.to_json(item, {"ignoreNullFields": "false"}).alias("item"))


def review_documents(items: DataFrame, per_document: int = 50) -> DataFrame:
    """Review documents of at most ``per_document`` items, filled in id order per queue day."""
    placed = items.withColumns({"day": F.substring("queued_at", 1, 10), "minute": F.substring("queued_at", 1, 16)})
    ranked = rank_within(placed, ["day"], "minute", [F.col("queued_at"), F.col("alert_id")], "_rank", "_n")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_rank", "item"))), lambda s: s.getField("item"))
    return (ranked.groupBy("day", F.floor(F.col("_rank") / per_document).cast("int").alias("document"))
            .agg(F.count("*").alias("items"), listed.alias("_l"))
            .select("day", "document", "items",
                    F.concat(F.lit("["), F.array_join("_l", ","), F.lit("]")).alias("json")))


_ANSWER = ("array<struct<alert_id:string,correct_severity:string,correct_action:string,"
           "log_keywords:array<string>,reason:string>>")


def parse_review_json(responses: DataFrame, text: str = "response", keep=()) -> DataFrame:
    """Answers of a reviewer, one row each with its position: a JSON list, or an object holding
    the list under one of the known keys (first such key wins).  Anything else gives no rows."""
    listed = F.from_json(F.col(text), _ANSWER)
    keyed = F.from_json(F.col(text), "struct<" + ",".join(f"{k}:{_ANSWER}" for k in K.REVIEW_ANSWER_KEYS) + ">")
    answers = F.when(F.startswith(F.ltrim(F.col(text)), F.lit("[")), listed) \
        .otherwise(F.coalesce(*[keyed.getField(k) for k in K.REVIEW_ANSWER_KEYS]))
    return responses.select(*keep, F.posexplode(answers).alias("place", "a")).select(*keep, "place", "a.*")


def review_disagreements(answers: DataFrame, entries: DataFrame, keep=(), most_words: int | None = None) -> DataFrame:
    """Answers that contradict the first verdict, as lesson observations: pattern, verdict, reason.
    All keywords are learned unless ``most_words`` keeps the first ones only."""
    words = F.filter(F.transform("log_keywords", lambda k: F.lower(F.trim(k))), lambda k: F.length(k) > 0)
    latest = entries.groupBy("alert_id").agg(F.max(F.struct("queued_at", "triage", "alert")).alias("e"))
    judged = answers.withColumns({"severity": normalize_severity(F.col("correct_severity")),
                                  "action": normalize_action(F.col("correct_action")), "_words": words})
    usable = judged.where(F.col("severity").isNotNull() & F.col("action").isNotNull()
                          & (F.coalesce(F.size("_words"), F.lit(0)) > 0))
    agrees = ((F.col("severity") == F.lower(F.coalesce("e.triage.severity", F.lit(""))))
              & (F.col("action") == F.lower(F.coalesce("e.triage.action", F.lit("")))))
    return (usable.join(latest, "alert_id").where(~agrees)
            .select(*keep, "alert_id", F.col("e.alert.rule_id").alias("rule_id"),
                    F.col("e.alert.agent").alias("agent"), (F.col("_words") if most_words is None else F.slice("_words", 1, most_words)).alias("log_keywords"),
                    "severity", "action", F.coalesce("reason", F.lit("")).alias("reason")))


def escalations(queue: DataFrame, since: str | None = None, preview: int = 120) -> DataFrame:
    """Entries after the checkpoint that need a person, with the text lines of the notice."""
    urgent = (F.col("triage.action") == "escalate") | (F.col("triage.severity") == "critical")
    if since is not None:
        urgent = urgent & (F.col("queued_at") > since)

    def known(name):
        return F.coalesce(F.col(name).cast("string"), F.lit("?"))
    head = F.format_string("[%s] %s rule %s: %s", F.upper(known("triage.severity")), known("alert.agent"),
                           known("alert.rule_id"), known("alert.description"))
    return queue.where(urgent).select(
        "alert_id", "queued_at", head.alias("headline"),
        F.substring(F.coalesce("alert.full_log", F.lit("")), 1, preview).alias("preview"),
        F.format_string("via: %s at %s", known("triage.classifier"), known("queued_at")).alias("via"))
