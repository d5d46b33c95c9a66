"""The lesson store: patterns with verdicts that short-cut triage and are learned from review.

Flat columns: lesson_id, ord, status, source, promotion_count, promotion_threshold, rule_id,
agent, log_keywords, severity, action, reason, created_at, last_seen_at, last_promoted_at, hits.
``ord`` is the order of the store; times are UTC second strings.
"""

from collections import Counter
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from wirelens import constants as K
from wirelens.functions.text import matching_text, normalize_ws
from wirelens.session import ship_package

COLUMNS = ["lesson_id", "ord", "status", "source", "promotion_count", "promotion_threshold", "rule_id", "agent",
           "log_keywords", "severity", "action", "reason", "created_at", "last_seen_at", "last_promoted_at", "hits"]
PENDING, AUTHORITATIVE = "pending", "authoritative"


def iso(moment: datetime) -> str:
    return moment.strftime("%Y-%m-%dT%H:%M:%SZ")


def lesson_id(rule_id="rule_id", agent="agent", keywords="log_keywords", severity="severity",
              action="action") -> Column:
    """Stable id of a pattern with its verdict; keyword order, case and spacing do not matter."""
    words = F.array_sort(F.transform(F.coalesce(F.col(keywords), F.array().cast("array<string>")), matching_text))

    def part(name):
        return F.coalesce(F.col(name), F.lit(""))
    payload = F.concat_ws("|", part(rule_id), part(agent), F.array_join(words, ","), part(severity), part(action))
    return F.substring(F.sha1(payload.cast("binary")), 1, 16)


LOG_BYTES, WORD_BYTES = 32 << 20, 16 << 20  # logs, and keywords of lessons, that meet in one task
FIELDS, KINDS = ("ord", "lesson_id", "severity", "action", "words"), ("long", "string", "string", "string", "array<string>")
PICKED = ", ".join(f"{c} {kind}" for c, kind in zip(FIELDS, KINDS))


def _first_lessons(logs: pa.Table, store: pa.Table) -> pa.Table:
    """Per log the lessons of smallest ``ord`` whose keywords all occur in it: one automaton, one scan of every log."""
    import ahocorasick
    wanted = [set(words) for words in store.column("words").to_pylist()]
    order = store.column("ord").to_pylist()
    holders: dict[str, list[int]] = {}
    for lesson, words in enumerate(wanted):
        for word in words:
            holders.setdefault(word, []).append(lesson)
    automaton = ahocorasick.Automaton()
    for word, lessons in holders.items():
        automaton.add_word(word, (word, lessons))
    if holders:
        automaton.make_automaton()
    at, lesson_rows = [], []
    for row, log in enumerate(logs.column("_log").to_pylist() if holders else ()):
        found = dict(value for _, value in automaton.iter(log))
        met = Counter(lesson for lessons in found.values() for lesson in lessons)
        whole = [lesson for lesson, n in met.items() if n == len(wanted[lesson])]
        if whole:
            least = min(order[lesson] for lesson in whole)
            for lesson in whole:
                if order[lesson] == least:
                    at.append(row)
                    lesson_rows.append(lesson)
    told = store.select(list(FIELDS)).take(pa.array(lesson_rows, pa.int64()))
    return told.add_column(0, "digest", logs.column("digest").take(pa.array(at, pa.int64())))


def _meet(key: tuple, logs: pa.Table, store: pa.Table) -> pa.Table:
    found = _first_lessons(logs, store)
    return found.add_column(0, "_key", pa.array([key[0].as_py()] * len(found), pa.string()))


def lesson_match(alerts: DataFrame, lessons: DataFrame, status: str | None = AUTHORITATIVE,
                 log: str = "full_log") -> DataFrame:
    """Alerts with ``lesson``: the first lesson of the store with the same rule and agent (null
    equals null) whose keywords all occur in the log.  Null where none matches.

    The lessons of a rule and agent become an Aho-Corasick automaton, which finds all keywords in one scan of a
    log.  Logs of a busy rule and agent are dealt to as many tasks as their bytes fill, each with its own automaton,
    and a large store of one rule and agent is cut into parts of bounded keywords.  A log travels once per part, however
    long it is.  The answer depends on rule, agent and log alone, so equal logs are looked at once and every
    alert row comes back exactly once, whatever its id.  A null log or keyword counts as empty text; a lesson without
    keywords matches all of its rule and agent.
    """
    ship_package(alerts.sparkSession)
    if status is not None:
        lessons = lessons.where(F.col("status") == status)
    words = F.filter(F.transform(F.coalesce("log_keywords", F.array().cast("array<string>")), matching_text),
                     lambda w: w != "")
    of = F.struct("rule_id", "agent")
    held = lessons.withColumn("words", words).select(of.alias("_of"), F.struct(*[
        F.col(c).cast(kind).alias(c) for c, kind in zip(FIELDS, KINDS)]).alias("lesson"))
    told = held.where(F.size("lesson.words") > 0)
    size = F.aggregate("lesson.words", F.lit(0).cast("long"), lambda n, w: n + F.octet_length(w))
    known = held.groupBy("_of").agg(F.min(F.when(F.size("lesson.words") == 0, F.col("lesson"))).alias("_always"),
                                    F.sum(size).alias("_bytes"))
    known = known.withColumn("_parts", F.ceil(F.greatest(F.col("_bytes"), F.lit(1)) / WORD_BYTES).cast("int"))

    digest = F.sha2(matching_text(F.col(log)), 256)
    texts = (alerts.select(of.alias("_of"), digest.alias("digest"), matching_text(F.col(log)).alias("_log"))
             .join(known.select("_of", "_parts"), "_of").dropDuplicates(["_of", "digest"]))
    length = F.coalesce(F.octet_length(F.col(log)), F.lit(0)) + 100
    tasks = alerts.groupBy(of.alias("_of")).agg(F.ceil(F.sum(length.cast("long")) / LOG_BYTES).cast("int").alias("_tasks"))

    def dealt(count: Column, *content: str) -> Column:
        return F.pmod(F.xxhash64(*content), count).cast("int")
    logs = texts.join(tasks, "_of").select(
        "_of", "digest", "_log", dealt(F.col("_tasks"), "digest").alias("_task"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    store = told.join(known.select("_of", "_parts"), "_of").join(tasks, "_of").select(
        "_of", dealt(F.col("_parts"), "lesson").alias("_part"), F.explode(F.sequence(F.lit(0), F.col("_tasks") - 1)).alias("_task"),
        "lesson.*")
    meeting = [F.to_json("_of").alias("_key"), "_task", "_part"]  # null equals null here
    found = (logs.select(*meeting, "digest", "_log").groupBy("_key", "_task", "_part")
             .cogroup(store.select(*meeting, *FIELDS).groupBy("_key", "_task", "_part"))
             .applyInArrow(_meet, f"_key string, digest string, {PICKED}"))
    matched = found.select("_key", "digest", F.struct(*FIELDS).alias("lesson"))
    always = known.where(F.col("_always").isNotNull()).select(F.to_json("_of").alias("_key"), "_always")
    best = matched.groupBy("_key", "digest").agg(F.min("lesson").alias("_found"))
    own = alerts.withColumns({"_key": F.to_json(of), "digest_": digest})
    joined = (own.join(best.withColumnRenamed("digest", "digest_"), ["_key", "digest_"], "left").join(always, "_key", "left"))
    return joined.withColumn("lesson", F.least("_found", "_always")).drop("_key", "digest_", "_found", "_always")


def lesson_hits(lessons: DataFrame, judged: DataFrame, as_of: datetime) -> DataFrame:
    """Store with the cache hits of a run added; lessons that were hit were seen now."""
    counts = (judged.where(F.col("lesson_id").isNotNull()).groupBy("lesson_id")
              .agg(F.count("*").alias("_n")))
    return (lessons.join(counts, "lesson_id", "left")
            .withColumns({"hits": F.coalesce("hits", F.lit(0)) + F.coalesce("_n", F.lit(0)),
                          "last_seen_at": F.when(F.col("_n").isNotNull(), iso(as_of)).otherwise(F.col("last_seen_at"))})
            .drop("_n"))


def lesson_ingest(store: DataFrame, observed: DataFrame, as_of: datetime, source: str = "reviewer",
                  threshold: int = K.PROMOTION_THRESHOLD) -> DataFrame:
    """Upsert observations (seq, rule_id, agent, log_keywords, severity, action, reason): a known
    lesson counts one per occurrence, a new one enters pending with the occurrences seen.

    Occurrences are counted before the join, so a lesson observed in a third of all rows costs
    one partial row per task.
    """
    now = iso(as_of)
    first = F.min_by(F.struct("rule_id", "agent",
                              F.transform(F.coalesce("log_keywords", F.array().cast("array<string>")), normalize_ws)
                              .alias("log_keywords"), "severity", "action",
                              F.coalesce("reason", F.lit("")).alias("reason")), "seq")
    batch = observed.withColumn("lesson_id", lesson_id()).groupBy("lesson_id").agg(
        F.count("*").alias("_n"), first.alias("_new"), F.min("seq").alias("_seq"))
    top = store.agg(F.max("ord")).first()[0] or 0
    both = store.join(batch, "lesson_id", "full")
    known = F.col("ord").isNotNull()
    seen = F.col("_n").isNotNull()
    new_values = {
        "ord": F.lit(top).cast("long") + 1 + F.col("_seq"), "status": F.lit(PENDING), "source": F.lit(source),
        "promotion_count": F.col("_n"), "promotion_threshold": F.lit(threshold).cast("long"),
        "created_at": F.lit(now), "last_seen_at": F.lit(now), "last_promoted_at": F.lit(None).cast("string"),
        "hits": F.lit(0).cast("long"),
        **{c: F.col("_new").getField(c) for c in ("rule_id", "agent", "log_keywords", "severity", "action", "reason")}}
    old_values = {
        "promotion_count": F.coalesce("promotion_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
        "last_seen_at": F.when(seen, now).otherwise(F.col("last_seen_at"))}
    return both.select("lesson_id", *[
        F.when(known, old_values.get(c, F.col(c))).otherwise(new_values[c]).alias(c) for c in COLUMNS[1:]])


def lesson_promote(store: DataFrame, as_of: datetime) -> DataFrame:
    """Pending lessons that reached their threshold become authoritative."""
    due = ((F.col("status") == PENDING)
           & (F.coalesce("promotion_count", F.lit(0))
              >= F.coalesce("promotion_threshold", F.lit(K.PROMOTION_THRESHOLD))))
    return store.withColumns({
        "status": F.when(due, AUTHORITATIVE).otherwise(F.col("status")),
        "last_promoted_at": F.when(due, iso(as_of)).otherwise(F.col("last_promoted_at"))})


def lesson_prune(store: DataFrame, as_of: datetime, max_age_days: int = K.LESSON_MAX_AGE_DAYS) -> DataFrame:
    """Drop lessons unseen for the age limit: pending ones always, authoritative ones without hits."""
    seen = F.coalesce(F.nullif(F.col("last_seen_at"), F.lit("")), F.col("created_at"), F.lit(""))
    stale = seen < iso(as_of - timedelta(days=max_age_days))
    unused = (F.col("status") == AUTHORITATIVE) & (F.coalesce("hits", F.lit(0)) == 0)
    return store.where(~F.coalesce(stale & ((F.col("status") == PENDING) | unused), F.lit(False)))


def lesson_list(store: DataFrame, status: str | None = None) -> DataFrame:
    """Listing rows: id, status, promotions, hits, source and the pattern in words."""
    if status is not None:
        store = store.where(F.col("status") == status)
    pattern = F.format_string(
        "r%s %s [%s] -> %s/%s", "rule_id", "agent", F.substring(F.array_join("log_keywords", ","), 1, 30),
        "severity", "action")
    return store.select(
        "lesson_id", "status",
        F.concat_ws("/", F.col("promotion_count").cast("string"),
                    F.coalesce(F.col("promotion_threshold").cast("string"), F.lit("?"))).alias("promotions"),
        "hits", F.substring("source", 1, 12).alias("source"), pattern.alias("pattern"))


def lesson_find_prefix(store: DataFrame, prefix: str) -> DataFrame:
    """The one lesson whose id starts with the prefix; none or several are an error."""
    found = store.where(F.startswith(F.col("lesson_id"), F.lit(prefix)))
    ids = [r.lesson_id for r in found.select("lesson_id").limit(2).collect()]
    if len(ids) != 1:
        raise LookupError(f"no lesson matching prefix '{prefix}'" if not ids
                          else f"prefix '{prefix}' is ambiguous")
    return store.where(F.col("lesson_id") == ids[0])


def lesson_manual_promote(store: DataFrame, prefix: str, as_of: datetime) -> DataFrame:
    target = lesson_find_prefix(store, prefix).first().lesson_id
    due = (F.col("lesson_id") == target) & (F.col("status") != AUTHORITATIVE)
    return store.withColumns({
        "status": F.when(due, AUTHORITATIVE).otherwise(F.col("status")),
        "last_promoted_at": F.when(due, iso(as_of)).otherwise(F.col("last_promoted_at"))})


def lesson_reject(store: DataFrame, prefix: str) -> DataFrame:
    target = lesson_find_prefix(store, prefix).first().lesson_id
    return store.where(F.col("lesson_id") != target)


def lesson_add(store: DataFrame, given: DataFrame, as_of: datetime) -> DataFrame:
    """Operator lessons: keywords are cut and lower-cased, verdicts checked, and the lesson is
    authoritative at once.  An unknown severity or action anywhere is an error."""
    lowered = given.withColumns({
        "severity": F.lower(F.trim("severity")), "action": F.lower(F.trim("action")),
        "log_keywords": F.filter(F.transform("log_keywords", lambda k: F.lower(F.trim(k))), lambda k: k != "")})
    wrong = lowered.where(~(F.coalesce(F.col("severity").isin(*K.SEVERITIES), F.lit(False))
                            & F.coalesce(F.col("action").isin(*K.ACTIONS), F.lit(False)))).limit(1).collect()
    if wrong:
        raise ValueError(f"invalid severity or action: {wrong[0].severity}/{wrong[0].action}")
    grown = lesson_ingest(store, lowered, as_of, source="operator")
    mine = lowered.select(lesson_id().alias("lesson_id")).distinct().withColumn("_mine", F.lit(True))
    due = F.col("_mine").isNotNull()
    return (grown.join(mine, "lesson_id", "left")
            .withColumns({"status": F.when(due, AUTHORITATIVE).otherwise(F.col("status")),
                          "last_promoted_at": F.when(due, iso(as_of)).otherwise(F.col("last_promoted_at"))})
            .drop("_mine"))


def lesson_stats(store: DataFrame) -> DataFrame:
    """Counts and hits by status, by source and overall, in one pass."""
    store = store.select("status", "source", F.coalesce("hits", F.lit(0)).alias("hits"))
    return (store.groupingSets([["status"], ["source"], []], "status", "source")
            .agg(F.grouping("status").alias("_gs"), F.grouping("source").alias("_gc"),
                 F.count("*").alias("lessons"), F.sum("hits").alias("hits"))
            .select(F.when(F.col("_gs") == 0, "status").when(F.col("_gc") == 0, "source").otherwise("all").alias("by"),
                    F.coalesce(F.when(F.col("_gs") == 0, F.col("status")).when(F.col("_gc") == 0, F.col("source")),
                               F.lit("")).alias("value"), "lessons", "hits"))


def lesson_top(store: DataFrame, top: int = 5) -> DataFrame:
    """The most used lessons, those without hits left out; ties in store order."""
    return (store.where(F.col("hits") > 0).orderBy(F.col("hits").desc(), "ord").limit(top)
            .select("lesson_id", "hits", "agent", "rule_id", "severity", "action"))
