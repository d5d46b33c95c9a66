"""Queue to report and lessons: the batch pass that follows triage."""

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens.operators import lessons as L, triage as T
from wirelens.operators.skew import rank_within
from wirelens.session import cut_lineage
from wirelens.sources.eve import src_queue
from wirelens.sources.store import load_mark, save_mark, src_lessons, update_lessons, write_report


def report_pass(spark: SparkSession, queue: str, marks: str, out: str) -> DataFrame:
    """Write the report of the entries queued since the last one and advance the mark.

    Returns the reported entries (none: nothing is written and the mark stays).
    """
    state = load_mark(spark, marks)
    entries = cut_lineage(T.relevant_entries(src_queue(spark, queue), state.get("last_summary_ts")))
    newest = T.advance_watermark(entries, "queued_at", None).first().mark
    if newest is not None:
        write_report(T.report_rows(entries), f"{out}/until={newest.replace(':', '-')}")
        save_mark(spark, marks, **{**state, "last_summary_ts": newest})
    return entries


def learn_pass(entries: DataFrame, responses: DataFrame, store: str, as_of: datetime) -> DataFrame:
    """Turn reviewer responses about reported entries into lessons, promote and prune the store.

    Unusable responses teach nothing and never stop the pass.
    """
    spark = entries.sparkSession
    answers = T.parse_review_json(responses, keep=["response_id"])
    observed = T.review_disagreements(answers, entries, keep=["response_id", "place"])
    # answers count in the order of responses (ids as text) and their place in them: the first lesson wins
    placed = observed.withColumn("_id", F.col("response_id").cast("string")).withColumn("_b", F.substring("_id", 1, 8))
    observed = cut_lineage(rank_within(placed, [], "_b", [F.col("_id"), F.col("place")], "seq", "_n").drop("_id", "_b", "_n"))

    def learn(lessons: DataFrame) -> DataFrame:
        return L.lesson_prune(L.lesson_promote(L.lesson_ingest(lessons, observed, as_of), as_of), as_of)
    update_lessons(spark, store, learn)
    return src_lessons(spark, store)


def escalation_pass(spark: SparkSession, queue: str, marks: str) -> DataFrame:
    """Notices of urgent entries since the last check; the mark moves to the newest entry seen."""
    state = load_mark(spark, marks)
    entries = src_queue(spark, queue)
    notices = cut_lineage(T.escalations(entries, state.get("last_checked_at")))
    seen = T.advance_watermark(entries, "queued_at", state.get("last_checked_at")).first().mark
    save_mark(spark, marks, **{**state, "last_checked_at": seen})
    return notices
