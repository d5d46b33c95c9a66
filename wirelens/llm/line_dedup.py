"""Lines found in many documents are dropped from all of them.

Lines are exploded as 128-bit hashes of their keys; documents per hash are counted with partial
aggregation, so a line that a third of all documents share is one counter per task.  The frequent
hashes are written once: their size is then known, and Spark broadcasts them only below its
threshold; beyond it both sides are shuffled and a hot line is split by the adaptive skew join.
Only dropped positions travel back to the documents.
"""

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.llm.common import BLANKS, ascii_lower, landed, let, row_key


def _keys(text: Column) -> Column:
    """Per line the hash of its key; null for keys of no characters, which are never dropped."""
    def hashed(line):
        key = F.btrim(line, F.lit(BLANKS))
        return F.when(key != "", F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")))
    return F.transform(F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n"), hashed)


def frequent_lines(docs: DataFrame, text: str = "text", min_documents: int = 10) -> DataFrame:
    """Hashes of the line keys that at least ``min_documents`` rows contain."""
    lines = docs.select(F.explode_outer(F.array_distinct(_keys(F.col(text)))).alias("h")).where("h is not null")
    return (lines.select("h.h1", "h.h2").groupBy("h1", "h2").agg(F.count("*").alias("documents"))
            .where(F.col("documents") >= min_documents))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_documents: int = 10) -> DataFrame:
    """(row, n_lines, n_dropped, kept_text) for every row of ``docs``; ``row`` holds its columns unchanged.

    Each row is a document of its own, also where its id is null or repeated.  A null or empty text is
    one empty line, kept.  Empty keys are never dropped.  If every line is dropped the text is empty.
    An empty table gives an empty result.
    """
    frequent = landed(frequent_lines(docs, text, min_documents).select("h1", "h2"), "frequent-lines")
    found = (docs.select(row_key(id_col, text).alias("k"), F.posexplode_outer(_keys(F.col(text))).alias("pos", "h"))
             .where("h is not null").select("k", "pos", "h.h1", "h.h2")
             .join(frequent, ["h1", "h2"])
             .groupBy("k").agg(F.collect_set("pos").alias("dropped")))
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text).alias("k")).join(found, "k", "left")
    whole = F.coalesce(F.col(f"row.{text}"), F.lit(""))
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))

    def result(lines: Column) -> Column:
        kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), dropped),
                           lambda at: F.element_at(lines, at + 1))
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        F.when(F.size(dropped) == 0, whole).otherwise(F.array_join(kept, "\n")).alias("kept_text"))
    return rows.select("row", F.size(dropped).cast("long").alias("n_dropped"), let(F.split(whole, "\n"), result).alias("r")).select(
        "row", "r.n_lines", "n_dropped", "r.kept_text")
