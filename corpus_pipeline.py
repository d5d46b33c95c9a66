"""From raw documents to packed sequences: quality, lines, near duplicates, benchmark passages, packing."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from wirelens.llm import decontaminate, line_dedup, near_dedup, packing, repetition
from wirelens.llm.common import documents, landed, row_key
from wirelens.llm.settings import LIMITS, MIN_DOCUMENTS, NEAR_STAGE, PACKING, WIDTH, tokenizer

WORD = r"[^\x20\x09-\x0D]"  # any character of a word


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep; null and empty texts go."""
    return repetition.judge_documents(docs, **LIMITS).where("q.kept").select("row.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that ten of them share; n_chars follows a changed text."""
    kept = line_dedup.dedup_lines(docs, min_documents=MIN_DOCUMENTS)
    new = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return kept.select(*[F.when(F.col("n_dropped") > 0, new[c]).otherwise(F.col(f"row.{c}")).alias(c) if c in new
                         else F.col(f"row.{c}").alias(c) for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    """Whole rows beside the key of their id and text, so that their columns may have any name."""
    return docs.select(F.struct("*").alias("row"), row_key("doc_id", "text").alias("k"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id (null comes last).

    Documents are taken back by id and text, so null and repeated ids keep no others; of rows that agree in both, one stays.
    """
    judged = near_dedup.near_duplicates(docs, **NEAR_STAGE, with_keys=True).where("node is not null")
    copies = judged.groupBy("root", "doc_id", "k").agg(F.count("*").alias("n"))
    first = copies.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "k", "n")).alias("x"))
    kept = landed(first.select(F.col("x.k").alias("kept_key"), F.col("x.n").alias("n")), "kept")

    def found(rows: DataFrame) -> DataFrame:
        return _keyed(docs).join(rows.select(F.col("kept_key").alias("k")), "k", "left_semi").select("row.*")
    wordless = docs.where(~F.coalesce(F.col("text"), F.lit("")).rlike(WORD))  # linked with nothing
    out = found(kept.where("n = 1")).unionByName(wordless)
    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return out
    one = _keyed(found(repeated)).groupBy("k").agg(F.min("row").alias("row"))
    return out.unionByName(one.select("row.*"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = decontaminate.decontaminate(docs, items, width=WIDTH).where("n_hit > 0").select("k")
    return _keyed(docs).join(hit, "k", "left_anti").select("row.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of the packed sequences."""
    return packing.pack(docs, tokenizer(), **PACKING).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup_stage), ("near_dedup", near_dedup_stage),
          ("decontamination", decontamination_stage), ("packing", packing_stage)]

#: Tokenization is beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
