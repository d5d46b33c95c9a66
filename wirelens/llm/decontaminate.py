"""Which documents contain benchmark passages, by a prefix-filtered join with exact verification.

Every benchmark item becomes windows of ten words (a shorter item is one window).  A document that
contains a window contains each of its words, so one word is prefix enough: the rarest in the corpus.
Documents are joined with windows on that word alone.  The place of the word inside its window fixes
where the window would have to begin (positional bound) and whether it fits into the document (length
bound); what is left is compared word by word.

Windows are written once, so Spark knows their size: it broadcasts them below its threshold and
otherwise shuffles (document, position, word) rows, with the adaptive skew join for frequent words.
"""

from pyspark.sql import Column, DataFrame, functions as F

from wirelens.llm.common import ascii_lower, landed, let, row_key

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), lambda w: w != "")


def item_windows(items: DataFrame, item_id: str, text: str, width: int) -> DataFrame:
    """(item, window): the distinct windows of every item; a null item id counts as the empty name."""
    own = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"),
                       words(F.col(text)).alias("w")).where(F.size("w") > 0)
    def cut(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda s: F.slice(w, s + 1, width))
    return own.select("item", F.explode(let(F.col("w"), cut)).alias("window")).distinct()


def rarest_word(windows: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """(window, token, place): the word of each window that is rarest in ``docs``, at its first place."""
    placed = windows.select("window", F.posexplode("window").alias("place", "token"))
    known = landed(placed.select("token").distinct(), "benchmark-words")
    counts = (docs.select(F.explode_outer(words(F.col(text))).alias("token")).join(known, "token")
              .groupBy("token").agg(F.count("*").alias("n")))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "place"))
    return placed.join(counts, "token", "left").groupBy("window").agg(best.alias("best")).select(
        "window", "best.token", "best.place")


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text",
                  item_id: str = "item_id", item_text: str = "text", width: int = 10) -> DataFrame:
    """(k, doc_id, n_words, n_hit, items) for every row of ``docs``; ``k`` is ``row_key(id_col, text)``.

    ``items`` are the sorted ids of items with an occurring window.  A null text has no words; an item
    without words has no windows; items with equal ids count as one; repeated document rows each get
    their own, equal row.  Empty tables give no rows, or rows without hits.
    """
    belongs = landed(item_windows(items, item_id, item_text, width), "item-windows")
    prefix = landed(rarest_word(belongs.select("window").distinct(), docs, text), "window-prefixes")
    counted = docs.select(row_key(id_col, text).alias("k"), words(F.col(text)).alias("w"))
    begin = F.col("at") - F.col("place")
    candidates = (
        counted.select("k", F.size("w").alias("n"), F.posexplode_outer("w").alias("at", "token"))
        .join(prefix, "token")
        .where((begin >= 0) & (begin + F.size("window") <= F.col("n")))
        .groupBy("k").agg(F.collect_set(F.struct(begin.alias("begin"), "window")).alias("found")))
    full = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("body"), row_key(id_col, text).alias("k")).join(candidates, "k", "left")

    def verified(w: Column) -> Column:
        true = F.filter("found", lambda c: F.slice(w, c["begin"] + 1, F.size(c["window"])) == c["window"])
        return F.struct(F.size(w).cast("long").alias("n_words"), true.alias("true"))
    spans = F.flatten(F.transform("v.true", lambda c: F.sequence(c["begin"], c["begin"] + F.size(c["window"]) - 1)))
    judged = landed(
        full.select("k", "doc_id", let(words(F.col("body")), verified).alias("v"))
        .select("k", "doc_id", "v.n_words", F.when(F.size("v.true") > 0, F.size(F.array_distinct(spans))).otherwise(0).cast("long").alias("n_hit"),
                F.when(F.size("v.true") > 0, F.array_distinct(F.transform("v.true", lambda c: c["window"]))).alias("windows")),
        "judged-documents")
    named = (judged.where("n_hit > 0").select("k", F.explode("windows").alias("window")).distinct()
             .join(belongs, "window").groupBy("k").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return judged.drop("windows").join(named, "k", "left").withColumn(
        "items", F.coalesce("items", F.array().cast("array<string>")))
