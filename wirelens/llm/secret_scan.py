"""Secrets in texts by rules of patterns, with a trigram index that says where a rule can match at all.

Every rule's pattern implies a Boolean query over trigrams.  The index holds, for each trigram that some rule asks
for, the documents whose text has it (A-Z lower-cased), sorted by trigram and document.  Postings of a conjunction are
intersected by grouping: a document that has all its trigrams is a candidate of the rule.  Candidates are
verified with the pattern itself; a rule without mandatory trigrams is looked for in every document.

Everything is columns and built-in functions.  Rules are configuration; what they become are literals.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from wirelens.llm.common import ascii_lower, landed, row_key
from wirelens.llm.secret_rules import RULES, Rule


def trigram_index(docs: DataFrame, trigrams: Sequence[str], key: str = "key", text: str = "text") -> DataFrame:
    """(trigram, key): the postings of ``trigrams``, distinct, as shards that are each sorted by trigram.

    Texts are compared with A-Z lower-cased; a null or empty text has no trigrams.  Postings are dealt by trigram and
    document, so a hot trigram, or a key that many equal rows share, is no larger in one shard than another; a
    reader of some trigrams skips the rest of a shard.
    """
    asked = F.array(*[F.lit(t) for t in trigrams])
    lower = docs.select(F.col(key).alias("key"), ascii_lower(F.col(text)).alias("lower"))
    postings = lower.select(F.explode(F.filter(asked, lambda t: F.contains("lower", t))).alias("trigram"), F.col("key").alias(key))
    return landed(postings.distinct().sortWithinPartitions("trigram"), "postings")


def candidates(postings: DataFrame, rules: Sequence[Rule], key: str = "key") -> DataFrame:
    """(key, rules): the documents that hold all trigrams of some alternative of a rule."""
    asked: dict[str, list] = {}
    full = {}
    for r, rule in enumerate(rules):
        for a, alternative in enumerate(rule.query):
            full[(r, a)] = (1 << len(alternative)) - 1
            for place, trigram in enumerate(alternative):
                asked.setdefault(trigram, []).append((r, a, 1 << place))
    uses = F.create_map(*[c for trigram, places in asked.items() for c in (F.lit(trigram), F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(a).alias("way"), F.lit(bit).cast("long").alias("bit")) for r, a, bit in places]))])
    wanted = F.create_map(*[c for (r, a), mask in full.items() for c in (F.struct(F.lit(r).alias("rule"), F.lit(a).alias("way")), F.lit(mask).cast("long"))])
    held = (postings.select(key, F.inline(F.element_at(uses, F.col("trigram")))).groupBy(key, "rule", "way")
            .agg(F.bit_or("bit").alias("bits")))
    whole = held.where(F.col("bits") == F.element_at(wanted, F.struct("rule", "way")))
    return whole.groupBy(key).agg(F.sort_array(F.collect_set("rule")).alias("rules"))


def _lengths(text: Column, rule: Rule) -> Column:
    """Lengths of what stands before each match, of the match, and of the group that decides."""
    pattern = F.lit(rule.pattern)
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    group = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    return F.transform(F.arrays_zip(matches.alias("m"), F.slice(gaps, F.lit(1), F.size(matches)).alias("g"), group.alias("z")),
                       lambda x: F.struct(F.char_length(x["g"]).alias("gap"), F.char_length(x["m"]).alias("length"), F.char_length(x["z"]).alias("decides")))


def scan_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES, id_col: str = "doc_id", text: str = "text",
                 keep: Sequence[str] | None = None) -> DataFrame:
    """(row, spans) for every row of ``docs``: spans as struct(start, rule, end, kind), sorted, in code points, end exclusive.

    ``rule`` is the rule's place in ``rules``; spans of one rule do not overlap, those of several may.  A null or empty
    text has no spans (an empty array).  Rows that agree in id and text share what is found and each has its row; so
    do null ids.  ``row`` holds the columns to ``keep``, all by default, and they may have any name; without the text
    among them no text is shuffled back.  An empty table gives no rows.
    """
    own = docs.select(F.struct(*(docs.columns if keep is None else keep)).alias("row"), row_key(id_col, text).alias("key"), F.col(text).alias("t"))
    everywhere = [(r, rule) for r, rule in enumerate(rules) if not rule.query]
    indexed = [(r, rule) for r, rule in enumerate(rules) if rule.query]
    parts = [own.where(F.col("t").rlike(rule.pattern)).select("key", F.lit(r).alias("rule"), _lengths(F.col("t"), rule).alias("found"))
             for r, rule in everywhere]
    if indexed:
        asked = sorted({t for _, rule in indexed for way in rule.query for t in way})
        postings = trigram_index(own.select("key", "t"), asked, text="t")
        named = landed(candidates(postings, rules), "candidates")
        tried = own.select("key", "t").join(named, "key")
        each = F.array(*[F.when(F.array_contains("rules", r) & F.col("t").rlike(rule.pattern), F.struct(
            F.lit(r).alias("rule"), _lengths(F.col("t"), rule).alias("found"))) for r, rule in indexed])
        parts.append(tried.select("key", F.inline(F.filter(each, lambda x: x.isNotNull()))))
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # rows that agree have the same key and lengths: one of them says where the spans are
    found = landed(found, "matches").dropDuplicates(["key", "rule"])
    each = found.select("key", "rule", F.posexplode("found").alias("at", "x")).select("key", "rule", "at", "x.*")
    running = Window.partitionBy("key", "rule").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(running))
    least = F.array(*[F.lit(rule.least) for rule in rules])
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    passed = each.where(F.col("decides") >= F.get(least, F.col("rule")))
    span = F.struct((F.col("end") - F.col("length")).alias("start"), "rule", "end", F.get(kinds, F.col("rule")).alias("kind"))
    spans = passed.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint,kind:string>>")
    return own.select("row", "key").join(spans, "key", "left").select("row", F.coalesce("spans", none).alias("spans"))
