"""URL verdicts from fixed host rules and from mined token combinations.

Labelled urls become sets of tokens (host suffixes, path segments, scheme, query keys) plus their
label.  Of tokens that always stand together one is kept, so a site whose urls all share a long tail of
tokens does not multiply combinations.  Spark's FP-growth mines the sets that are frequent enough; rules
"tokens -> label" are kept if support, confidence and lift pass, and dropped when a shorter rule already
says the same.  To apply them, each rule is indexed under its rarest token; urls meet only the rules of
tokens they have, and the other tokens of a rule are then looked up in the url's own set.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from wirelens.llm.common import ascii_lower, landed, row_key

LABEL = "!bad"  # no url token begins with '!'


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    after = F.substring(rest, F.length(host) + 1, F.length(rest))
    return ascii_lower(host), F.regexp_extract(after, r"^([^?#]*)", 1)


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of ``rules`` (verdict, host, path) that fits, as struct(rule, verdict), or null.

    A rule fits its host and every subdomain if the path begins with the rule's path.  Rules are a
    configuration list, not data.
    """
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens(url: Column) -> Column:
    """Distinct tokens of a url: s:scheme, h:host suffix, p:path segment (digits as one class), q:query key."""
    host, path = host_path(url)
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(
        F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    segments = F.transform(F.split(path, "/"), lambda s: F.concat(F.lit("p:"), F.regexp_replace(s, "[0-9]+", "0")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda s: F.concat(F.lit("q:"), F.regexp_extract(s, "^([^=]*)", 1)))
    scheme = F.array(F.concat(F.lit("s:"), ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^([A-Za-z]+)://", 1))))
    every = F.concat(scheme, F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), segments, keys)
    return F.array_distinct(F.filter(every, lambda t: ~t.isin("h:", "p:", "q:", "s:")))


def without_twins(labelled: DataFrame) -> DataFrame:
    """(k, bad, items) with one token, the first by name, of those that occur in exactly the same rows."""
    each = labelled.select("k", "bad", F.explode("items").alias("token"))
    signs = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("k")).alias("x"),
                                      F.bit_xor(F.xxhash64(F.lit("t"), "k")).alias("y"))
    kept = signs.groupBy("n", "x", "y").agg(F.min("token").alias("token")).select("token")
    return each.join(kept, "token").groupBy("k", "bad").agg(F.collect_list("token").alias("items"))


def mine_rules(labelled: DataFrame, items: str, bad: str, min_support: float, min_count: int, min_confidence: float,
               min_lift: float) -> DataFrame:
    """(tokens, n, n_bad): combinations that point to the bad label.

    ``labelled`` has a token array and a boolean.  Support counts urls with the tokens and the label, as a
    share and at least ``min_count``; confidence is their share among urls with the tokens; lift compares
    it with the share of bad urls.
    """
    marked = labelled.select(F.when(F.col(bad), F.concat(F.col(items), F.array(F.lit(LABEL)))).otherwise(F.col(items)).alias("items"))
    total, n_bad = labelled.agg(F.count("*"), F.coalesce(F.sum(F.col(bad).cast("long")), F.lit(0))).first()
    shape = "tokens array<string>, n long, n_bad long"
    if not n_bad:
        return labelled.sparkSession.createDataFrame([], shape)
    support = min(max(min_support, (min_count - 0.5) / total), 1.0)
    sets = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(marked).freqItemsets
    with_bad = sets.where(F.array_contains("items", LABEL)).select(
        F.array_sort(F.array_remove("items", LABEL)).alias("tokens"), F.col("freq").alias("n_bad")).where(F.size("tokens") > 0)
    plain = sets.where(~F.array_contains("items", LABEL)).select(F.array_sort("items").alias("tokens"), F.col("freq").alias("n"))
    rules = with_bad.join(plain, "tokens").where(
        (F.col("n_bad") >= F.lit(min_confidence) * F.col("n"))
        & (F.col("n_bad") * F.lit(total) >= F.lit(min_lift * n_bad) * F.col("n")))
    return rules.select("tokens", "n", "n_bad")


def prune_implied(rules: DataFrame) -> DataFrame:
    """Without rules that contain a shorter rule: what they match, the shorter one matches."""
    single = rules.select(F.xxhash64("tokens").alias("id"), "tokens", F.explode("tokens").alias("token"))
    shorter = rules.select(F.col("tokens").alias("part"), F.element_at("tokens", 1).alias("token"))
    implied = (single.join(shorter, "token").where((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
               .select("tokens").distinct())
    return rules.join(implied, "tokens", "left_anti")


def matched_urls(urls: DataFrame, key: str, items: str, rules: DataFrame) -> DataFrame:
    """Distinct ``key`` of the urls that hold all tokens of some rule, through the index of rarest tokens."""
    placed = rules.select("tokens", F.explode("tokens").alias("token"))
    weight = placed.groupBy("token").agg(F.sum(F.lit(1)).alias("rules"))
    index = (placed.join(weight, "token").groupBy("tokens").agg(F.min(F.struct("rules", "token")).alias("best"))
             .select("tokens", F.col("best.token").alias("token")))
    meets = urls.select(key, F.col(items).alias("own"), F.explode(items).alias("token")).join(index, "token")
    return meets.where(F.size(F.array_except("tokens", "own")) == 0).select(key).distinct()


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], page_id: str = "page_id",
               url: str = "url", label_id: str = "doc_id", bad: Column | None = None, min_support: float = 0.002,
               min_count: int = 5, min_confidence: float = 0.5, min_lift: float = 2.0) -> DataFrame:
    """(row, host, path, rule, verdict, mined) for every row of ``pages``.

    The mined rules learn from all pages whose id is labelled; a row is bad if ``bad`` holds (default
    toxic = 1 or quality = 0) and a null label value counts as not bad.  Fixed rules win over mined
    ones; what neither blocks is allowed.  A null url, or one without ``://``, has empty host and path
    and no host or path tokens.  Several labels of one id: bad if any is.  Pages with equal id and url count
    once when rules are mined; each has its own row in the result.  Empty tables give no rows, or no mined
    rules.
    """
    bad = (F.col("toxic") == 1) | (F.col("quality") == 0) if bad is None else bad
    known = labels.select(F.col(label_id).alias("_label_id"), F.coalesce(bad, F.lit(False)).alias("bad")).groupBy("_label_id").agg(
        F.max("bad").alias("bad"))
    whole = F.struct("*").alias("row")
    own = pages.select(whole, row_key(page_id, url).alias("k"), tokens(F.col(url)).alias("items"))
    learned = (own.select("k", F.col(f"row.{page_id}").alias("_label_id"), "items").join(known, "_label_id")
               .dropDuplicates(["k"]).select("k", "bad", "items"))
    learned = landed(without_twins(landed(learned, "labelled-urls")), "url-tokens")
    mined = landed(prune_implied(mine_rules(learned, "items", "bad", min_support, min_count, min_confidence, min_lift)), "url-rules")
    hit = matched_urls(own.select("k", "items"), "k", "items", mined).withColumn("mined", F.lit(True))
    host, path = host_path(F.col(f"row.{url}"))
    judged = own.join(hit, "k", "left").select("row", host.alias("host"), path.alias("path"), F.coalesce("mined", F.lit(False)).alias("mined"))
    fixed = fixed_rule(F.col("host"), F.col("path"), rules)
    return judged.select("row", "host", "path", fixed["rule"].alias("rule"), F.coalesce(
        fixed["verdict"], F.when(F.col("mined"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined")
