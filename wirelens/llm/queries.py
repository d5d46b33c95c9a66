"""Registered queries of the training-data operators, with check SQL where SQL can express them."""

import corpus_pipeline
from pyspark.sql import functions as F

from wirelens.llm import (decontaminate, language_model, line_dedup, near_dedup, packing, repetition, sharding, suffix_dedup,
                          token_files, url_rules)
from wirelens.llm import queries_more
from wirelens.llm.common import documents
from wirelens.llm.settings import LIMITS, MIN_DOCUMENTS, NEAR, PACKING, WIDTH, tokenizer

QUERIES, ORACLES = {}, {}

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


SQL_1 = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (SELECT doc_id, h, CAST(length(h) / 2 AS BIGINT) AS n FROM raw),
windows AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 100)) AS w
            FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM sized WHERE n >= 50)),
firsts AS (SELECT w, min(doc_id) AS d FROM windows GROUP BY w),
hits AS (SELECT doc_id, i FROM windows JOIN firsts USING (w) WHERE d < doc_id),
placed AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM placed GROUP BY doc_id, run),
marked AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                     THEN 0 ELSE 1 END AS fresh FROM runs),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM marked),
spans AS (SELECT doc_id, min(a) AS a, max(b) AS b FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
         UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
left_over AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (coalesce(b, n) - a) AS BIGINT)), '' ORDER BY a) AS h
              FROM gaps g JOIN sized s ON g.doc_id = s.doc_id GROUP BY g.doc_id),
counted AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT s.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(l.h, s.h))) AS kept_sha256
FROM sized s LEFT JOIN counted c ON s.doc_id = c.doc_id LEFT JOIN left_over l ON s.doc_id = l.doc_id
"""


@query("op1_suffix_dedup", SQL_1)
def op1(spark, sf_dir):
    return suffix_dedup.dedup_substrings(documents(spark, sf_dir), length=50)


SQL_2 = rf"""
WITH doc AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + 10], ' ') AS win, least(len(w), 10) AS size
            FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, i, array_to_string(w[i + 1:i + size], ' ') AS win
           FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM doc, sizes WHERE len(w) >= size)),
hits AS (SELECT doc_id, item, i, p.size AS size FROM places p JOIN windows v ON p.win = v.win AND p.size = v.size),
words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(len(items.items), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(items.items, ','), '')) AS items_sha256,
       coalesce(words.n, 0) > 0 AS contaminated
FROM doc d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""


@query("op2_decontamination", SQL_2)
def op2(spark, sf_dir):
    found = decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=WIDTH)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL_3 = rf"""
WITH lines AS (SELECT doc_id, i, l[i] AS line, regexp_replace(translate(l[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                      '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS key
               FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i
                     FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
frequent AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCUMENTS}),
marked AS (SELECT *, key IN (SELECT key FROM frequent) AS gone FROM lines)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op3_line_dedup", SQL_3)
def op3(spark, sf_dir):
    kept = line_dedup.dedup_lines(documents(spark, sf_dir), min_documents=MIN_DOCUMENTS)
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL_4 = rf"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
         FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM doc WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id
           GROUP BY x.doc_id, y.doc_id),
edges AS (SELECT a, b FROM common JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
lowest AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT l.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, l.doc_id = component_id AS kept
FROM lowest l LEFT JOIN sizes s ON l.doc_id = s.doc_id
"""


@query("op4_near_dedup", SQL_4)
def op4(spark, sf_dir):
    return near_dedup.near_duplicates(documents(spark, sf_dir), **NEAR).drop("node")


@query("op5_lm_scoring")
def op5(spark, sf_dir):
    return language_model.score_corpus(documents(spark, sf_dir), order=3).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op6_packing")
def op6(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), tokenizer(), **PACKING).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def quality_sql(rows: str) -> str:
    """Counts and verdict from windows: a word lies in a repeat of m words or more if an m-word window around it is repeated."""
    m = LIMITS
    return rf"""
WITH doc AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {rows}),
places AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
words AS (SELECT doc_id, i, w[i] AS word FROM places),
grams AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS g
          FROM places, (VALUES ({m['window']}), ({m['min_repeat']}), ({m['max_repeat'] + 1})) AS s(size) WHERE i + size - 1 <= len(w)),
repeated AS (SELECT doc_id, i, size FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, size, g) AS n FROM grams) WHERE n > 1),
inside AS (SELECT DISTINCT doc_id, size, unnest(range(i, i + size)) AS i FROM repeated),
counted AS (SELECT x.doc_id, count(*) FILTER (WHERE size = {m['window']}) AS n_repeat_words,
                   sum(length(word)) FILTER (WHERE size = {m['min_repeat']}) AS repeated_chars,
                   count(*) FILTER (WHERE size = {m['max_repeat'] + 1}) AS too_long
            FROM inside x JOIN words v ON x.doc_id = v.doc_id AND x.i = v.i GROUP BY x.doc_id),
chars AS (SELECT doc_id, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
          FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM doc)
          WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
       CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
       CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(repeated_chars, 0) AS repeated_chars, coalesce(too_long, 0) AS too_long
  FROM doc d LEFT JOIN chars c ON d.doc_id = c.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id LEFT JOIN counted r ON d.doc_id = r.doc_id),
failed AS (SELECT *, n_words < {m['min_words']} OR 100 * n_repeat_words > {m['max_window_percent']} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * repeated_chars <= {m['max_repeated_percent']} * word_chars AND too_long = 0 AS kept FROM failed
"""


@query("op7_quality_rules", quality_sql("documents"))
def op7(spark, sf_dir):
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return repetition.judge_documents(documents(spark, sf_dir), **LIMITS).select("row.doc_id", *[f"q.{f}" for f in fields])


@query("op8_token_files")
def op8(spark, sf_dir):
    return token_files.round_trip(documents(spark, sf_dir), tokenizer(), end_id=PACKING["end_id"])


SQL_9 = r"""
WITH rests AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^([^/?#]*)', 1) AS h FROM rests),
paths AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM hosts),
parts AS (SELECT *, string_split(host, '.') AS labels, string_split(path, '/') AS segments,
                 string_split(regexp_extract(coalesce(url, ''), '\?([^#]*)', 1), '&') AS keys,
                 lower(regexp_extract(coalesce(url, ''), '^([A-Za-z]+)://', 1)) AS scheme FROM paths),
tokens AS (SELECT DISTINCT page_id, url, token FROM (
    SELECT page_id, url, 's:' || scheme AS token FROM parts
    UNION ALL SELECT page_id, url, 'h:' || array_to_string(labels[i:len(labels)], '.')
              FROM (SELECT *, unnest(range(1, len(labels) + 1)) AS i FROM parts WHERE host <> '')
    UNION ALL SELECT page_id, url, 'p:' || regexp_replace(segment, '[0-9]+', '0', 'g') FROM (SELECT *, unnest(segments) AS segment FROM parts)
    UNION ALL SELECT page_id, url, 'q:' || regexp_extract(key, '^([^=]*)', 1) FROM (SELECT *, unnest(keys) AS key FROM parts))
    WHERE token NOT IN ('s:', 'h:', 'p:', 'q:')),
known AS (SELECT doc_id, bool_or(coalesce(toxic = 1, FALSE) OR coalesce(quality = 0, FALSE)) AS bad FROM labels GROUP BY doc_id),
learned AS (SELECT DISTINCT page_id, url, token, bad FROM tokens JOIN known ON page_id = doc_id),
signs AS (SELECT token, string_agg(page_id || ' ' || url, ' ' ORDER BY page_id, url) AS sign FROM learned GROUP BY token),
heads AS (SELECT min(token) AS token FROM signs GROUP BY sign),
sets AS (SELECT page_id, url, bad, list_sort(list(token)) AS t FROM learned WHERE token IN (SELECT token FROM heads) GROUP BY page_id, url, bad),
total AS (SELECT count(*) AS n, count(*) FILTER (WHERE bad) AS bad FROM sets),
subsets AS (SELECT bad, [t[i] FOR i IN range(1, len(t) + 1) IF (mask >> CAST(i - 1 AS INTEGER)) & 1 = 1] AS t
            FROM (SELECT bad, t, unnest(range(1, CAST(1 << len(t) AS BIGINT))) AS mask FROM sets)),
counted AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE bad) AS bad FROM subsets GROUP BY t),
rules AS (SELECT c.t FROM counted c, total WHERE c.bad >= ceil(greatest(0.002 * total.n, 4.5)) AND c.bad >= 0.5 * c.n AND c.bad * total.n >= 2 * total.bad * c.n),
own AS (SELECT page_id, url, list(token) AS t FROM tokens GROUP BY page_id, url),
mined AS (SELECT DISTINCT page_id, url FROM own o JOIN rules r ON list_has_all(o.t, r.t)),
fixed AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS v(h, p, verdict)),
fits AS (SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
         FROM paths JOIN fixed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id, url)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, CASE WHEN m.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
FROM paths p LEFT JOIN fits f ON p.page_id = f.page_id AND p.url IS NOT DISTINCT FROM f.url LEFT JOIN mined m ON p.page_id = m.page_id AND p.url = m.url
"""


@query("op9_url_filters", SQL_9)
def op9(spark, sf_dir):
    judged = url_rules.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), spark.read.parquet(f"{sf_dir}/labels.parquet"), RULES)
    return judged.select("row.page_id", "host", "path", "rule", "verdict")


@query("op10_sharding")
def op10(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    own = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                                          F.crc32(text.cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(own, ["doc_id"], 16)
    return placed.select("row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                         F.lit(None).cast("int").alias("grown_shard"))


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)

QUERIES.update(queries_more.QUERIES)
ORACLES.update(queries_more.ORACLES)
