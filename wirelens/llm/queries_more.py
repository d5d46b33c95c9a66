"""Registered queries of the scans, the alignment and the trie, with check SQL where SQL can express them."""

from pyspark.sql import functions as F

from wirelens.llm import prefix_trie, secret_scan, token_alignment
from wirelens.llm.common import documents
from wirelens.llm.secret_rules import RULES
from wirelens.llm.settings import aligned_tokenizers

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return register


def _found_sql(place, rule):
    """Spans of one rule in DuckDB: a match begins after the texts between matches and the matches before it."""
    pattern = rule.pattern.replace("'", "''")
    return rf"""
SELECT doc_id, {place} AS rule, '{rule.kind}' AS kind, {rule.base} AS base, s AS a, s + length(m[i]) AS b FROM (
    SELECT doc_id, m, z, i, CAST(list_sum([length(g[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(m[j]) FOR j IN range(1, i)]), 0) AS BIGINT) AS s FROM (
        SELECT doc_id, m, z, g, unnest(range(1, len(m) + 1)) AS i FROM (
            SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS z,
                   string_split_regex(text, '{pattern}') AS g FROM documents WHERE regexp_matches(text, '{pattern}')))
    WHERE length(z[i]) >= {rule.least})"""


SQL_11 = f"""
WITH found AS ({" UNION ALL ".join(_found_sql(i, rule) for i, rule in enumerate(RULES))}),
named AS (SELECT *, kind || ':' || a || ':' || b AS name FROM found),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
               count(*) FILTER (WHERE kind = 'hex') AS n_hex, string_agg(name, ',' ORDER BY a, rule) FILTER (WHERE base) AS base,
               string_agg(name, ',' ORDER BY a, rule) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN per p ON d.doc_id = p.doc_id
"""


@query("op11_secret_scan", SQL_11)
def op11(spark, sf_dir):
    found = secret_scan.scan_secrets(documents(spark, sf_dir), keep=["doc_id"])
    name = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([rule.kind for rule in RULES if rule.base]))
    return found.select("row.doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(F.array_join(F.transform(base, name), ",").cast("binary"), 256).alias("base_sha256"),
                        F.array_join(F.transform("spans", name), ",").alias("spans"))


@query("op12_token_alignment")
def op12(spark, sf_dir):
    return token_alignment.align_tokenizers(documents(spark, sf_dir), *aligned_tokenizers()).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


SQL_13 = r"""
WITH RECURSIVE turns AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
    FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id AS c, list({'r': r, 'x': x} ORDER BY i) AS s FROM turns GROUP BY conv_id),
bits(n, k, v) AS (SELECT range, 0, range FROM range(256)
                  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8),
tab AS (SELECT n, v FROM bits WHERE k = 8),
crc(c, k, v) AS (SELECT c, 0, CAST(4294967295 AS BIGINT) FROM own
    UNION ALL SELECT c, k + 1, xor(tab.v, crc.v // 256) FROM crc JOIN tab
        ON tab.n = xor(crc.v % 256, ascii(substr(CAST(c AS VARCHAR), k + 1, 1))) WHERE k < length(CAST(c AS VARCHAR))),
h AS (SELECT c, 3 - v % 4 AS h FROM crc WHERE k = length(CAST(c AS VARCHAR))),
built AS (SELECT o.c, list_concat(coalesce(b.s[1:h.h], []), o.s[h.h + 1:]) AS s
          FROM own o JOIN h ON o.c = h.c LEFT JOIN own b ON b.c = o.c - o.c % 20),
prefixes AS (SELECT c, s[1:d] AS p, d, d = len(s) AS ended FROM (SELECT c, s, unnest(range(len(s) + 1)) AS d FROM built)),
nodes AS (SELECT p, d, min(c) AS conv_id, count(*) AS n, count(*) FILTER (WHERE ended) AS n_ends,
                 coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ended), '') AS ends,
                 (count(*) - 1) * len(regexp_extract_all(coalesce(p[d].x, ''), '[^\x20\x09-\x0D]+')) AS saved FROM prefixes GROUP BY p, d),
above AS (SELECT a.p AS p, sum(CASE WHEN b.n = b.n_ends THEN 1 ELSE 0 END) AS leaves, sum(b.saved) AS saved,
                 count(*) FILTER (WHERE b.d = a.d + 1) AS children
          FROM nodes a JOIN (SELECT *, unnest(range(d + 1)) AS k FROM nodes) b ON b.k = a.d AND b.p[1:b.k] = a.p GROUP BY a.p)
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n AS n_convs, CAST(a.children AS BIGINT) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN above a ON n.p = a.p LEFT JOIN nodes up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1:n.d - 1]
"""


@query("op13_prefix_trie", SQL_13)
def op13(spark, sf_dir):
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
