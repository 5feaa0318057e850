"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm import bpe, dedup, licenses, maxent, mixing, onebit_ann, packing, quality, secrets, url_rules
from churnscope.llm.common import table

_SQL_WORD = r"[^\x20\x09-\x0D]+"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs)
    return mixed.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).cast("long").alias("taken"),
    )


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_SQL_WORD}'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 3 * source_size AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM c WINDOW w AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT min(level) FILTER (cap / weight = lowest AND level * weight <= cap) AS final FROM (
  SELECT *, min(cap / weight) FILTER (level * weight <= cap) OVER () AS lowest FROM l)),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(final * weight, cap::DOUBLE)) AS target FROM l, f),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    found = secrets.scan_secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
    of_kind = lambda kind: lambda s: s["kind"] == kind
    n = lambda test: F.size(F.filter("_secrets", test)).cast("long")
    return found.select(
        "doc_id", *[n(of_kind(k)).alias(f"n_{k}") for k in ("assign", "access", "hex", "mixed")],
        F.sha2(secrets.listed(F.filter("_secrets", lambda s: s["kind"] != "mixed")), 256).alias("base_sha256"),
        secrets.listed(F.col("_secrets")).alias("spans"),
        n(lambda s: s["is_example"]).alias("n_example"),
    )


def _kind_sql(order: int, kind: secrets.Kind) -> str:
    pattern = kind.pattern.replace("'", "''")
    tests = "".join(f" AND regexp_matches(secret, '{x}')" for x in kind.needs)
    return rf"""
SELECT rid, {order} AS kind_order, '{kind.name}' AS kind, start, start + len(whole) AS stop, secret FROM (
  SELECT rid, whole[i] AS whole, secrets[i] AS secret,
         list_sum(list_transform(gaps[1:i], lambda x: len(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i-1], lambda x: len(x))), 0)::BIGINT AS start
  FROM (SELECT rid, string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 1) AS whole,
               regexp_extract_all(t, '{pattern}', {kind.group}) AS secrets FROM d WHERE regexp_matches(t, '{pattern}')), unnest(range(1, len(whole) + 1)) AS u(i)
) WHERE len(secret) >= {kind.least}{tests}"""


_SHARING = secrets.Sharing()
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, coalesce(text, '') AS t FROM documents),
b AS ({" UNION ALL ".join(_kind_sql(i, k) for i, k in enumerate(secrets.KINDS) if k.base)}),
x AS ({" UNION ALL ".join(_kind_sql(i, k) for i, k in enumerate(secrets.KINDS) if not k.base)}),
a AS (SELECT * FROM b UNION ALL SELECT * FROM x WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE b.rid = x.rid AND b.start < x.stop AND x.start < b.stop)),
h AS (SELECT secret, count(DISTINCT coalesce('=' || source, '')) AS owners,
             count(DISTINCT coalesce('=' || source, '') || '/' || concat_ws('/', source, lang)) AS repos FROM a JOIN d USING (rid) GROUP BY secret),
o AS (SELECT secret, owners >= {_SHARING.owners} OR (owners >= {_SHARING.few} AND repos >= {_SHARING.repos}) AS is_example FROM h),
j AS (SELECT a.*, is_example FROM a JOIN o USING (secret) WHERE kind <> 'mixed' OR NOT is_example),
r AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, count(*) FILTER (kind = 'mixed') AS n_mixed, count(*) FILTER (is_example) AS n_example,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) FILTER (kind <> 'mixed') AS base,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) AS spans FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
       coalesce(n_mixed, 0)::BIGINT AS n_mixed, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0)::BIGINT AS n_example
FROM d LEFT JOIN r USING (rid)
"""


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return onebit_ann.nearest(vectors, F.col("vec_id") % 100 == 0)


def op5_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    q = "_q_quality."
    return quality.quality_rules(docs).select(
        "doc_id", *[q + c for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")],
    )


_STOP_SQL = ", ".join(f"'{w}'" for w in quality.STOP_WORDS)
OP7_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
e AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{_SQL_WORD}') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_SQL_WORD}')) AS ls FROM d),
u AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM e),
h AS (SELECT rid, i, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o,
             lead(w, 5) OVER o, lead(w, 6) OVER o, lead(w, 7) OVER o) AS win, lead(w, 7) OVER o AS last
      FROM u WINDOW o AS (PARTITION BY rid ORDER BY i)),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM h WHERE last IS NOT NULL),
p AS (SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM g, range(8) AS r(k) WHERE n > 1 GROUP BY rid),
m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP_SQL})))::BIGINT AS n_stop_words
  FROM e LEFT JOIN p USING (rid)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS mean_word,
             CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0 END AS symbols,
             CASE WHEN n_words > 0 THEN n_stop_words::DOUBLE / n_words ELSE 0 END AS stops,
             CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dups,
             CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeats FROM m),
v AS (SELECT *, CASE WHEN n_words < 20 THEN 'too_short' WHEN mean_word < 2.0 OR mean_word > 20.0 THEN 'word_length'
                     WHEN symbols > 0.30::DOUBLE THEN 'symbols' WHEN stops < 0.02::DOUBLE THEN 'stop_words'
                     WHEN dups > 0.40::DOUBLE THEN 'repeated_lines' WHEN repeats > 0.30::DOUBLE THEN 'repeated_words' END AS rule FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rule IS NULL AS kept, rule FROM v
"""

def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.when(bad, F.lit("block")).otherwise(F.lit("allow")).alias("verdict"))
    return url_rules.url_filter(pages, labels).select("page_id", *[f"_url.{c}" for c in ("host", "path", "rule", "verdict", "mined")])


def url_fixed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op8_urls that SQL can express: host, path, and the fixed rules' verdict."""
    u = F.col("u")
    return table(spark, sf_dir, "pages").select("page_id", url_rules.judged_by_rules(F.col("url")).alias("u")).select(
        "page_id", u["host"].alias("host"), u["path"].alias("path"), u["rule"].alias("rule"), u["base"].alias("base"))


_RULES_SQL = ", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in url_rules.BASE_RULES)
FIXED_RULES_SQL = f"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT * FROM (VALUES {_RULES_SQL}) AS v(rule_host, rule_path, verdict)),
m AS (SELECT rid, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule, arg_max(verdict, len(rule_host || rule_path)) AS base
      FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY rid)
SELECT page_id, host, path, rule, base FROM p LEFT JOIN m USING (rid)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.bpe_encode(docs, ranks, public_tokenizers.PATTERN).select("doc_id", "_ids")
    return bpe.bpe_decode(encoded, ranks).select(
        "doc_id", bpe.n_ids(F.col("_ids")).alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"), F.sha2("_bytes", 256).alias("decoded_sha256"),
    )


QUERIES = {"op1_mixing": op1_mixing, "op2_secrets": op2_secrets, "op3_lm": op3_lm, "op4_ann": op4_ann, "op5_dedup": op5_dedup, "op6_packing": op6_packing, "op7_quality": op7_quality, "op8_urls": op8_urls, "url_fixed_rules": url_fixed_rules, "op9_licenses": op9_licenses, "op10_bpe": op10_bpe}
ORACLES = {"op1_mixing": OP1_SQL, "op2_secrets": OP2_SQL, "op7_quality": OP7_SQL, "url_fixed_rules": FIXED_RULES_SQL}
