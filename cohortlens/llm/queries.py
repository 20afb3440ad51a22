"""The registered queries ``opN_<name>`` and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (alignment, decontaminate, hard_negatives, hash_forest, language_id, license_scan, near_dedup, packing, quality_lm,
               quality_rules, substring_dedup, toxicity, url_filter)
from .common import read_table

def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it leaks."""
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    return decontaminate.find_leaks(docs, items).drop("__key")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url against the rules and a list: the canonical URLs of pages whose
    document (the number that ends the path) is labelled toxic."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    host, path = url_filter.url_host(F.col("url")), url_filter.url_path(F.col("url"))
    number = F.regexp_extract(path, r"/(\d{1,18})(?:\.html|/)?$", 1)
    toxic = read_table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    listed = (pages.select(F.when(number != "", number.cast("long")).alias("number"),
                           url_filter.canonical_url(host, path).alias("canonical"))
              .join(toxic, F.col("number") == F.col("doc_id"), "left_semi").select("canonical").distinct())
    return url_filter.filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = read_table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_lm.score_quality(read_table(spark, sf_dir, "documents"), trusted)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, with markup language and host of the pages they were crawled from."""
    evidence = language_id.page_evidence(read_table(spark, sf_dir, "pages"))
    return language_id.identify(read_table(spark, sf_dir, "documents"), evidence=evidence).drop("__key")


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_components(docs, shingle=3, num=85, den=100).drop("__key", "__group")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return packing.with_crc32(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source", "window")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").filter(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(docs, labels)
    return toxicity.score_toxicity(docs, model).select("doc_id", "held_out", "score", "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every 100th vector's positives and, per positive, its hard negatives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


def op12_hash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector, among all others."""
    return hash_forest.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS tail FROM pages),
p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(tail, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(tail, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
c AS (
  SELECT *, CASE WHEN host <> '' THEN
    regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^(www|m|blog)\.', '')
    || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') END AS canonical,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN canonical IN (
         SELECT canonical FROM c WHERE canonical IS NOT NULL
           AND try_cast(regexp_extract(path, '/(\d{1,18})(?:\.html|/)?$', 1) AS BIGINT)
             IN (SELECT doc_id FROM labels WHERE toxic = 1)) THEN 'block'
       ELSE 'allow' END AS verdict
FROM c
"""

OP7_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) FROM rep) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(cov.n, 0) AS n_repeat_words,
    len(list_distinct(list_intersect(words, %STOP%))) AS n_stop_kinds,
    len(list_filter(lines, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipsis_lines
  FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words BETWEEN 10 AND 1000000 AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
  AND n_symbols <= 0.3::DOUBLE * n_words AND NOT (n_words >= 60 AND n_stop_kinds < 1)
  AND n_dup_lines <= 0.5::DOUBLE * n_lines AND n_ellipsis_lines <= 0.5::DOUBLE * n_lines AS kept
FROM b
""".replace("%STOP%", "[" + ", ".join(f"'{w}'" for w in sorted(
    {w for ws in quality_rules.STOP_WORDS.values() for w in ws})) + "]")

OP11_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same, list_dot_product(a.v, r.v)::BIGINT AS score
  FROM r AS a, r WHERE a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_url_filter": op2_url_filter,
    "op3_license_scan": op3_license_scan,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_language_id": op5_language_id,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality_rules": op7_quality_rules,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_hash_forest": op12_hash_forest,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

SQL = {
    "op2_url_filter": OP2_SQL,
    "op7_quality_rules": OP7_SQL,
    "op11_hard_negatives": OP11_SQL,
}
