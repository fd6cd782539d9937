"""The queries of this subpackage by name, and SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, dedup, extraction, jaccard_join, mixing, packing, quality, secrets, topk, toxicity, urls, warc, whitening
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


ORACLE_SQL["op1_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
banded AS (
  SELECT *, length(bin(size)) * 16 + CASE WHEN length(bin(size)) > 4 THEN size >> (length(bin(size)) - 4) ELSE size END AS band,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 64 AS sub
  FROM sized),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY band, sub, size, doc_id NULLS FIRST) - 1 AS position FROM banded),
sources AS (
  SELECT key, source, sum(size)::BIGINT AS source_size,
         [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY key, source),
levels AS (
  SELECT *, 3.0::DOUBLE * source_size AS lim,
         (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER above, 0.0))
           / (sum(weight) OVER () - coalesce(sum(weight) OVER above, 0.0)) AS level,
         row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST) AS place
  FROM sources
  WINDOW above AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0.0 ELSE least(lim, weight * (SELECT arg_min(level, place) FROM levels WHERE level * weight <= lim)) END AS target
  FROM levels),
counted AS (
  SELECT p.*, source_size, target, ('0x' || substr(md5('mix' || p.key), 1, 4))::BIGINT::DOUBLE / 65536 AS u,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate
  FROM placed p JOIN plan USING (key)),
copied AS (
  SELECT *, least(floor(rate * (position + 1) + u) - floor(rate * position + u), 3)::BIGINT AS copies FROM counted)
SELECT doc_id, size, source_size, target::DOUBLE AS target, copies * size AS taken, source, copies FROM copied
"""
QUERIES["op1_mix_sources"] = op1_mix_sources

#: The contract's rules.
URL_RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [urls.host_rule(*r) for r in URL_RULES] + list(urls.DEFAULT_RULES)
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    listed = F.col("rule").isin([r for _, r in URL_RULES])
    return judged.select("page_id", "host", "path", F.when(listed, F.col("rule")).alias("rule"), "verdict", F.when(~listed, F.col("rule")).alias("pattern_rule"))


ORACLE_SQL["op5_url_filter"] = (
    r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_extract(host || path, '^(?:[^/]*[.-])?(?:WORDS)[.-]') AS junk,
    (SELECT max('word:' || w) FROM (SELECT unnest([LIST]) AS w) WHERE regexp_matches(host || path, '^(?:[^/]*[.-])?' || w || '[.-]')) AS named
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL OR junk <> '' THEN 'block' ELSE 'allow' END AS verdict,
       CASE WHEN rule IS NULL THEN named END AS pattern_rule
FROM ruled
""".replace("WORDS", "|".join(urls.JUNK_WORDS)).replace("LIST", ", ".join(f"'{w}'" for w in urls.JUNK_WORDS))
)
QUERIES["op5_url_filter"] = op5_url_filter

#: The vocabulary of op4 and of the pipeline's last stage.
VOCABULARY = "word_bpe_49k.json"


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
    return packed.withColumn("length", F.col("length").cast("long"))


QUERIES["op4_best_fit_packing"] = op4_best_fit_packing


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), every=100, k=10)


ORACLE_SQL["op8_exact_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id IS DISTINCT FROM c.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
QUERIES["op8_exact_top_k"] = op8_exact_top_k


def op10_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op10_warc_archives"] = """
WITH sized AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages),
-- base32 of the 20 bytes: 32 groups of 5 bits
bits AS (SELECT page_id, html, sha, string_agg(lpad(bin(('0x' || substr(sha, 2 * i + 1, 2))::INT), 8, '0'), '' ORDER BY i) AS b FROM sized, range(20) t(i) GROUP BY ALL),
named AS (SELECT page_id, html, sha, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', list_reduce(list_transform(range(1, 6), lambda j: substr(b, 5 * i + j, 1)::INT), lambda x, y: 2 * x + y)::INT + 1, 1), '' ORDER BY i) AS payload_digest
  FROM bits, range(32) t(i) GROUP BY ALL),
typed AS (SELECT *, min(page_id) OVER (PARTITION BY sha) AS first FROM named)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN first IS DISTINCT FROM page_id AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM typed
"""
QUERIES["op10_warc_archives"] = op10_warc_archives

#: From this score on, a document counts as toxic.
TOXIC_FROM = 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn_for(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


QUERIES["op9_toxicity"] = op9_toxicity


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.col("base_spans")
    return scanned.select(
        "doc_id",
        *[secrets.counted(base, kind).alias(f"n_{kind}") for kind, *_ in secrets.BASE],
        F.sha2(secrets.listed(base), 256).alias("base_sha256"),
        secrets.listed(F.col("spans")).alias("spans"),
    )


QUERIES["op7_secret_scan"] = op7_secret_scan


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


QUERIES["op6_quality_rules"] = op6_quality_rules


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "class_id", (F.col("id") == F.col("class_id")).alias("kept"))


QUERIES["op2_minhash_dedup"] = op2_minhash_dedup


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extraction.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES["op3_html_extraction"] = op3_html_extraction


def op11_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.join(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


QUERIES["op11_ngram_jaccard_join"] = op11_ngram_jaccard_join


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES["op12_embedding_whitening"] = op12_embedding_whitening


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversations.report(conversations.repair(conversations.damaged(rows))).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    none = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    none |= {"audit": F.coalesce("audit", F.lit("")), "repaired_sha256": F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256))}
    return every.withColumns(none).drop("_conv")


QUERIES["op13_conversation_repair"] = op13_conversation_repair
