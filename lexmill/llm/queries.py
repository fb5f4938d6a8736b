"""Thin queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, jaccard, langid, mixing, quality, rules, topk, toxicity, urlfilter, warc
from .common import cut, remainder, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public tokenizer's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 4) != 2))
    return toxicity.predict(docs.select("doc_id", "text").withColumn("held_out", held_out(4, 2)), model, keep_text=False)


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, vocabulary(), ("n_tokens", "ids_sha256", "decoded_sha256"), keep_text=False)


def held_out(n: int, rest: int) -> F.Column:
    return F.coalesce(remainder("doc_id", n) == rest, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.filter(remainder("doc_id", 3) != 1))
    return toxicity.predict(docs.select("doc_id", "text").withColumn("held_out", held_out(3, 1)), model, keep_text=False)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = cut(mixing.sizes(table(spark, sf_dir, "documents").select("doc_id", "text", "source")), "sizes")
    return mixing.Plan(sized).taken(sized).select("doc_id", "size", "source_size", "target", "taken")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copy_of")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = warc.write(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return warc.read(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(remainder("doc_id", 4) != 2))
    return langid.predict(docs.select("doc_id", "text").withColumn("held_out", held_out(4, 2)), model, keep_text=False)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = F.date_add(F.lit("2023-01-01").cast("date"), (F.col("page_id") * 7 % 1000).cast("int"))
    found = urlfilter.evaluate(pages.withColumn("fetched", day), urlfilter.dated_lists(pages))
    return found.select("page_id", "host", "verdict", "rule_kind", "rule_pattern", "rule_list", F.col("rule_from").cast("string").alias("rule_from"))


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


OP9_SQL = r"""
WITH captures AS (
  SELECT page_id, url, DATE '2023-01-01' + CAST(page_id * 7 % 1000 AS INTEGER) AS day,
         regexp_replace(regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#\\]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '^www\.|\.$', '', 'g') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\\]*(/[^?#]*)?', 1), '/'), lambda x: x <> '') AS parts
  FROM pages),
hosts AS (SELECT DISTINCT host AS pattern FROM captures WHERE host <> ''),
paths AS (SELECT DISTINCT host || '/' || parts[1] AS pattern FROM captures WHERE host <> '' AND len(parts) > 0),
domains AS (SELECT DISTINCT array_to_string(string_split(pattern, '.')[-2:], '.') AS pattern FROM hosts WHERE pattern LIKE '%.%'),
chosen AS (
  SELECT 'block-hosts' AS list, 'host' AS kind, pattern, 7 AS every, 3 AS below FROM hosts
  UNION ALL SELECT 'block-domains', 'host', pattern, 5, 1 FROM domains
  UNION ALL SELECT 'block-paths', 'path', pattern, 6, 1 FROM paths
  UNION ALL SELECT 'allow-paths', 'path', pattern, 9, 1 FROM paths),
numbered AS (
  SELECT list, kind, pattern, CAST('0x' || substr(md5(list || '-day' || pattern), 1, 7) AS INTEGER) % 600 AS a,
         CAST('0x' || substr(md5(list || '-n' || pattern), 1, 7) AS INTEGER) % 4 AS n
  FROM chosen WHERE CAST('0x' || substr(md5(list || pattern), 1, 7) AS INTEGER) % every < below),
spans AS (
  SELECT list, kind, pattern, DATE '2023-01-01' + a AS since, CASE WHEN n % 2 = 0 THEN DATE '2023-01-01' + (a + 90) END AS until FROM numbered
  UNION ALL SELECT list, kind, pattern, DATE '2023-01-01' + (a + 150), NULL FROM numbered WHERE n = 0),
keys AS (
  SELECT page_id, day, 'host' AS kind, array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM captures, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host <> ''
  UNION ALL SELECT page_id, day, 'path', host || '/' || parts[1] FROM captures WHERE host <> '' AND len(parts) > 0),
hits AS (
  SELECT k.page_id, s.*, row_number() OVER (PARTITION BY k.page_id ORDER BY s.kind = 'path' DESC, length(s.pattern) DESC, starts_with(s.list, 'allow') DESC, s.list DESC) AS r
  FROM keys k JOIN spans s ON k.kind = s.kind AND k.pattern = s.pattern AND k.day >= s.since AND (s.until IS NULL OR k.day < s.until))
SELECT c.page_id, c.host, CASE WHEN h.page_id IS NULL OR starts_with(h.list, 'allow') THEN 'allow' ELSE 'block' END AS verdict,
       h.kind AS rule_kind, h.pattern AS rule_pattern, h.list AS rule_list, CAST(h.since AS VARCHAR) AS rule_from
FROM captures c LEFT JOIN hits h ON c.page_id = h.page_id AND h.r = 1
"""


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return rules.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": OP7_SQL, "op9_url_filters": OP9_SQL}
