"""Metrics of ranked candidates and reports of coverage and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def precision_at(candidates: Column, expected: Column, k: int) -> Column:
    """1 if the expected value is among the first k candidates, else 0."""
    return F.coalesce(F.array_contains(F.slice(candidates, 1, k), expected), F.lit(False)).cast("double")


def reciprocal_rank(candidates: Column, expected: Column) -> Column:
    """1 / place of the expected value, 0 where it is missing."""
    at = F.coalesce(F.array_position(candidates, expected), F.lit(0))
    return F.when(at > 0, 1.0 / at).otherwise(0.0)


def ranking_metrics(results: DataFrame, ks: tuple[int, ...] = (1, 3, 10)) -> DataFrame:
    """One row for results (candidates, expected): P@k, MRR and coverage, the share with any candidate."""
    c, e = F.col("candidates"), F.col("expected")
    return results.agg(F.count("*").alias("n"), *[F.avg(precision_at(c, e, k)).alias(f"p_at_{k}") for k in ks], F.avg(reciprocal_rank(c, e)).alias("mrr"), F.avg((F.size(c) > 0).cast("double")).alias("coverage"))


def word_f1(predicted: Column, expected: Column) -> dict[str, Column]:
    """Precision, recall and F1 of word sets: all 1 if both are empty, 0 if one is."""
    p, e = F.array_distinct(predicted), F.array_distinct(expected)
    hit, n, m = F.size(F.array_intersect(p, e)), F.size(p), F.size(e)
    both, one = (n == 0) & (m == 0), (n == 0) | (m == 0)
    precision = F.when(both, 1.0).when(one, 0.0).otherwise(hit / n)
    recall = F.when(both, 1.0).when(one, 0.0).otherwise(hit / m)
    f1 = F.when(both, 1.0).when(one | (hit == 0), 0.0).otherwise(2.0 * hit / (n + m))
    return {"precision": precision, "recall": recall, "f1": f1}


def recall_rows(benchmark: DataFrame, entries: DataFrame) -> DataFrame:
    """benchmark (latin_input, expected) with has_word, has_key and n_variants of the expected word."""
    known = entries.select(F.col("word").alias("expected"), "romanizations", F.size("romanizations").alias("n_variants"))
    j = benchmark.join(known, "expected", "left")
    return j.select("latin_input", "expected", F.col("n_variants").isNotNull().alias("has_word"), F.coalesce(F.array_contains("romanizations", F.lower("latin_input")), F.lit(False)).alias("has_key"), "n_variants")


def recall_summary(rows: DataFrame) -> DataFrame:
    """One row: pairs, hits, pairs whose word or only whose key is missing, recall, distinct words, those known and those without variants,
    and the recall among known words."""
    total = rows.agg(F.count("*").alias("total"), F.count_if("has_key").alias("hits"), F.count_if(~F.col("has_word")).alias("word_missing"), F.count_if(F.col("has_word") & ~F.col("has_key")).alias("key_missing"), F.countDistinct("expected").alias("unique_words"), F.countDistinct(F.when(F.col("has_word"), F.col("expected"))).alias("words_covered"), F.countDistinct(F.when(F.col("n_variants") == 0, F.col("expected"))).alias("zero_variant_words"))
    return total.withColumn("recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), "total"), F.lit(0.0))).withColumn("adjusted_recall", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("total") - F.col("word_missing")), F.lit(0.0)))


def missed(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Pairs that were not found, sorted."""
    out = rows.filter(~F.col("has_key")).select("latin_input", "expected", F.when(F.col("has_word"), "key_missing").otherwise("word_missing").alias("reason"))
    return out.orderBy("expected", "latin_input").limit(limit) if limit else out


def ranking_coverage(benchmark: DataFrame, uni: DataFrame, bi: DataFrame) -> DataFrame:
    """(type, total, hits) with a row TOTAL, of benchmark (type, context, expected_top): a hit is a known bigram of context and expectation, or, where
    either is empty, a known word."""
    context, top = F.coalesce("context", F.lit("")), F.coalesce("expected_top", F.lit(""))
    b = benchmark.select("type", context.alias("w1"), top.alias("w2"))
    b = b.join(bi.select("w1", "w2", F.lit(True).alias("in_bi")).distinct(), ["w1", "w2"], "left")
    word = F.when(F.col("w2") != "", F.col("w2")).otherwise(F.col("w1"))
    b = b.withColumn("w", word).join(uni.select(F.col("word").alias("w"), F.lit(True).alias("in_uni")).distinct(), "w", "left")
    hit = F.when((F.col("w1") != "") & (F.col("w2") != ""), F.col("in_bi").isNotNull()).otherwise(F.col("in_uni").isNotNull())
    return b.rollup("type").agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"), F.grouping("type").alias("g")).select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("type")).alias("type"), "total", "hits")
