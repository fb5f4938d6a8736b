"""Stupid-Backoff scores and their lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unigram_scores(valid: DataFrame) -> DataFrame:
    """(word, score): log10 of the frequency; words of none get log10 of the reciprocal of all mass."""
    mass = valid.agg(F.coalesce(F.nullif(F.sum("freq"), F.lit(0.0)), F.lit(1.0)).alias("mass")).withColumn("_one", F.lit(1))  # one row
    with_mass = valid.withColumn("_one", F.lit(1)).join(F.broadcast(mass), "_one")
    return with_mass.select("word", F.when(F.col("freq") > 0, F.log10("freq")).otherwise(F.log10(1.0 / F.col("mass"))).alias("score"))


def bigram_scores(kept: DataFrame, freqs: DataFrame) -> DataFrame:
    """(w1, w2, score): log10 f(w1, w2) / f(w1), where both are positive. Values above 0 may occur, as the sizes have totals of their own."""
    f1 = freqs.filter("n = 1 and freq > 0").select("w1", F.col("freq").alias("f1"))
    f2 = freqs.filter("n = 2 and freq > 0").select("w1", "w2", F.col("freq").alias("f2"))
    return kept.select("w1", "w2").join(f2, ["w1", "w2"]).join(f1, "w1").select("w1", "w2", F.log10(F.col("f2") / F.col("f1")).alias("score"))


def trigram_scores(kept: DataFrame, freqs: DataFrame) -> DataFrame:
    """(w1, w2, w3, score): log10 f(w1, w2, w3) / f(w1, w2)."""
    f2 = freqs.filter("n = 2 and freq > 0").select("w1", "w2", F.col("freq").alias("f2"))
    f3 = freqs.filter("n = 3 and freq > 0").select("w1", "w2", "w3", F.col("freq").alias("f3"))
    return kept.select("w1", "w2", "w3").join(f3, ["w1", "w2", "w3"]).join(f2, ["w1", "w2"]).select("w1", "w2", "w3", F.log10(F.col("f3") / F.col("f2")).alias("score"))


def backed_off(tri: Column, bi: Column, uni: Column, prev2: Column, prev1: Column, alpha: float, floor: float) -> Column:
    """The probability of a word after two others, given its log10 scores at each size (null: none)."""
    p1 = F.coalesce(F.pow(F.lit(10.0), uni), F.lit(floor))
    p2 = F.when(prev1.isNull(), p1).otherwise(F.coalesce(F.pow(F.lit(10.0), bi), alpha * p1))
    return F.when(prev1.isNull() | prev2.isNull(), p2).otherwise(F.coalesce(F.pow(F.lit(10.0), tri), alpha * p2))


def lookup(queries: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame, alpha: float = 0.4, floor: float = 6e-6) -> DataFrame:
    """queries (with prev2, prev1 and word, the first two null at the beginning) with prob, by left joins to each size."""
    q = queries.join(uni.select("word", F.col("score").alias("s1")), "word", "left")
    q = q.join(bi.select(F.col("w1").alias("prev1"), F.col("w2").alias("word"), F.col("score").alias("s2")), ["prev1", "word"], "left")
    q = q.join(tri.select(F.col("w1").alias("prev2"), F.col("w2").alias("prev1"), F.col("w3").alias("word"), F.col("score").alias("s3")), ["prev2", "prev1", "word"], "left")
    c = F.col
    return q.withColumn("prob", backed_off(c("s3"), c("s2"), c("s1"), c("prev2"), c("prev1"), alpha, floor)).drop("s1", "s2", "s3")
