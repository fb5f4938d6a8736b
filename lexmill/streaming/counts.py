"""Counts over streams: the same expressions as in batch, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Script
from ..functions.text import is_valid
from ..functions.tokens import tokenize, with_boundaries
from ..operators.ngrams import GRAM, explode_grams


def word_counts(texts: DataFrame, script: Script) -> DataFrame:
    """(corpus, word, cnt) of a stream (corpus, text), for update or complete output."""
    words = texts.select("corpus", F.explode(tokenize(F.col("text"), script)).alias("word")).filter(is_valid(F.col("word"), script))
    return words.groupBy("corpus", "word").agg(F.count("*").alias("cnt"))


def gram_counts(texts: DataFrame, script: Script, sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    tokens = texts.select("corpus", with_boundaries(F.col("text"), script).alias("tokens"))
    return explode_grams(tokens, sizes).groupBy("corpus", "n", *GRAM).agg(F.count("*").alias("cnt"))


def windowed_words(texts: DataFrame, script: Script, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """(start, corpus, word, cnt) by event-time windows of a stream (ts, corpus, text); rows later than `late` are dropped, as append output asks."""
    words = texts.withWatermark("ts", late).select("ts", "corpus", F.explode(tokenize(F.col("text"), script)).alias("word")).filter(is_valid(F.col("word"), script))
    return words.groupBy(F.window("ts", width).alias("w"), "corpus", "word").agg(F.count("*").alias("cnt")).select(F.col("w.start").alias("start"), "corpus", "word", "cnt")
