"""Runs of several operators, with stages kept as Parquet under a fingerprint of their configuration."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.tokens import with_boundaries
from ..operators import frequency, model, ngrams, wordlist
from ..sources import readers
from ..store import cut


def stage(spark: SparkSession, folder: str, name: str, config: object, build: Callable[[], DataFrame], fresh: bool = False) -> DataFrame:
    """What build() gives, stored; read again if a stage of this name was stored under an equal configuration."""
    path = f"{folder}/{name}-{hashlib.sha256(repr(config).encode()).hexdigest()[:12]}"
    if fresh or not readers.exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def words_of(texts: DataFrame, corpora: Sequence[str], config: Config, dictionary: DataFrame | None = None) -> DataFrame:
    """(word, freq, sources): counted, normalized, merged and decomposed."""
    counts = frequency.word_counts(texts, config.script)
    if dictionary is not None:
        counts = counts.unionByName(frequency.dictionary_counts(dictionary, config.wordlist.exempt_source, config.script))
        corpora = [*corpora, config.wordlist.exempt_source]
    merged = cut(frequency.merged(frequency.normalized(cut(counts, "counts")), corpora), "merged")
    parts = wordlist.decompositions(merged, config.wordlist.compound_min_chars, config.wordlist.part_min_chars)
    return wordlist.redistributed(merged, parts)


def dataset(words: DataFrame, variants: DataFrame, overrides: DataFrame, exclusions: DataFrame, config: Config) -> DataFrame:
    """(word_id, word, frequency, sources, romanizations) of a curated word list."""
    entries = wordlist.without_excluded(wordlist.with_overrides(words, variants, overrides), exclusions)
    return wordlist.with_ids(wordlist.filtered(entries, config.wordlist, config.script))


@dataclass
class Scores:
    valid: DataFrame
    uni: DataFrame
    bi: DataFrame
    tri: DataFrame


def tokens_of(texts: DataFrame, config: Config) -> DataFrame:
    return texts.select("corpus", with_boundaries(F.col("text"), config.script).alias("tokens"))


def language_model(grams: DataFrame, vocabulary: DataFrame, corpora: Sequence[str], config: Config) -> Scores:
    """Scores of a vocabulary's n-grams from stored counts (corpus, n, w1, w2, w3, cnt)."""
    m = config.model
    freqs = ngrams.normalized_merged(grams, corpora)
    raw = ngrams.raw_merged(grams, m.count_min)
    valid = ngrams.valid_tokens(vocabulary, ngrams.token_sources(grams, m.count_min), freqs, m.min_source_count, m.min_frequency)
    two, three = (ngrams.surviving(raw, valid, n, m.min_count) for n in (2, 3))
    return Scores(valid, model.unigram_scores(valid), model.bigram_scores(two, freqs), model.trigram_scores(three, freqs))
