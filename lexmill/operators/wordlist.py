"""Word lists: compound decomposition, overrides, exclusions, quality filters, ids, exports and their statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Script, WordlistConfig
from ..functions.text import base_length
from ..store import cut
from .frequency import ranked

OVERRIDES = "overrides"


def decomposer(vocabulary: set[str], part_min: int = 3) -> Callable[[str], list[str] | None]:
    """Splits a word into vocabulary words, always taking the longest that starts where the last one ended and never going back; None
    if that fails. Parts are shorter than the word."""
    longest = max(map(len, vocabulary), default=0)

    def split(word: str) -> list[str] | None:
        parts, at, n = [], 0, len(word)
        while at < n:
            for end in range(min(n, at + longest, at + n - 1), at + part_min - 1, -1):
                if word[at:end] in vocabulary:
                    parts.append(word[at:end])
                    at = end
                    break
            else:
                return None
        return parts if len(parts) > 1 else None

    return split


def decompositions(words: DataFrame, compound_min: int = 10, part_min: int = 3, limit: int = 3_000_000) -> DataFrame:
    """(word, parts) of compounds. The vocabulary is a set on each executor, behind a count; a larger one takes decompositions_joined."""
    if words.count() > limit:
        return decompositions_joined(words, compound_min, part_min)
    shared = words.sparkSession.sparkContext.broadcast([r[0] for r in words.select("word").toLocalIterator()])

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        split = decomposer(set(shared.value), part_min)
        for s in frames:
            yield s.map(split)

    udf = F.pandas_udf(run, "array<string>")
    return words.filter(F.length("word") >= compound_min).select("word", udf("word").alias("parts")).filter("parts is not null")


def decompositions_joined(words: DataFrame, compound_min: int = 10, part_min: int = 3) -> DataFrame:
    """The same for vocabularies of any size, in rounds, one for each part: of the words that have been split so far, the pieces that begin where
    the last part ended meet the vocabulary in one join, and the longest goes on. So no piece is made at a place that no split reaches."""
    size, last = F.length("word"), F.col("at") + F.col("n")
    pending = cut(words.filter(size >= compound_min).select("word", F.lit(1).alias("at"), F.lit("").alias("cuts")), "split")
    done = None
    while not pending.isEmpty():
        most = F.least(size - F.col("at") + 1, size - 1)
        piece = pending.filter(most >= part_min).withColumn("n", F.explode(F.sequence(F.lit(part_min), F.greatest(most, F.lit(part_min))))).withColumn("piece", F.substring("word", F.col("at"), F.col("n")))
        best = piece.join(words.select(F.col("word").alias("piece")), "piece", "left_semi").groupBy("word", "at", "cuts").agg(F.max("n").alias("n"))
        step = cut(best.select("word", last.alias("at"), F.concat("cuts", F.lit(" "), "at", F.lit(","), "n").alias("cuts")), "split")
        over, pending = step.filter(F.col("at") > size), step.filter(F.col("at") <= size)
        done = over if done is None else done.unionByName(over)
    if done is None:
        return pending.select("word", F.array().cast("array<string>").alias("parts"))
    pair = lambda x: F.transform(F.split(x, ","), lambda i: i.cast("int"))
    parts = F.transform(F.split(F.ltrim("cuts"), " "), lambda x: F.substring(F.col("word"), pair(x)[0], pair(x)[1]))
    return done.select("word", parts.alias("parts"))


def redistributed(words: DataFrame, parts: DataFrame) -> DataFrame:
    """words without compounds, whose frequency goes in equal shares to each occurrence of their parts, along with their sources. Shares of
    parts that are themselves compounds are lost, as those are gone."""
    given = parts.join(words, "word").select(F.explode("parts").alias("word"), (F.col("freq") / F.size("parts")).alias("share"), "sources")
    share = given.groupBy("word").agg(F.sum("share").alias("share"), F.array_distinct(F.flatten(F.collect_set("sources"))).alias("more"))
    kept = words.join(parts.select("word"), "word", "left_anti").join(share, "word", "left")
    return kept.select("word", (F.col("freq") + F.coalesce("share", F.lit(0.0))).alias("freq"), F.array_sort(F.array_union("sources", F.coalesce("more", F.array().cast("array<string>")))).alias("sources"))


def with_overrides(words: DataFrame, variants: DataFrame, overrides: DataFrame) -> DataFrame:
    """(word, freq, sources, romanizations, overridden): overridden words take the override's romanizations; new ones get the least positive
    frequency of the list (1e-9 of an empty one) and the source `overrides`."""
    least = words.agg(F.min(F.when(F.col("freq") > 0, F.col("freq")))).first()[0] or 1e-9
    over = overrides.filter(F.size("romanizations") > 0).select("word", F.col("romanizations").alias("over"))
    old = words.join(variants.select("word", "romanizations"), "word", "left").join(over, "word", "left")
    kept = old.select("word", "freq", "sources", F.coalesce("over", "romanizations", F.array().cast("array<string>")).alias("romanizations"), F.col("over").isNotNull().alias("overridden"))
    new = over.join(words.select("word"), "word", "left_anti").select("word", F.lit(least).alias("freq"), F.array(F.lit(OVERRIDES)).alias("sources"), F.col("over").alias("romanizations"), F.lit(True).alias("overridden"))
    return kept.unionByName(new)


def without_excluded(entries: DataFrame, exclusions: DataFrame) -> DataFrame:
    """entries without excluded words, unless overridden."""
    gone = entries.filter(~F.col("overridden")).join(exclusions.select("word"), "word", "left_semi").select("word")
    return entries.join(gone, "word", "left_anti")


def removal_reasons(entries: DataFrame, config: WordlistConfig, script: Script) -> DataFrame:
    """entries with removed_reason: the first rule that a word breaks, null if none."""
    shortest = F.array_min(F.transform("romanizations", lambda r: F.length(r)))
    own = ~F.col("overridden")
    few = (F.size("sources") < config.min_source_count) & ~((F.size("sources") == 1) & F.array_contains("sources", config.exempt_source))
    ratio = (shortest > 0) & (base_length(F.col("word"), script) / shortest > config.max_length_ratio)
    reason = F.when(own & few, "few_sources").when(own & (F.col("freq") < config.min_frequency), "low_frequency").when(own & ratio, "length_ratio").when(F.size("romanizations") == 0, "no_variants")
    return entries.withColumn("removed_reason", reason)


def limited(entries: DataFrame, limit: int) -> DataFrame:
    """All overridden words and the most frequent others, limit in all (0: no limit)."""
    if not limit:
        return entries
    own = entries.filter("overridden")
    room = max(0, limit - own.count())
    return own.unionByName(entries.filter("not overridden").orderBy(F.desc("freq"), F.asc("word")).limit(room))


def filtered(entries: DataFrame, config: WordlistConfig, script: Script) -> DataFrame:
    return limited(removal_reasons(entries, config, script).filter("removed_reason is null").drop("removed_reason"), config.vocab_limit)


def with_ids(entries: DataFrame) -> DataFrame:
    """(word_id, word, frequency, sources, romanizations), ids from 0 by descending frequency, then word."""
    return ranked(entries, out="word_id", zero=True).select(F.col("word_id").cast("long"), "word", F.col("freq").alias("frequency"), "sources", "romanizations")


def flat_keys(entries: DataFrame) -> DataFrame:
    """A row for each romanization."""
    return entries.select("word_id", "word", F.explode("romanizations").alias("romanization_key"), "frequency", F.array_join("sources", "|").alias("sources"))


def metadata(entries: DataFrame, version: str, sources: list[str]) -> DataFrame:
    keys = entries.select(F.explode("romanizations").alias("k")).agg(F.count("*").alias("total_romanization_keys"), F.countDistinct("k").alias("unique_romanization_keys"))
    size = entries.agg(F.count("*").alias("vocab_size"))
    return size.crossJoin(keys).select(F.lit(version).alias("version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), "vocab_size", "total_romanization_keys", "unique_romanization_keys", F.lit(sources).cast("array<string>").alias("sources"))


def collisions(entries: DataFrame, least: int = 2) -> DataFrame:
    """(romanization_key, n_words, words): keys that several words share."""
    pairs = entries.select(F.explode("romanizations").alias("romanization_key"), "word").distinct()
    return pairs.groupBy("romanization_key").agg(F.count("*").alias("n_words"), F.array_join(F.array_sort(F.collect_list("word")), "|").alias("words")).filter(F.col("n_words") >= least)


def collision_histogram(entries: DataFrame) -> DataFrame:
    pairs = entries.select(F.explode("romanizations").alias("romanization_key"), "word").distinct()
    return pairs.groupBy("romanization_key").agg(F.count("*").alias("n_words")).groupBy("n_words").agg(F.count("*").alias("n_keys"))


def upper_median(entries: DataFrame, of: Column) -> float | None:
    """The value at place n // 2 of the sorted values, from their histogram: no list is gathered."""
    from pyspark.sql import Window

    h = entries.groupBy(of.alias("v")).agg(F.count("*").alias("n"))
    run = h.withColumn("upto", F.sum("n").over(Window.orderBy("v")))
    total = h.agg(F.sum("n")).first()[0]
    return None if not total else run.filter(F.col("upto") > total // 2).agg(F.min("v")).first()[0]


#: Upper ends of the buckets of variant counts.
BUCKETS = [0, 5, 10, 20, 50]


def variant_stats(entries: DataFrame) -> DataFrame:
    """One row: words, keys, distinct keys, and mean, upper median, least and most variants of a word."""
    n = F.size("romanizations")
    total = entries.agg(F.count("*").alias("vocab_size"), F.sum(n).cast("long").alias("total_keys"), F.avg(n).alias("avg_variants"), F.min(n).alias("min_variants"), F.max(n).alias("max_variants"))
    unique = entries.select(F.explode("romanizations").alias("k")).agg(F.countDistinct("k").alias("unique_keys"))
    return total.crossJoin(unique).withColumn("median_variants", F.lit(upper_median(entries, n)).cast("int"))


def variant_buckets(entries: DataFrame) -> DataFrame:
    n = F.size("romanizations")
    bucket, low = F.when(n == 0, "0"), 1
    for high in BUCKETS[1:]:
        bucket, low = bucket.when(n <= high, f"{low}-{high}"), high + 1
    return entries.groupBy(bucket.otherwise(f"{low}+").alias("bucket")).agg(F.count("*").alias("n_words"))


def source_coverage(entries: DataFrame) -> DataFrame:
    """(source, total, success, failed, variant_sum, unique_words)."""
    e = entries.select(F.size("romanizations").alias("n"), F.size("sources").alias("k"), F.explode("sources").alias("source"))
    return e.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("n") > 0).alias("success"), F.count_if(F.col("n") == 0).alias("failed"), F.sum("n").cast("long").alias("variant_sum"), F.count_if(F.col("k") == 1).alias("unique_words"))


def coverage_by_source_count(entries: DataFrame) -> DataFrame:
    return entries.groupBy(F.size("sources").alias("source_count")).agg(F.count("*").alias("total"), F.count_if(F.size("romanizations") > 0).alias("success"), F.sum(F.size("romanizations")).cast("long").alias("variant_sum"))
