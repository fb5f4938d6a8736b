"""Word counts, frequencies, their merge over corpora, provenance and ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Script
from ..functions.tokens import tokenize
from ..functions.text import is_valid
from ..store import cut
from . import batches


def word_counts(texts: DataFrame, script: Script) -> DataFrame:
    """(corpus, word, cnt) of valid tokens, counted partly before the shuffle: by tasks in batches, or, for scripts whose tokens are more than runs of
    letters, as raw tokens whose validity is then judged once for each distinct one."""
    if batches.plain(script):
        return batches.counted(texts, script, (1,)).groupBy("corpus", F.col("gram").alias("word")).agg(F.sum("cnt").alias("cnt"))
    raw = texts.select("corpus", F.explode(tokenize(F.col("text"), script)).alias("word"))
    return raw.groupBy("corpus", "word").agg(F.count("*").alias("cnt")).filter(is_valid(F.col("word"), script))


def dictionary_counts(words: DataFrame, corpus: str, script: Script) -> DataFrame:
    """A dictionary as a corpus: each valid word once."""
    return words.filter(is_valid(F.col("word"), script)).select(F.lit(corpus).alias("corpus"), "word").distinct().withColumn("cnt", F.lit(1).cast("long"))


def normalized(counts: DataFrame) -> DataFrame:
    """(corpus, word, freq): the share of each word in its corpus. Totals are one row per corpus and joined back."""
    totals = counts.groupBy("corpus").agg(F.sum("cnt").alias("total"))
    return counts.join(F.broadcast(totals), "corpus").select("corpus", "word", (F.col("cnt").cast("double") / F.col("total")).alias("freq"))


def shares(corpora: Sequence[str], weights: dict[str, float] | None = None) -> dict[str, float]:
    """The weight of each corpus: equal (empty corpora count, too), or in proportion to weights."""
    if weights is None:
        return {c: 1.0 / len(corpora) for c in corpora}
    total = sum(weights.get(c, 0.0) for c in corpora)
    if total <= 0:
        raise ValueError("weights must have a positive sum")
    return {c: weights.get(c, 0.0) / total for c in corpora}


def merged(freqs: DataFrame, corpora: Sequence[str], weights: dict[str, float] | None = None, key: str = "word") -> DataFrame:
    """(word, freq, sources): weighted sums over corpora, absent ones as 0, and the corpora that have the word. One shuffle; terms are
    added in the order of corpora, so the result does not depend on the order of rows."""
    w = shares(corpora, weights)
    grouped = freqs.groupBy(key).agg(*[F.max(F.when(F.col("corpus") == c, F.col("freq"))).alias(f"f{i}") for i, c in enumerate(corpora)])
    total = F.lit(0.0)
    for i, c in enumerate(corpora):
        total = total + F.coalesce(F.col(f"f{i}"), F.lit(0.0)) * F.lit(w[c])
    names = F.array_sort(F.array_compact(F.array(*[F.when(F.col(f"f{i}").isNotNull(), F.lit(c)) for i, c in enumerate(corpora)])))
    return grouped.select(key, total.alias("freq"), names.alias("sources"))


def ranked(words: DataFrame, by: str = "freq", out: str = "rank", zero: bool = False) -> DataFrame:
    """words with their place by descending frequency, then word. A global order of any size: rows are ranged over partitions, sorted
    there and stored once with their partition and place in it; the numbers of rows in the partitions before are taken from that table."""
    order = [F.desc(by), F.asc("word")]
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    parts = cut(words.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", place), "ranked")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return parts.join(F.broadcast(before), "_p").withColumn(out, F.col("_i") + F.col("_before") + (0 if zero else 1)).drop("_p", "_i", "_before")


def wordlist(words: DataFrame) -> DataFrame:
    """(rank, word, frequency, source_count, sources) for export; sources joined by a bar."""
    return ranked(words).select("rank", "word", F.col("freq").alias("frequency"), F.size("sources").alias("source_count"), F.array_join("sources", "|").alias("sources"))


def top_with_ranks(words: DataFrame, freqs: DataFrame, corpora: Sequence[str], k: int) -> DataFrame:
    """The k most frequent words with their rank in each corpus among themselves (null where absent) and the number of such corpora."""
    top = words.orderBy(F.desc("freq"), F.asc("word")).limit(k)
    within = freqs.join(F.broadcast(top.select("word")), "word").withColumn("r", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("freq"), F.asc("word"))))
    wide = within.groupBy("word").agg(*[F.max(F.when(F.col("corpus") == c, F.col("r"))).alias(f"{c}_rank") for c in corpora], F.count("*").alias("corpus_count"))
    rank = F.row_number().over(Window.orderBy(F.desc("freq"), F.asc("word")))  # k rows
    return top.select(rank.alias("rank"), "word", F.col("freq").alias("merged_freq")).join(F.broadcast(wide), "word", "left")


def source_stats(words: DataFrame) -> DataFrame:
    """(source, words, unique): how many words each source has, and how many only it has."""
    return words.select(F.size("sources").alias("n"), F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("words"), F.count_if(F.col("n") == 1).alias("unique_words"))
