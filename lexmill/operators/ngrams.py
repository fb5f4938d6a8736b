"""N-gram counts in one pass, their merges, and the vocabulary of a language model."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Script
from ..functions.tokens import with_boundaries
from ..store import cut
from . import batches
from .frequency import shares

GRAM = ["w1", "w2", "w3"]


def explode_grams(tokens: DataFrame, sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(corpus, n, w1, w2, w3): all windows without a boundary, from sequences with nulls as boundaries. Narrow: one row generator per
    document, no shuffle."""
    t = F.col("tokens")

    def windows(n: int) -> F.Column:
        cell = lambda i, k: F.get(t, i + k) if k < n else F.lit(None).cast("string")
        at = F.when(F.size(t) >= n, F.sequence(F.lit(0), F.greatest(F.size(t) - n, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(F.lit(n).alias("n"), *[cell(i, k).alias(GRAM[k]) for k in range(3)]))

    each = tokens.select("corpus", F.explode(F.concat(*[windows(n) for n in sizes])).alias("g")).select("corpus", "g.*")
    whole = F.col("w1").isNotNull() & ((F.col("n") < 2) | F.col("w2").isNotNull()) & ((F.col("n") < 3) | F.col("w3").isNotNull())
    return each.filter(whole)


def counts(tokens: DataFrame, sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(corpus, n, w1, w2, w3, cnt). One shuffle for all sizes, after partial counts."""
    return explode_grams(tokens, sizes).groupBy("corpus", "n", *GRAM).agg(F.count("*").alias("cnt"))


def raw_merged(grams: DataFrame, min_count: int = 2) -> DataFrame:
    """(n, w1, w2, w3, cnt) over all corpora, cut at min_count after summing."""
    return grams.groupBy("n", *GRAM).agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= min_count)


def normalized_merged(grams: DataFrame, corpora: Sequence[str]) -> DataFrame:
    """(n, w1, w2, w3, freq): mean over corpora of shares of the corpus's n-grams of the same size; empty corpora count as zeros."""
    totals = grams.groupBy("corpus", "n").agg(F.sum("cnt").alias("total"))
    shared = grams.join(F.broadcast(totals), ["corpus", "n"]).withColumn("f", F.col("cnt").cast("double") / F.col("total"))
    w = shares(corpora)
    grouped = shared.groupBy("n", *GRAM).agg(*[F.max(F.when(F.col("corpus") == c, F.col("f"))).alias(f"f{i}") for i, c in enumerate(corpora)])
    total = F.lit(0.0)
    for i, c in enumerate(corpora):
        total = total + F.coalesce(F.col(f"f{i}"), F.lit(0.0)) * F.lit(w[c])
    return grouped.select("n", *GRAM, total.alias("freq"))


def with_words(df: DataFrame) -> DataFrame:
    """df with n, w1, w2 and w3 in place of its column gram, words joined by spaces."""
    rest = [c for c in df.columns if c != "gram"]
    cut_up = df.select(F.split("gram", " ").alias("_w"), *rest)
    return cut_up.select(F.size("_w").alias("n"), *[F.get("_w", F.lit(i)).alias(k) for i, k in enumerate(GRAM)], *rest)


def listed(vocabulary: DataFrame, word: str = "word", limit: int = 2_000_000) -> list[str] | None:
    """The words of a vocabulary, or None if there are more than limit."""
    own = cut(vocabulary.select(F.col(word).alias("word")).filter("word is not null").distinct(), "vocabulary")
    return None if own.count() > limit else [r[0] for r in own.toLocalIterator()]


def text_counts(texts: DataFrame, script: Script, sizes: Sequence[int] = (1, 2, 3), vocabulary: DataFrame | None = None) -> DataFrame:
    """counts() of whole texts (corpus, text), with those n-grams only whose words are all in the vocabulary, if given. One shuffle of what tasks have
    counted, dealt out by n-gram to as many partitions as the texts need."""
    words = None if vocabulary is None else listed(vocabulary)
    if not batches.plain(script) or (vocabulary is not None and words is None):
        found = counts(texts.select("corpus", with_boundaries(F.col("text"), script).alias("tokens")), sizes)
        if vocabulary is None:
            return found
        return reduce(DataFrame.unionByName, [within(found, vocabulary, n) for n in sizes])
    found = batches.counted(texts, script, sizes, vocabulary=words)
    if words is None:
        found = found.repartition(batches.partitions(texts, len(sizes)), "gram")
    return with_words(found.groupBy("corpus", "gram").agg(F.sum("cnt").alias("cnt"))).select("corpus", "n", *GRAM, "cnt")


def text_totals(texts: DataFrame, script: Script, corpora: Sequence[str], sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(n, t0, t1, ...): the number of n-grams of each corpus, from tasks' counts without a shuffle of n-grams."""
    return wide_totals(batches.counted(texts, script, (), sizes), corpora)


def wide_totals(counted: DataFrame, corpora: Sequence[str]) -> DataFrame:
    return cut(counted.filter("gram is null").groupBy("n").agg(*[F.sum(F.when(F.col("corpus") == c, F.col("cnt")).otherwise(0)).alias(f"t{i}") for i, c in enumerate(corpora)]), "totals")


def wide(counted: DataFrame, corpora: Sequence[str], parts: int = 0) -> DataFrame:
    """wide_counts() of rows (corpus, gram, cnt), dealt out to so many partitions, if given. Rows for the shuffle hold an n-gram and one number, of
    its count and its corpus."""
    size = len(corpora)
    number = F.when(F.col("corpus") == corpora[0], 0)
    for i, c in enumerate(corpora[1:], 1):
        number = number.when(F.col("corpus") == c, i)
    rows = counted.select("gram", (F.col("cnt") * size + number).alias("of")).filter("of is not null")
    if parts:
        rows = rows.repartition(parts, "gram")
    of, whole = F.pmod(F.col("of"), F.lit(size)), F.expr(f"of div {size}")
    return rows.groupBy("gram").agg(*[F.sum(F.when(of == i, whole).otherwise(0)).alias(f"c{i}") for i in range(size)])


def text_measured(texts: DataFrame, script: Script, corpora: Sequence[str], sizes: Sequence[int] = (1, 2, 3), count_min: int = 2, digits: int | None = None) -> DataFrame:
    """measured() of whole texts. Totals come from a pass of their own, so that n-grams are shuffled once and not stored."""
    if not batches.plain(script):
        tokens = texts.select("corpus", with_boundaries(F.col("text"), script).alias("tokens"))
        return measured(cut(wide_counts(tokens, corpora, sizes), "grams"), corpora, count_min, digits=digits)
    found = wide(batches.counted(texts, script, sizes), corpora, batches.partitions(texts, len(sizes)))
    return measured(with_words(found), corpora, count_min, text_totals(texts, script, corpora, sizes), digits)


def text_raw(texts: DataFrame, script: Script, corpora: Sequence[str], sizes: Sequence[int] = (1, 2, 3), min_count: int = 2) -> DataFrame:
    """(n, w1, w2, w3, cnt) of whole texts over the given corpora, counted min_count times or more. Others are left out before words are cut up."""
    if not batches.plain(script):
        return text_measured(texts, script, corpora, sizes).filter(F.col("cnt") >= min_count).select("n", *GRAM, "cnt")
    rows = batches.counted(texts, script, sizes).filter(F.col("corpus").isin(*corpora)).select("gram", "cnt")
    found = rows.repartition(batches.partitions(texts, len(sizes)), "gram").groupBy("gram").agg(F.sum("cnt").alias("cnt"))
    return with_words(found.filter(F.col("cnt") >= min_count)).select("n", *GRAM, "cnt")


def text_model(texts: DataFrame, script: Script, corpora: Sequence[str], most: int, min_count: int, inside: DataFrame | None = None, min_sources: int = 2, min_frequency: float = 5e-6) -> tuple[DataFrame, DataFrame]:
    """What a model of whole texts is made from, both stored: the valid tokens of the corpora, (word, n_sources, freq), and the measured n-grams of
    sizes up to most that are counted min_count times or more and whose words are all valid; with inside (word), those of its words only.
    Valid tokens are 1 / min_frequency at most, as their frequencies add up to 1: tasks look them up and count no other n-grams. An
    n-gram that is kept has its first words kept, as those are counted as often at least."""
    if not batches.plain(script):
        g = text_measured(texts, script, corpora, range(1, most + 1))
        uni = g.filter("n = 1").withColumnRenamed("w1", "word")
        valid = cut(valid_tokens(uni, uni.filter("n_sources > 0").select("word", "n_sources"), g.select("n", "w1", "freq"), min_sources, min_frequency), "valid")
        return valid, cut(reduce(DataFrame.unionByName, [surviving(g, valid, n, min_count) for n in range(1, most + 1)]).select("n", *GRAM, "cnt", "freq", "n_sources"), "kept")
    own = [f"c{i}" for i in range(len(corpora))]
    first = cut(batches.counted(texts, script, (1,), range(1, most + 1)).groupBy("corpus", "n", "gram").agg(F.sum("cnt").alias("cnt")), "counted")
    totals = wide_totals(first, corpora)
    uni = measured(with_words(wide(first.filter("gram is not null"), corpora)), corpora, 2, totals)
    valid = cut(uni.filter((F.col("n_sources") >= max(min_sources, 1)) & (F.col("freq") >= min_frequency)).select(F.col("w1").alias("word"), "n_sources", "freq", "cnt"), "valid")
    kept = valid.filter(F.col("cnt") >= min_count).select(F.lit(1).alias("n"), F.col("word").alias("w1"), *[F.lit(None).cast("string").alias(k) for k in GRAM[1:]], "cnt", "freq", "n_sources")
    if most > 1:
        words = [r[0] for r in (valid if inside is None else valid.join(inside.select("word").distinct(), "word", "left_semi")).select("word").toLocalIterator()]
        found = wide(batches.counted(texts, script, range(2, most + 1), vocabulary=words), corpora, batches.partitions(texts, most - 1))
        frequent = found.filter(sum((F.col(c) for c in own), F.lit(0)) >= min_count)
        kept = kept.unionByName(measured(with_words(frequent), corpora, 2, totals))
    return valid.drop("cnt"), cut(kept, "kept")


def wide_counts(tokens: DataFrame, corpora: Sequence[str], sizes: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(n, w1, w2, w3, c0, c1, ...): counts by corpus, a column for each. One shuffle from tokens to all that merges need, after partial counts."""
    return explode_grams(tokens, sizes).groupBy("n", *GRAM).agg(*[F.count_if(F.col("corpus") == c).alias(f"c{i}") for i, c in enumerate(corpora)])


def measured(wide: DataFrame, corpora: Sequence[str], count_min: int = 2, totals: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """(n, w1, w2, w3, cnt, freq, n_sources) of wide counts, without a shuffle: the sum of counts, the mean over corpora of shares of the
    corpus's n-grams of the same size, and the number of corpora that count an n-gram count_min times or more. Without totals (n, t0, t1, ...)
    these are summed from the wide counts, which should be stored then. With digits, frequencies are rounded; those of n-grams that occur once,
    the most by far, are rounded once for each size and corpus, as rounding takes longer than all else of a row."""
    every = range(len(corpora))
    if totals is None:
        totals = wide.groupBy("n").agg(*[F.sum(f"c{i}").alias(f"t{i}") for i in every])  # a row for each size
    w = shares(corpora)
    cnt, freq, n_sources = F.lit(0).cast("long"), F.lit(0.0), F.lit(0).cast("long")
    for i in every:
        cnt = cnt + F.col(f"c{i}")
        freq = freq + F.coalesce(F.try_divide(F.col(f"c{i}").cast("double"), F.col(f"t{i}").cast("double")), F.lit(0.0)) * F.lit(w[corpora[i]])
        n_sources = n_sources + (F.col(f"c{i}") >= count_min).cast("long")
    if digits is not None:
        totals = totals.select("*", *[F.round(F.coalesce(F.try_divide(F.lit(1.0), F.col(f"t{i}").cast("double")), F.lit(0.0)) * F.lit(w[c]), digits).alias(f"h{i}") for i, c in enumerate(corpora)])
        once = F.coalesce(*[F.when(F.col(f"c{i}") == 1, F.col(f"h{i}")) for i in every])
        freq = F.when(cnt == 1, once).otherwise(F.round(freq, digits))
    found = wide.join(F.broadcast(totals), "n").select("n", *GRAM, cnt.alias("cnt"), freq.alias("freq"), n_sources.alias("n_sources"))
    return found.filter("cnt > 0")


def within(grams: DataFrame, vocabulary: DataFrame, n: int, word: str = "word") -> DataFrame:
    """N-grams of size n whose words are all in the vocabulary: what is left if other words are boundaries."""
    kept = grams.filter(F.col("n") == n)
    for k in GRAM[:n]:
        kept = kept.join(vocabulary.select(F.col(word).alias(k)), k, "left_semi")
    return kept


def token_sources(grams: DataFrame, count_min: int = 2) -> DataFrame:
    """(word, n_sources): corpora in which the word is counted count_min times or more."""
    return grams.filter((F.col("n") == 1) & (F.col("cnt") >= count_min)).groupBy(F.col("w1").alias("word")).agg(F.count("*").alias("n_sources"))


def valid_tokens(vocabulary: DataFrame, sources: DataFrame, freqs: DataFrame, min_sources: int = 2, min_frequency: float = 5e-6) -> DataFrame:
    """(word, n_sources, freq) of vocabulary words that enough corpora have and that are frequent enough."""
    uni = freqs.filter("n = 1").select(F.col("w1").alias("word"), "freq")
    found = vocabulary.select("word").distinct().join(sources.filter(F.col("n_sources") >= min_sources), "word").join(uni, "word", "left")
    return found.withColumn("freq", F.coalesce("freq", F.lit(0.0))).filter(F.col("freq") >= min_frequency)


def surviving(raw: DataFrame, valid: DataFrame, n: int, min_count: int) -> DataFrame:
    """N-grams of size n that are counted often enough and whose words are all valid. The vocabulary is small or not as Spark's
    statistics say; the joins are plain semi joins."""
    return within(raw.filter(F.col("cnt") >= min_count), valid, n)
