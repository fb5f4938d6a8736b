"""Tokens and token sequences with boundaries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Script
from .text import is_valid


def tokenize(text: Column, script: Script) -> Column:
    """All tokens of a text, valid or not."""
    return F.regexp_extract_all(F.lower(text), F.lit(script.tokens), F.lit(0))


def valid_tokens(text: Column, script: Script) -> Column:
    """The valid tokens of a text: a bag of words in order."""
    return F.filter(tokenize(text, script), lambda t: is_valid(t, script))


def with_boundaries(text: Column, script: Script) -> Column:
    """Tokens in order, null where a token is not valid."""
    return F.transform(tokenize(text, script), lambda t: F.when(is_valid(t, script), t))


def collapsed(tokens: Column) -> Column:
    """A sequence with single nulls between its runs, none first or last."""
    kept = F.filter(tokens, lambda t, i: t.isNotNull() | ((i > 0) & F.get(tokens, i - 1).isNotNull()))
    return F.when((F.size(kept) > 0) & F.get(kept, F.size(kept) - 1).isNull(), F.slice(kept, 1, F.size(kept) - 1)).otherwise(kept)


def segments(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(other columns, pos, seg_id, token): the tokens between boundaries, numbered within their document; seg_id is the number of boundaries
    before. Runs are cut out between boundaries inside the row, in time linear in its tokens, and nothing is shuffled."""
    t, n = F.col(tokens), F.size(tokens)
    at = F.array_compact(F.transform(t, lambda x, i: F.when(x.isNull(), i)))
    rest = [c for c in df.columns if c != tokens]
    edges = df.withColumn("_edges", F.concat(F.array(F.lit(-1)), at, F.array(n)))
    run = lambda k: F.struct(k.alias("seg_id"), (F.get("_edges", k) + 1).alias("first"), F.slice(t, F.get("_edges", k) + 2, F.get("_edges", k + 1) - F.get("_edges", k) - 1).alias("own"))
    runs = edges.select(*rest, F.explode(F.transform(F.sequence(F.lit(0), F.size("_edges") - 2), run)).alias("_run"))
    return runs.select(*rest, "_run.seg_id", "_run.first", F.posexplode("_run.own").alias("_i", "token")).select(*rest, (F.col("first") + F.col("_i") + 1).alias("pos"), "seg_id", "token")


def in_vocabulary(df: DataFrame, vocabulary: DataFrame, tokens: str = "tokens", word: str = "word", limit: int = 2_000_000) -> DataFrame:
    """df with tokens outside the vocabulary as boundaries. A vocabulary of at most limit words, counted, goes to executors as a set; a
    larger one is joined."""
    if vocabulary.count() <= limit:
        shared = df.sparkSession.sparkContext.broadcast({r[0] for r in vocabulary.select(word).toLocalIterator()})

        @F.pandas_udf("array<string>")
        def mask(seqs: pd.Series) -> pd.Series:
            known = shared.value
            return seqs.map(lambda s: None if s is None else [t if t in known else None for t in s])

        return df.withColumn(tokens, mask(tokens))
    rest = [c for c in df.columns if c != tokens]
    each = df.withColumn("_id", F.monotonically_increasing_id()).select("_id", *rest, F.posexplode_outer(tokens).alias("_pos", "_t"))
    known = vocabulary.select(F.col(word).alias("_t"), F.lit(True).alias("_known")).distinct()
    kept = each.join(known, "_t", "left").withColumn("_t", F.when(F.col("_known"), F.col("_t")))
    return kept.groupBy("_id", *rest).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_t"))), lambda s: s["_t"]).alias(tokens)).drop("_id")


def maximal_matching(df: DataFrame, words: list[str], text: str = "text", out: str = "tokens") -> DataFrame:
    """df with tokens by dictionary maximal matching: of all ways to cover a text with dictionary words and unknown letters, one with
    the fewest unknown letters, then the fewest words; runs of unknown letters are one token. For scripts without spaces."""
    shared = df.sparkSession.sparkContext.broadcast(words)

    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        segment = segmenter(shared.value)
        for s in frames:
            yield s.map(lambda t: None if t is None else segment(t))

    return df.withColumn(out, F.pandas_udf(run, "array<string>")(text))


def segmenter(words: list[str]) -> Callable[[str], list[str]]:
    """maximal_matching for one text."""
    known, longest_ = set(words), max(map(len, words), default=1)

    def segment(text: str) -> list[str]:
        out: list[str] = []
        for chunk in text.split():
            n = len(chunk)
            best: list[tuple[int, int, int]] = [(0, 0, n)] * (n + 1)  # unknown letters, words, end of the first token
            for i in range(n - 1, -1, -1):
                rest = best[i + 1]
                options = [(rest[0] + 1, rest[1], i + 1)]
                for j in range(i + 1, min(n, i + longest_) + 1):
                    if chunk[i:j] in known:
                        options.append((best[j][0], best[j][1] + 1, -j))
                best[i] = min(options, key=lambda o: (o[0], o[1], -abs(o[2])))
            i, odd = 0, ""
            while i < n:
                j = best[i][2]
                if j < 0:
                    out += [odd] * bool(odd) + [chunk[i:-j]]
                    odd, i = "", -j
                else:
                    odd, i = odd + chunk[i:j], j
            out += [odd] * bool(odd)
        return out

    return segment
