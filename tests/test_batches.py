"""Counts of whole texts by tasks: equal to those of the expressions."""

import random
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.config import LATIN, THAI
from lexmill.functions.text import is_valid
from lexmill.functions.tokens import tokenize, with_boundaries
from lexmill.operators import batches, frequency, model, ngrams

CORPORA = ["de", "en", "none"]
ODD = ["", None, "   ", ",,,", "a", "Ab", "aaab aaaab aaaa aa abab", "x" * 31 + " " + "xy" * 15 + " y", "İstanbul STRASSE ÀÉ né", "œuvre🙂œuvre ñandú,ñandú ñandú", "one\ntwo\tthree\x0bfour\x1cfive", "ab ab ab ab ab", "end, of", "of end"]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(7)
    words = ["ab", "cd", "éf", "gh,", "-", "zzzz", "ij", "œl", "no1", "pq."]
    rows = [(r.choice(["de", "en", None, "other"]), " ".join(r.choices(words, k=r.randrange(60)))) for _ in range(300)]
    rows += [(c, t) for t in ODD for c in ("de", "en")]
    return spark.createDataFrame(rows, "corpus string, text string").repartition(3).persist()


def rows(df):
    return sorted(map(str, df.collect()))


def of_expressions(texts):
    return texts.select("corpus", with_boundaries(F.col("text"), LATIN).alias("tokens"))


def test_counts_of_texts_are_those_of_expressions(texts):
    want = ngrams.counts(of_expressions(texts))
    assert rows(ngrams.text_counts(texts, LATIN).select(*want.columns)) == rows(want)
    raw = texts.select("corpus", F.explode(tokenize(F.col("text"), LATIN)).alias("word")).filter(is_valid(F.col("word"), LATIN)).groupBy("corpus", "word").agg(F.count("*").alias("cnt"))
    assert rows(frequency.word_counts(texts, LATIN)) == rows(raw)


def test_measures_of_texts_are_those_of_expressions(texts):
    want = ngrams.measured(ngrams.wide_counts(of_expressions(texts), CORPORA), CORPORA)
    assert rows(ngrams.text_measured(texts, LATIN, CORPORA).select(*want.columns)) == rows(want)


def test_model_of_texts_counts_valid_words_only(spark, texts):
    g = ngrams.measured(ngrams.wide_counts(of_expressions(texts), CORPORA), CORPORA).persist()
    uni = g.filter("n = 1").withColumnRenamed("w1", "word")
    want = ngrams.valid_tokens(uni, uni.filter("n_sources > 0").select("word", "n_sources"), g.select("n", "w1", "freq"), 2, 0.02)
    v, kept = ngrams.text_model(texts, LATIN, CORPORA, 3, 3, min_frequency=0.02)
    assert 0 < want.count() < uni.count() and rows(v) == rows(want.select(*v.columns))
    for n, score in ((2, model.bigram_scores), (3, model.trigram_scores)):
        full = ngrams.surviving(g, want, n, 3)
        assert full.count() > 0 and rows(kept.filter(F.col("n") == n)) == rows(full.select(*kept.columns))
        freqs = kept.filter("n > 1").unionByName(v.select(F.lit(1).alias("n"), F.col("word").alias("w1"), "freq"), allowMissingColumns=True)
        assert rows(score(kept.filter(F.col("n") == n), freqs)) == rows(score(full, g))
    few = spark.createDataFrame([("ab",), ("cd",), ("of",)], "word string")
    inside = ngrams.text_model(texts, LATIN, CORPORA, 3, 3, few, min_frequency=0.02)[1].filter("n > 1")
    assert inside.count() > 0 and rows(inside) == rows(kept.filter("n > 1 and w1 in ('ab', 'cd') and w2 in ('ab', 'cd') and (n = 2 or w3 in ('ab', 'cd'))"))


def test_vocabulary_is_looked_up_before_the_shuffle(spark, texts):
    known = spark.createDataFrame([("ab",), ("éf",), ("gh",), (None,), ("zzzz",)], "word string")
    want = ngrams.within(ngrams.counts(of_expressions(texts)), known, 2)
    assert rows(ngrams.text_counts(texts, LATIN, (2,), known).select(*want.columns)) == rows(want)


def batch(texts, corpora=None):
    return pa.record_batch([pa.array(corpora or ["de"] * len(texts), pa.string()), pa.array(texts, pa.string())], names=["corpus", "text"])


def summed(found):
    out = {}
    for b in found:
        for r in b.to_pylist():
            key = r["corpus"], r["n"], r["gram"]
            out[key] = out.get(key, 0) + r["cnt"]
    return out


def test_slices_and_chunks_do_not_change_counts(monkeypatch):
    r = random.Random(3)
    all_texts = [" ".join(r.choices(["ab", "cd", "ef", "ñg", ",", "h"], k=r.randrange(40))) for _ in range(200)]
    count = lambda: summed(batches.counter(LATIN, (1, 2, 3), (1, 2, 3), None)(iter([batch(all_texts)])))
    want = count()
    for name, value in (("SLICE_BYTES", 100), ("CHUNK", 50), ("OUT_ROWS", 7)):
        monkeypatch.setattr(batches, name, value)
    assert count() == want and want["de", 3, None] == sum(v for k, v in want.items() if k[1] == 3 and k[2])


def test_windows_of_many_words():
    """Trigrams of so many words that they don't fit 63 bits."""
    codes = np.array([5, 2_999_999, 7, 5, 2_999_999, 7, 2_999_998])
    for size in (3_000_000,):
        cols, found = batches.windows(codes, np.arange(2, 7), 3, size)
        got = {tuple(int(x) for x in k): int(n) for *k, n in zip(*cols, found, strict=True)}
        assert got == {(5, 2_999_999, 7): 2, (2_999_999, 7, 5): 1, (7, 5, 2_999_999): 1, (2_999_999, 7, 2_999_998): 1}


def test_other_scripts(spark):
    assert batches.plain(LATIN) and batches.plain(THAI) and not batches.plain(replace(LATIN, tokens=r"\S+"))
    t = ["กิน ข้าว ๆๆ ๆก ะะ กกกกก กา", "สวัสดี ครับ abc ครับ สวัสดี"]
    df = spark.createDataFrame([("x", x) for x in t], "corpus string, text string")
    want = ngrams.counts(df.select("corpus", with_boundaries(F.col("text"), THAI).alias("tokens")))
    assert want.count() > 5 and rows(ngrams.text_counts(df, THAI).select(*want.columns)) == rows(want)
    spaced = replace(LATIN, tokens=r"\S+")
    want = ngrams.counts(df.select("corpus", with_boundaries(F.col("text"), spaced).alias("tokens")))
    assert rows(ngrams.text_counts(df, spaced).select(*want.columns)) == rows(want)


def test_token_lines_are_those_of_expressions(spark, texts, tmp_path):
    from lexmill.sources import sinks

    sinks.token_files(of_expressions(texts), str(tmp_path / "a"))
    sinks.text_tokens(texts, LATIN, str(tmp_path / "b"))
    # the lines of a corpus, in files of the order of partitions
    read = lambda x: sorted((str(r.corpus), r.value) for r in spark.read.text(str(tmp_path / x), wholetext=True).collect())
    assert len(read("a")) > 3 and read("a") == read("b")
    assert summed_lines(["ab, ab cd", ",", "x ab", "ab x , cd,"]) == ["ab\n\nab\ncd", "ab", "ab\n\ncd"]


def summed_lines(t):
    return [r["t"] for b in batches.liner(LATIN)(iter([batch(t)])) for r in b.to_pylist()]


def test_raw_counts_of_texts(texts):
    want = ngrams.measured(ngrams.wide_counts(of_expressions(texts), CORPORA), CORPORA).filter("cnt >= 2").select("n", "w1", "w2", "w3", "cnt")
    assert rows(ngrams.text_raw(texts, LATIN, CORPORA)) == rows(want)


def test_rounded_frequencies_are_those_of_expressions(texts):
    want = ngrams.measured(ngrams.wide_counts(of_expressions(texts), CORPORA), CORPORA).withColumn("freq", F.round("freq", 4))
    assert want.filter("cnt = 1").count() > 0 and rows(ngrams.text_measured(texts, LATIN, CORPORA, digits=4).select(*want.columns)) == rows(want)
