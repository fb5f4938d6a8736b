from math import isclose, log10

import pytest
from pyspark.sql import functions as F

from lexmill.config import LATIN
from lexmill.functions.tokens import segments, with_boundaries
from lexmill.operators import frequency, model, ngrams

CORPORA = ["x", "y"]
ROWS = [("x", ["a", "b", None, "a", "b", "c"]), ("x", ["a"]), ("y", ["b", "c", "b", "c"]), ("y", ["c", None, "c"]), ("y", [])]


@pytest.fixture(scope="module")
def grams(spark):
    return ngrams.counts(spark.createDataFrame(ROWS, "corpus string, tokens array<string>")).persist()


def as_dict(df, *value):
    return {"".join(x for x in (r.w1, r.w2, r.w3) if x): tuple(r[v] for v in value) for r in df.collect()}


def test_grams(grams):
    assert as_dict(grams.filter("corpus = 'x'"), "cnt") == {"a": (3,), "b": (2,), "c": (1,), "ab": (2,), "bc": (1,), "abc": (1,)}
    assert as_dict(grams.filter("corpus = 'y'"), "cnt") == {"b": (2,), "c": (4,), "bc": (2,), "cb": (1,), "bcb": (1,), "cbc": (1,)}
    assert as_dict(ngrams.raw_merged(grams, 3), "cnt") == {"a": (3,), "b": (4,), "c": (5,), "bc": (3,)}


def test_normalized_merge(grams):
    got = as_dict(ngrams.normalized_merged(grams, CORPORA), "freq")
    want = {"a": 1 / 4, "b": 1 / 3, "c": 5 / 12, "ab": 1 / 3, "bc": 1 / 2, "cb": 1 / 6, "abc": 1 / 2, "bcb": 1 / 4, "cbc": 1 / 4}
    assert got.keys() == want.keys() and all(isclose(got[k][0], v) for k, v in want.items())
    assert isclose(as_dict(ngrams.normalized_merged(grams, [*CORPORA, "empty"]), "freq")["a"][0], 1 / 6)


def test_scores_and_lookup(spark, grams):
    freqs = ngrams.normalized_merged(grams, CORPORA)
    valid = freqs.filter("n = 1").select(F.col("w1").alias("word"), "freq")
    raw = ngrams.raw_merged(grams, 1)
    uni = model.unigram_scores(valid)
    bi = model.bigram_scores(ngrams.surviving(raw, valid, 2, 1), freqs)
    tri = model.trigram_scores(ngrams.surviving(raw, valid, 3, 1), freqs)
    two = {(r.w1, r.w2): r.score for r in bi.collect()}
    assert {k: round(v, 9) for k, v in two.items()} == {("a", "b"): 0.124938737, ("b", "c"): 0.176091259, ("c", "b"): -0.397940009}
    assert {(r.w1, r.w2, r.w3): round(r.score, 9) for r in tri.collect()} == {("a", "b", "c"): 0.176091259, ("b", "c", "b"): -0.301029996, ("c", "b", "c"): 0.176091259}
    q = spark.createDataFrame([(None, None, "c"), (None, "a", "c"), ("a", "c", "b"), (None, None, "zz"), ("a", "b", "zz")], "prev2 string, prev1 string, word string")
    got = {(r.prev2, r.prev1, r.word): r.prob for r in model.lookup(q, uni, bi, tri).collect()}
    want = {(None, None, "c"): 5 / 12, (None, "a", "c"): 0.4 * 5 / 12, ("a", "c", "b"): 0.4 * 2 / 5, (None, None, "zz"): 6e-6, ("a", "b", "zz"): 0.16 * 6e-6}
    assert all(isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())


def test_sources_and_valid(spark, grams):
    src = ngrams.token_sources(grams, 2)
    assert {tuple(r) for r in src.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    v = spark.createDataFrame([("a",), ("b",), ("q",)], "word string")
    assert [r.word for r in ngrams.valid_tokens(v, src, ngrams.normalized_merged(grams, CORPORA), 2).collect()] == ["b"]


def test_words(spark):
    texts = spark.createDataFrame([("x", "the the cat 1 a"), ("x", None), ("y", "cat dog")], "corpus string, text string")
    counts = frequency.word_counts(texts, LATIN)
    assert {tuple(r) for r in counts.collect()} == {("x", "the", 2), ("x", "cat", 1), ("y", "cat", 1), ("y", "dog", 1)}
    m = frequency.merged(frequency.normalized(counts), CORPORA)
    got = {r.word: (round(r.freq, 9), r.sources) for r in m.collect()}
    assert got == {"the": (round(1 / 3, 9), ["x"]), "cat": (round(5 / 12, 9), ["x", "y"]), "dog": (0.25, ["y"])}
    assert [(r["rank"], r.word) for r in frequency.ranked(m).orderBy("rank").collect()] == [(1, "cat"), (2, "the"), (3, "dog")]
    top = {r.word: (r["rank"], r.x_rank, r.y_rank, r.corpus_count) for r in frequency.top_with_ranks(m, frequency.normalized(counts), CORPORA, 2).collect()}
    assert top == {"cat": (1, 2, 1, 2), "the": (2, 1, None, 1)}
    w = frequency.shares(CORPORA, {"x": 3.0, "y": 1.0})
    assert w == {"x": 0.75, "y": 0.25}
    with pytest.raises(ValueError):
        frequency.shares(CORPORA, {})


def test_empty(spark):
    none = frequency.word_counts(spark.createDataFrame([], "corpus string, text string"), LATIN)
    assert frequency.merged(frequency.normalized(none), CORPORA).count() == 0
    assert frequency.ranked(spark.createDataFrame([], "word string, freq double")).count() == 0


def test_ranks_are_dense_over_partitions(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("word"), (F.col("id") % 7).cast("double").alias("freq")).repartition(13)
    assert [r[0] for r in frequency.ranked(df).select("rank").orderBy("rank").collect()] == list(range(1, 5001))


def test_log_of_frequency(spark):
    v = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "word string, freq double")
    assert {r.word: r.score for r in model.unigram_scores(v).collect()} == {"a": log10(0.5), "b": log10(2.0)}


def test_ranks_are_dense_at_any_size(spark):
    """Many partitions and a payload column, under adaptive execution: 1 to n, each once, in order."""
    n = 3_000_000
    words = spark.range(n).select(F.concat(F.lit("w"), "id").alias("word"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("freq"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    got = frequency.ranked(words)
    r = got.agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("low"), F.max("rank").alias("high"), F.count_if(F.length("payload") == 64).alias("whole")).first()
    assert tuple(r) == (n, n, 1, n, n)
    top = words.orderBy(F.desc("freq"), "word").limit(5).collect()
    assert [x.word for x in got.filter("rank <= 5").orderBy("rank").collect()] == [x.word for x in top]


def test_wide_counts_are_the_merges(spark):
    rows = [("a", ["x", "y", None, "x"]), ("a", ["x", "y", "z"]), ("b", ["x"]), ("b", []), ("c", [None, "y", "x", "y"])]
    tokens = spark.createDataFrame(rows, "corpus string, tokens array<string>")
    corpora = ["a", "b", "c", "none"]
    g = ngrams.counts(tokens)
    m = ngrams.measured(ngrams.wide_counts(tokens, corpora), corpora)
    key = lambda df, *c: sorted(map(str, df.select("n", "w1", "w2", "w3", *c).collect()))
    assert key(m.filter("cnt >= 2"), "cnt") == key(ngrams.raw_merged(g), "cnt")
    assert key(m, F.round("freq", 12).alias("f")) == key(ngrams.normalized_merged(g, corpora), F.round("freq", 12).alias("f"))
    assert sorted(map(tuple, m.filter("n = 1 and n_sources > 0").select("w1", "n_sources").collect())) == sorted(map(tuple, ngrams.token_sources(g).select("word", "n_sources").collect()))


def test_long_texts_have_segments(spark):
    text = " ".join("12 wort" if i % 5 == 0 else "worte" for i in range(30_000))
    df = spark.createDataFrame([(1, text), (2, ""), (3, "12"), (4, "ein 12 wort")], "id long, text string").select("id", with_boundaries(F.col("text"), LATIN).alias("tokens"))
    got = segments(df)
    assert got.filter("id = 1").agg(F.count("*"), F.max("seg_id"), F.max("pos")).first()[:] == (30_000, 6000, 36_000)
    assert sorted(map(tuple, got.filter("id > 1").collect())) == [(4, 1, 0, "ein"), (4, 3, 1, "wort")]
