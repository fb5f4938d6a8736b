from math import log

import pytest
from pyspark.sql import functions as F

from lexmill.config import UNIGRAM_SEARCH, SearchConfig
from lexmill.operators import evaluation, lattice

KEYS = [("ab", 1, "A", 0.02), ("a", 2, "B", 0.3), ("b", 3, "C", 0.2), ("bc", 4, "D", 0.01), ("c", 5, "E", 0.4), ("ab", 6, "F", 0.001)]


@pytest.fixture(scope="module")
def edges(spark):
    keys = spark.createDataFrame(KEYS, "romanization_key string, word_id int, word string, frequency double")
    return lattice.edges(spark.createDataFrame([(1, "AB c"), (2, "xyz"), (3, ""), (4, "abcabc")], "query_id long, input string"), keys).persist()


def test_edges(edges):
    assert sorted((r.s, r.e, r.word) for r in edges.filter("query_id = 1").collect()) == [(0, 1, "B"), (0, 2, "A"), (0, 2, "F"), (1, 2, "C"), (1, 3, "D"), (2, 3, "E")]
    assert {r[0] for r in edges.select("query_id").distinct().collect()} == {1, 4}


def test_search_agrees_with_all_paths(edges):
    config = SearchConfig(UNIGRAM_SEARCH.penalty, UNIGRAM_SEARCH.floor, 0.0, 4, 1000)
    beam = {(r.query_id, r.words): round(r.cost, 9) for r in lattice.search(edges, config).collect()}
    every = {(r.query_id, r.words): round(r.cost, 9) for r in lattice.exhaustive(edges, config).collect()}
    assert beam == every and len(every) > 10


def test_backoff_beam():
    uni, bi, tri = {"B": log(0.5, 10), "C": log(0.2, 10)}, {("B", "C"): log(0.9, 10)}, {}
    s = lattice.Backoff(uni, bi, tri)
    assert s.prob(None, None, "B") == pytest.approx(0.5)
    assert s.prob(None, "B", "C") == pytest.approx(0.9)
    assert s.prob("B", "B", "C") == pytest.approx(0.4 * 0.9)
    assert s.prob("B", "C", "B") == pytest.approx(0.4 * 0.4 * 0.5)
    rows = [(0, 1, "B", 0.3), (1, 2, "C", 0.2), (0, 2, "A", 0.02)]
    found = lattice.beam(2, rows, SearchConfig(), s)
    costs = {o: c for o, c, _ in found}
    assert costs["BC"] == pytest.approx(-log(0.3) + 1 - 2 * log(0.5) - log(0.2) + 1 - 2 * log(0.9))
    assert costs["A"] == pytest.approx(-log(0.02) + 1 - 2 * log(6e-6))
    assert [o for o, _, _ in found] == ["BC", "A"]
    assert lattice.beam(0, [], SearchConfig(), s) == []


def test_published_costs():
    freq = lambda cost, n: 2.718281828459045 ** -(cost - 0.5 * n)
    rows = [(0, 8, "whole", freq(6.309143, 1)), (0, 5, "one", 0.001), (5, 8, "two", 0.002)]
    found = lattice.beam(8, rows, UNIGRAM_SEARCH, None)
    assert [(o, round(c, 6)) for o, c, _ in found] == [("whole", 6.309143), ("onetwo", round(-log(0.001) - log(0.002) + 1, 6))]


def test_search_with_scores(spark, edges):
    uni = spark.createDataFrame([(w, log(f, 10)) for _, _, w, f in KEYS], "word string, score double")
    bi = spark.createDataFrame([("B", "C", -0.1), ("C", "E", -0.2)], "w1 string, w2 string, score double")
    tri = spark.createDataFrame([("B", "C", "E", -0.05)], "w1 string, w2 string, w3 string, score double")
    got = lattice.search(edges, SearchConfig(), uni, bi, tri)
    best = got.filter("query_id = 1 and rank = 1").first()
    assert best.words == "B C E"
    cases = spark.createDataFrame([(1, "abc", "BCE"), (1, "abc", "FE"), (1, "abc", "nope")], "query_id long, input string, expected string")
    assert {r.expected: r.status for r in lattice.judged(cases, got).collect()} == {"BCE": "pass", "FE": "warn", "nope": "fail"}


def test_metrics(spark):
    df = spark.createDataFrame([(["x", "y", "z"], "y"), ([], "q")], "candidates array<string>, expected string")
    r = evaluation.ranking_metrics(df, (1, 2)).first()
    assert (r.p_at_1, r.p_at_2, r.mrr, r.coverage) == (0.0, 0.5, 0.25, 0.5)
    sets = spark.createDataFrame([(["a", "b", "b"], ["b", "c"]), ([], []), (["a"], [])], "p array<string>, e array<string>")
    assert [tuple(x) for x in sets.select(*evaluation.word_f1(F.col("p"), F.col("e")).values()).collect()] == [(0.5, 0.5, 0.5), (1.0, 1.0, 1.0), (0.0, 0.0, 0.0)]


def test_recall_and_rollup(spark):
    e = spark.createDataFrame([("w", ["ka", "ga"]), ("v", [])], "word string, romanizations array<string>")
    b = spark.createDataFrame([("Ka", "w"), ("xx", "w"), ("v", "v"), ("u", "u")], "latin_input string, expected string")
    rows = evaluation.recall_rows(b, e)
    r = evaluation.recall_summary(rows).first()
    assert (r.total, r.hits, r.word_missing, r.key_missing, r.recall, r.zero_variant_words) == (4, 1, 1, 2, 0.25, 1)
    assert [x.expected for x in evaluation.missed(rows, 2).collect()] == ["u", "v"]
    rank = spark.createDataFrame([("t1", "a", "b"), ("t1", "", "a"), ("t2", "b", "a")], "type string, context string, expected_top string")
    uni, bi = spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a", "b")], "w1 string, w2 string")
    assert {tuple(x) for x in evaluation.ranking_coverage(rank, uni, bi).collect()} == {("t1", 2, 2), ("t2", 1, 0), ("TOTAL", 3, 2)}


def test_metrics_take_whole_texts_and_all_items(spark, tmp_path):
    """50 items, and expected words beyond the fortieth word of a text."""
    from lexmill.plans import queries

    texts = {i: " ".join(f"w{i}x{k}" for k in range(60)) + f" e{i}" for i in range(50)}
    spark.createDataFrame([(i, f"a b e{i}") for i in range(50)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    r = queries.q_metrics_mrr_p_at_k(spark, str(tmp_path)).first()
    assert (r.n, r.p_at_10, r.mrr, r.coverage) == (50, 0.0, round(1 / 61, 9), 1.0)
    f1 = queries.q_metrics_word_f1(spark, str(tmp_path)).collect()
    assert len(f1) == 50 and {(x.precision, x.recall) for x in f1} == {(round(1 / 61, 9), round(1 / 3, 9))}


def test_edges_of_all_words_in_whole_texts(spark, tmp_path):
    """A rare word far beyond the first words of a text, beside 400 more frequent ones."""
    from lexmill.plans import queries

    words = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "pqrstvwx"]
    docs = [(1, " ".join(words * 2) + " zyxwvzyxwv", "en", "s", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, " ".join(words[:8]) + " zyxwvzyxwv")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.s, r.e, r.word) for r in queries.q_lattice_edges(spark, str(tmp_path)).collect()}
    assert {(3 * i, 3 * i + 3, w) for i, w in enumerate(words[:8])} <= got and (24, 34, "zyxwvzyxwv") in got
