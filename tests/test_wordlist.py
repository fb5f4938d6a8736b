from itertools import product

import random

import pytest
from pyspark.sql import functions as F

from lexmill.config import LATIN, WordlistConfig
from lexmill.operators import review, variants, wordlist

ENTRY = "word string, freq double, sources array<string>, romanizations array<string>, overridden boolean"


def test_decomposer():
    split = wordlist.decomposer({"abcdef", "ghijkl", "abc"})
    assert split("abcdefghijkl") == ["abcdef", "ghijkl"]
    assert split("abcdefghij") is None
    assert split("abcabc") == ["abc", "abc"]
    assert split("abc") is None


@pytest.mark.parametrize("limit", [100, 0])
def test_decompositions(spark, limit):
    words = [("abcdefghijkl",), ("abcdef",), ("ghijkl",), ("abc",), ("abcabcabcabc",), ("zzzzzzzzzzzz",)]
    got = wordlist.decompositions(spark.createDataFrame(words, "word string"), limit=limit)
    assert {r.word: r.parts for r in got.collect()} == {"abcdefghijkl": ["abcdef", "ghijkl"], "abcabcabcabc": ["abc"] * 4}


def test_redistribution(spark):
    words = spark.createDataFrame([("abcabcabcxyz", 0.4, ["p"]), ("abc", 0.1, ["q"]), ("xyz", 0.5, ["q"])], "word string, freq double, sources array<string>")
    parts = wordlist.decompositions(words)
    got = {r.word: (round(r.freq, 9), r.sources) for r in wordlist.redistributed(words, parts).collect()}
    assert got == {"abc": (0.4, ["p", "q"]), "xyz": (0.6, ["p", "q"])}


def test_overrides_exclusions_filters(spark):
    words = spark.createDataFrame([("one", 0.5, ["a", "b"]), ("two", 0.2, ["a"]), ("lonely", 0.2, ["dictionary"]), ("rare", 1e-7, ["a", "b"]), ("none", 0.1, ["a", "b"]), ("longlonglong", 0.1, ["a", "b"])], "word string, freq double, sources array<string>")
    v = spark.createDataFrame([("one", ["wan"]), ("two", ["tu"]), ("lonely", ["lonli"]), ("rare", ["rer"]), ("longlonglong", ["lng"])], "word string, romanizations array<string>")
    over = spark.createDataFrame([("one", ["won"]), ("new", ["nu"]), ("empty", [])], "word string, romanizations array<string>")
    e = wordlist.with_overrides(words, v, over)
    got = {r.word: (r.freq, r.romanizations, r.overridden) for r in e.collect()}
    assert got["one"] == (0.5, ["won"], True) and got["new"] == (1e-7, ["nu"], True) and got["none"] == (0.1, [], False) and "empty" not in got
    gone = spark.createDataFrame([("one",), ("two",)], "word string")
    kept = {r.word for r in wordlist.without_excluded(e, gone).collect()}
    assert "one" in kept and "two" not in kept
    why = {r.word: r.removed_reason for r in wordlist.removal_reasons(e, WordlistConfig(), LATIN).collect()}
    assert why == {"one": None, "new": None, "two": "few_sources", "lonely": None, "rare": "low_frequency", "none": "no_variants", "longlonglong": "length_ratio"}
    assert {r.word for r in wordlist.limited(e, 3).collect()} == {"one", "new", "lonely"}
    ids = wordlist.with_ids(wordlist.filtered(e, WordlistConfig(), LATIN))
    assert [(r.word_id, r.word) for r in ids.orderBy("word_id").collect()] == [(0, "one"), (1, "lonely"), (2, "new")]


def test_statistics(spark):
    e = spark.createDataFrame([("a", 0.1, ["s"], ["x", "y"], False), ("b", 0.1, ["s", "t"], ["x"], False), ("c", 0.1, ["t"], [], False), ("d", 0.1, ["t"], ["p", "q", "r", "s"], False)], ENTRY)
    assert wordlist.upper_median(e, F.size("romanizations")) == 2
    assert [tuple(r) for r in wordlist.collisions(e).collect()] == [("x", 2, "a|b")]
    assert {tuple(r) for r in wordlist.collision_histogram(e).collect()} == {(2, 1), (1, 5)}
    assert {r.source: (r.total, r.success, r.failed, r.variant_sum, r.unique_words) for r in wordlist.source_coverage(e).collect()} == {"s": (2, 2, 0, 3, 1), "t": (3, 2, 1, 5, 2)}
    r = wordlist.variant_stats(e).first()
    assert (r.vocab_size, r.total_keys, r.unique_keys, r.median_variants) == (4, 7, 6, 2)
    assert {tuple(r) for r in wordlist.variant_buckets(e).collect()} == {("0", 1), ("1-5", 3)}


def test_upper_median(spark):
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "v int")
    assert wordlist.upper_median(df, F.col("v")) == 3
    assert wordlist.upper_median(df.limit(0), F.col("v")) is None


KNOWN = {
    "onset": {"k": ["k", "g"], "kh": ["kh", "k"], "s": ["s"], "w": ["w"], "d": ["d"], "r": ["r"], "mh": ["m", "mh"], "ph": ["ph", "p"], "m": ["m"]},
    "vowel": {"a": ["a", "u", "ah"], "aa": ["a", "aa", "ar", "ah"], "i": ["i"], "ii": ["i", "ee", "ii"], "o": ["o", "oh"], "uu": ["u", "oo", "uu"]},
    "coda": {"n": ["n"], "w": ["w", "o", "u"], "s": ["t", "s"], "t": ["t", "d"]},
}


@pytest.mark.parametrize(("g2p", "segments", "want"), [
    ("kin0", "กิน", {"gin", "kin"}),
    ("dii0", "ดี", {"dee", "di", "dii"}),
    ("khaaw2", "ข้าว", {o + v + c for o, v, c in product(["kh", "k"], ["a", "aa"], "wou")}),
    ("muu4", "หมู", {"mhoo", "mhu", "mhuu", "moo", "mu", "muu"}),
    ("phiw4", "ผิว", {"phiu", "phiw", "piu", "piw"}),
    ("man0", "มัน", {"mahn", "man", "mun"}),
    ("maa0", "มา", {"ma", "maa", "mah", "mar"}),
    ("rot3", "รส", {"rohs", "roht", "ros", "rot"}),
    ("raa0~khaa0", "รา~คา", {"raakaa", "raakhaa", "rahkah", "rahkhah", "raka", "rakha", "rarkar", "rarkhar"}),
])
def test_variants(g2p, segments, want):
    assert set(variants.word_variants("x", variants.analyze(g2p, segments, KNOWN["vowel"]), KNOWN, 100)) == want


def test_variant_rules():
    s = variants.analyze("sa1'wat1~dii0", "สวัส~ดี", KNOWN["vowel"])
    assert [(x.onset, x.vowel, x.coda) for x in s] == [("s", "a", ""), ("w", "a", "s"), ("d", "ii", "")]
    found = variants.word_variants("sawatdi", s, KNOWN, 100)
    assert "sawatdee" in found and "sawasdee" in found and "sawaddee" not in found
    assert variants.word_variants("a-b", [], KNOWN) == ["ab"]
    assert variants.word_variants("", s, KNOWN) == []
    assert variants.word_variants("long", s * 4, KNOWN) == ["long"]
    assert len(variants.word_variants("x", s, KNOWN, 5)) == 5
    assert variants.independent([["k"]], [["a"]], [[]], "zz", 1) == ["zz"]
    assert variants.transliteration("a<tr/>kin0|x") == "kin0" and variants.transliteration("none") == ""


def test_native_and_arrow_variants_agree(spark):
    table = spark.createDataFrame([(k, g, v) for k, t in KNOWN.items() for g, v in t.items()], "kind string, g2p string, variants array<string>")
    syl = [(f"{o}|{v}|{c}", o, v, c) for o in ("k", "?", "zz") for v in ("a", "aa", "i", "qq") for c in ("", "w", "n")]
    native = variants.native_syllable_variants(variants.component_lists(spark.createDataFrame(syl, "syllable_id string, onset string, vowel string, coda string"), table))
    assert {r.syllable_id: r.variants for r in native.collect()} == {i: variants.syllable_variants(variants.Syllable(o, v, c), KNOWN) for i, o, v, c in syl}
    lex = spark.createDataFrame([("w", "kin", "kin0", "กิน"), ("e", "", None, None), ("b", "base", "", "")], "word string, base_roman string, g2p string, segments string")
    assert {r.word: r.romanizations for r in variants.generated(lex, variants.components(table)).collect()} == {"w": ["gin", "kin"], "e": [], "b": ["base"]}
    done = spark.createDataFrame([("w", ["old"])], "word string, romanizations array<string>")
    assert {r.word: r.romanizations for r in variants.resumed(lex, done, KNOWN).collect()} == {"w": ["old"], "e": [], "b": ["base"]}


def test_review(spark):
    draft = spark.createDataFrame([(0, "a", "common", "easy", ["x", "w"], "pending"), (1, "b", "edge", "hard", ["y"], "pending"), (2, "c", "common", "medium", ["z"], "pending")], "place int, word string, category string, difficulty string, variants array<string>, review_status string")
    said = spark.createDataFrame([("a", "approved", None, None, None), ("b", "edited", "common", "easy", ["v"]), ("c", "discarded", None, None, None)], "word string, review_status string, category string, difficulty string, variants array<string>")
    e = review.decided(draft, said)
    assert [(r.latin_input, r.expected) for r in review.exported(e).collect()] == [("v", "b"), ("w", "a"), ("x", "a")]
    assert review.exported(e, True).count() == 4
    assert review.next_pending(draft, 1) == 2 and review.next_pending(draft, 2) == 0 and review.next_pending(e, 0) is None
    assert {(r.field, r.value): r.n for r in review.progress(e).collect()}["category", "common"] == 3


def test_batches_and_answers(spark):
    words = spark.createDataFrame([(f"w{i}", float(10 - i)) for i in range(5)], "word string, freq double")
    b = review.batches(words, 2, 4)
    assert {r.batch: r.words for r in b.collect()} == {0: ["w0", "w1"], 1: ["w2", "w3"]}

    def ask(batch):
        if "w2" in batch:
            raise TimeoutError("late")
        return "Sure:\n```\n w0 \nzz\n```\nw1"

    got = {r.batch: (r.known, r.unknown, r.error) for r in review.parsed(review.answered(b, ask)).collect()}
    assert got == {0: (["w0"], ["zz"], None), 1: ([], [], "TimeoutError: late")}


def test_spellings_that_no_surroundings_share():
    """A component in three surroundings whose lists have nothing in common is spelled as in the first."""
    known = {"onset": {"k": ["k"]}, "vowel": {"a": ["x"], "i": ["i"]}, "coda": {}}
    lists = iter([(["k"], ["x", "y"], [""]), (["k"], ["y", "z"], [""]), (["k"], ["z", "x"], [""])])
    original, variants.component_variants = variants.component_variants, lambda s, k: next(lists)
    try:
        got = variants.consistent([variants.Syllable("k", "a", "", "") for _ in range(3)], known, 20)
    finally:
        variants.component_variants = original
    assert got == {"kxkxkx", "kykyky"}


def test_joined_decompositions_go_on_from_reached_places_only(spark):
    """Equal to the set's way on words of few letters, and no table of all pieces of a long word, of which there are two millions here."""
    r = random.Random(5)
    words = sorted({"".join(r.choices("abc", k=r.randrange(1, 15))) for _ in range(400)} | {"abcabcabca", "d" * 2000, "abc" * 12})
    df = spark.createDataFrame([(w,) for w in words], "word string")
    split = wordlist.decomposer(set(words))
    want = {w: p for w in words if len(w) >= 10 and (p := split(w))}
    made = []
    original = wordlist.cut
    try:
        wordlist.cut = lambda df, name="stage": (made.append(df._jdf.queryExecution().optimizedPlan().toString()), original(df, name))[1]
        got = {x.word: x.parts for x in wordlist.decompositions_joined(df).collect()}
    finally:
        wordlist.cut = original
    assert got == want and len(want) > 20 and max(map(len, want.values())) > 3
    assert made and all(p.count("Generate") <= 1 for p in made)
