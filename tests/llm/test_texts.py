"""Rules, language ID, classifiers and BPE."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmill.llm import bpe, langid, quality, rules, toxicity
from lexmill.llm.common import bounded_sample

PATH = public_tokenizers.path("word_bpe_49k.json")
MODEL, REFERENCE = bpe.Model(PATH), Tokenizer.from_file(PATH)
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TEXT = st.text(alphabet=st.one_of(st.sampled_from("aAbBsStT'|<>!.,019éÉßΣσİ中ไ́ \u0085\x1c \n\t😀#*$%&"), st.characters(codec="utf-8", exclude_categories=("Cs",))), max_size=80)


def stats(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(TEXT, st.text(alphabet="ab \n", max_size=60)), max_size=8))
def test_measures(texts):
    found = rules.measure(pa.array(texts, pa.string()))
    keys = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(found[k][i]) for k in keys) for i in range(len(texts))] == [stats(t) for t in texts]


def test_sketches_merge(spark):
    rng = random.Random(1)
    rows = [(i, "en", "s", 100, 500, rng.randint(0, 50), 0, 0, 0, 0, 4) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, lang string, source string, " + rules.STATS)
    one = rules.sketch(df, ["lang"])
    two = rules.sketch(df.filter("doc_id < 700"), ["lang"]).unionByName(rules.sketch(df.filter("doc_id >= 700"), ["lang"]))
    q = [sorted(map(tuple, rules.quantiles(x, ["lang"]).collect())) for x in (one, two)]
    assert q[0] == q[1]
    got = next(r for r in q[0] if r[1] == "symbol_share")
    true = np.quantile([r[5] / 500 for r in rows], [0.5, 0.75], method="inverted_cdf")
    assert all(abs(a - b) <= 0.03 * (b + 0.002) for a, b in zip(got[3:], true, strict=True))


def test_thresholds_follow_their_group(spark, prose):
    rows = [(i, prose("aa", 80), "aa", "calm") for i in range(60)] + [(100 + i, prose("aa", 60) + " #" * 12, "aa", "noisy") for i in range(60)]
    rows += [(300, prose("aa", 60) + " #" * 12, "aa", "calm"), (301, "again again " * 60, "aa", "calm"), (302, "short", "aa", "calm")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] == (False, True) for i in [*range(60), *range(100, 160)])
    assert got[300] == (False, False) and got[301] == (True, False) and got[302] == (True, False)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert sorted(r.doc_id for r in rules.keep(docs).collect()) == sorted(i for i, v in got.items() if v[1])


def test_verdicts_against_exact_quantiles(spark, prose):
    """kept by plain loops: limits from sorted values on the sketch's grid, by language and source, language, or all."""
    rng = random.Random(6)
    rows = []
    for i in range(420):
        lang, source = (("aa", "calm"), ("aa", "loud"), ("bb", "calm"), ("bb", "rare"), ("cc", None))[0 if i < 120 else 1 if i < 240 else 2 if i < 360 else 3 if i < 390 else 4]
        marks = rng.choice([0, 0, 1, 3, 9, 30] if source != "loud" else [20, 25, 30, 40, 90])
        words = prose(lang, rng.randint(40, 90)).split()
        words += rng.choices(["#", "!!", "BIG"], k=marks) + words[:4] * rng.choice([0, 0, 0, 2, 9])
        rows.append((i, " ".join(words) + "\nend\nend" * rng.choice([0, 0, 3]), lang, source))
    got = {r.doc_id: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 2.0, 50).collect()}
    ratio = lambda r, a, b, less=0: (r[a] - less) / r[b] if r[b] else 0.0
    inside = [r for r in got.values() if not r.base_failed]
    assert 0 < sum(r.kept for r in inside) < len(inside) - 20

    def limits(own, a, b, q):
        buckets = sorted(math.ceil(math.log(ratio(r, a, b) + 0.001) / math.log(rules.GRID)) for r in own)
        at = lambda p: max(0.0, rules.GRID ** (next(x for i, x in enumerate(buckets, 1) if i >= p * len(buckets)) - 0.5) - 0.001)
        spread = lambda end: max(abs(end - at(0.5)), 0.05 * end)
        return at(q) + 2.0 * spread(at(q)), at(0.25) - 2.0 * spread(at(0.25))

    constant = 0
    for r in got.values():
        groups = [[x for x in inside if (x.lang, x.source) == (r.lang, r.source)], [x for x in inside if x.lang == r.lang], inside]
        own = next((g for g in groups if len(g) >= 50), inside)
        within, fixed = True, True
        for name, a, b, one, q in rules.MEASURES:
            (high, low), (top, _) = limits(own, a, b, q), limits(inside, a, b, q)
            within &= ratio(r, a, b, one) <= high and (name not in rules.BOTH_SIDES or ratio(r, a, b) >= low)
            fixed &= ratio(r, a, b, one) <= top
        assert r.kept == (not r.base_failed and within), r
        constant += fixed != within
    assert constant > 20  # limits that are the same for all give other verdicts


def test_thresholds_have_no_floors(spark, prose):
    """A few symbols are far outside a source without any, and words far shorter than a source's are outside as well."""
    rows = [(i, prose("aa", 80), "aa", "calm") for i in range(60)]
    few = prose("aa", 100)
    few += " #" * int(0.019 * len(few))
    assert 0.01 < few.count("#") / len(few) < 0.02
    rows += [(100, few, "aa", "calm"), (101, " ".join(f"{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"), "aa", "calm"), (102, prose("aa", 80) + " #", "aa", "calm")]
    got = {r.doc_id: (r.base_failed, r.kept) for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got.pop(100) == got.pop(101) == (False, False)
    assert all(v == (False, True) for v in got.values())


def test_rules_on_odd_rows(odd, empty):
    got = rules.judge(odd).collect()
    assert len(got) == 11 and not any(r.kept for r in got)
    assert {r.doc_id: r.n_words for r in got}[1] == 0
    assert rules.judge(empty).count() == 0 and rules.keep(empty).count() == 0
    assert rules.keep(odd).columns == odd.columns


def parse(text, sample):
    """Phrases by the longest match in a sample's text, without an automaton."""
    n = at = 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in sample:
            size += 1
        at, n = at + size, n + 1
    return n


def test_cross_parsing_agrees_with_search(prose, monkeypatch):
    samples = {x: [prose(x, 60)] for x in ("aa", "bb")} | {"runs": ["aaa bb"]}
    texts = [prose("aa", 120), prose("bb", 5), "", "ÀÉ 99 !", prose("cc", 30), samples["aa"][0][3:] * 9, "a" * 5000, "b" * 700 + "aa" * 300, prose("bb", 400)]
    for full, overrun in ((langid.FULL, 1024), (0, 1024), (langid.FULL, 3)):
        monkeypatch.setattr(langid, "FULL", full)
        monkeypatch.setattr(langid, "OVERRUN", overrun)
        m = langid.Model(samples, 400)
        found, at = langid.codes(pa.array(texts), m.table)
        got = m.phrases(found, at)
        for j, lang in enumerate(m.langs):
            own, o = langid.codes(pa.array(samples[lang]), m.table)
            use = bytes(own[: min(o[1], 400)])
            assert [parse(bytes(found[s:e]), use) for s, e in zip(at[:-1], at[1:], strict=True)] == got[:, j].tolist()


def test_a_copy_of_the_sample_is_one_phrase(prose):
    text = prose("aa", 300)
    m = langid.Model({"aa": [text], "bb": [prose("bb", 300)]}, 24_000)
    found, at = langid.codes(pa.array([text]), m.table)
    assert len(found) > 1000 and m.phrases(found, at)[0, 0] == 1


def test_odd_texts(prose):
    """Texts of a language that no sample has are odd, others of the samples' languages are not."""
    rng = random.Random(1)
    m = langid.Model({x: [prose(x, 150) for _ in range(40)] for x in ("aa", "bb")}, 24_000)
    odd = "".join(rng.choice("qwxzvyk ") for _ in range(400))
    langs, _, oddness = m.predict(pa.array([prose("aa", 60), prose("bb", 200), odd, None]))
    assert langs[:2] == ["aa", "bb"] and langs[3] == "und" and (oddness[:2] < 1.3).all() and oddness[2] > 1.5 and oddness[3] == 0


def test_the_fewest_phrases_win(prose):
    """The choice and its score against phrases by search."""
    samples = {x: [prose(x, 80)] for x in ("aa", "bb", "cc", "dd")}
    m = langid.Model(samples, 24_000)
    texts = [prose(x, 9) for x in samples] + ["kato schu", "zzz"]
    found, at = langid.codes(pa.array(texts), m.table)
    langs, scores, _ = m.predict(pa.array(texts))
    for s, e, lang, score in zip(at[:-1], at[1:], langs, scores, strict=True):
        norm = {}
        for x in sorted(samples):
            own, _ = langid.codes(pa.array(samples[x]), m.table)
            norm[x] = parse(bytes(found[s:e]), bytes(own)) * np.log2(len(own) + 2) / (e - s)
        best = min(norm, key=lambda x: (norm[x], x))
        assert lang == best and score == pytest.approx(1 - norm[best] / sorted(norm.values())[1])


def test_suffix_automaton_accepts_substrings():
    text = np.array([1, 2, 1, 2, 2, 1, 3], np.uint8)
    t = langid.suffix_automaton(text, 4)
    subs = {tuple(text[i:j]) for i in range(7) for j in range(i + 1, 8)}
    for n in (1, 2, 3):
        for s in np.ndindex(*[4] * n):
            state = 0
            for c in s:
                state = t[state, c] if state >= 0 else -1
            assert (state >= 0) == (s in subs)


def test_every_letter_counts(monkeypatch):
    """Relatives that differ in rare letters of one script, beside languages of many letters; full and sorted transitions agree."""
    rng = random.Random(3)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
    alphabets = {"la": "abcdefghijklmnopqrstuvwxyzäöüßéèêñçàâîôûœæøå", "ru": "абвгдежзиклмнопрстуыэъё", "uk": "абвгдежзиклмнопрстуіїєґ", "el": "αβγδεζηθικλμνξοπρστυφχψω"}
    alphabets |= {"zh": "".join(chr(0x4E00 + i) for i in range(300)), "ja": "".join(chr(0x5200 + i) for i in range(300))}
    text = lambda lang, n: " ".join(word(alphabets[lang]) for _ in range(n))
    samples = {x: [text(x, 2000 if x == "la" else 400)] for x in alphabets}
    # words of common letters only, but for one at the end of each
    rare = {"ru": "ыэъё", "uk": "іїєґ"}
    held = [(x, text(x, 40)) for x in alphabets for _ in range(5)] + [(x, " ".join(word("абвгде") + rng.choice(rare[x]) for _ in range(40))) for x in rare for _ in range(5)]
    texts = pa.array([t for _, t in held])
    m = langid.Model(samples, 24_000)
    letters = set("".join(t for x in samples.values() for t in x)) - {" "}
    assert len({m.table[ord(c)] for c in letters} - {0, 1}) == len(letters) > 600
    assert m.predict(texts)[0] == [x for x, _ in held]
    monkeypatch.setattr(langid, "FULL", 0)
    other = langid.Model(samples, 24_000)
    assert all(a.full is None for a in other.automata) and any(a.full is not None for a in m.automata)
    found, at = langid.codes(texts, m.table)
    assert (m.phrases(found, at) == other.phrases(found, at)).all()


def test_language_id(spark, prose, odd, empty):
    rows = [(i, prose(x, 40), x, "s") for i, x in enumerate(["aa", "bb", "cc", "dd"] * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs.filter("doc_id % 4 < 10 and doc_id < 80"))
    got = {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()}
    held = [i for i in got if i >= 80]
    assert sum(got[i] == rows[i][2] for i in held) >= 0.97 * len(held)
    o = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(odd, model).collect()}
    assert o[1] == o[2] == o[3] == ("und", 0.0) and o[6][0] != "und" and all(0 <= s <= 1 for _, s in o.values())
    assert langid.predict(empty, model).count() == 0
    none = langid.fit(empty)
    assert [r.lang_pred for r in langid.predict(docs.limit(1), none).collect()] == ["und"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(TEXT, st.just("it's <|endoftext|>x <|startoftext|>THE'LL")), min_size=1, max_size=4))
def test_bpe_is_the_library(texts):
    ids, at = MODEL.encode(pa.array(texts))
    for t, s, e in zip(texts, at[:-1], at[1:], strict=True):
        want = REFERENCE.encode(t, add_special_tokens=False).ids
        assert ids[s:e].tolist() == want
        assert MODEL.decode(want) == REFERENCE.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("context", ["a@b", "!@@1", "é@\u0323x"])
def test_every_code_point(context):
    every = [context.replace("@", chr(c)) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for s in range(0, len(every), 50_000):
        ids, at = MODEL.encode(pa.array(every[s : s + 50_000]))
        want = [e.ids for e in REFERENCE.encode_batch(every[s : s + 50_000], add_special_tokens=False)]
        assert np.diff(at).tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x]


def test_long_chunks():
    rng = random.Random(8)
    for text in ("".join(rng.choice("etaoinshrdluqz") for _ in range(60_000)), "a" * 30_001, "漢字かな" * 4000, "the" * 9000 + "é"):
        assert MODEL.encode(pa.array([text]))[0].tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


def test_merges_are_leftmost_lowest():
    """The tree against plain merging, pair by pair."""
    rank = {}
    for s in np.flatnonzero(MODEL.keys >= 0).tolist():
        rank[int(MODEL.keys[s]) >> 32, int(MODEL.keys[s]) & 0xFFFFFFFF] = int(MODEL.ranks[s])
    rng = random.Random(2)
    for word in [bytes(rng.choice(b"theandingo") for _ in range(n)) for n in (1, 2, 3, 7, 8, 9, 40, 300)]:
        ids = [int(MODEL.first[b]) for b in word[:-1]] + [int(MODEL.last[word[-1]])]
        while True:
            found = [(rank[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
            if not found:
                break
            r, i = min(found)
            ids[i : i + 2] = [int(MODEL.made[r])]
        start = [int(MODEL.first[b]) for b in word[:-1]] + [int(MODEL.last[word[-1]])]
        assert MODEL.merged([word])[0].tolist() == MODEL.merge_alone(start) == ids


def test_bpe_on_odd_rows(odd, empty):
    kept = bpe.encode(odd, PATH, ("ids", "n_tokens"), keep_text=True)
    back = {(r.doc_id, r.text): r for r in bpe.decode(kept, PATH).collect()}
    assert len(back) == 10 and back[1, None].n_tokens == 0 and back[1, None].decoded == ""
    for (_, text), r in back.items():
        e = REFERENCE.encode(text or "", add_special_tokens=False).ids
        assert r.ids == e and r.decoded == REFERENCE.decode(e, skip_special_tokens=False)
    assert bpe.encode(empty, PATH).count() == 0


def enumerated(units, k, length):
    s = bytes(units.flat[units.start[k] : units.start[k] + units.length[k]])
    out = Counter()
    for at in itertools.combinations(range(len(s)), length):
        out[bytes(s[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
    return out


def kernel(a, b):
    """The kernel of two units, each a list of subsequences by length."""
    dot = lambda x, y: sum(v * y[u] for u, v in x.items())
    return sum(dot(x, y) / np.sqrt(dot(x, x) * dot(y, y)) for x, y in zip(a, b, strict=True))


def test_kernel_against_enumeration():
    units = toxicity.Units(pa.array(["idiot idxiot stüpid banana"]))
    pick = np.arange(4)
    f = [[enumerated(units, k, x) for x in toxicity.LENGTHS] for k in pick]
    got = toxicity.Table(units, pick).products(units, pick)
    assert np.allclose(got, [[kernel(a, b) for b in f] for a in f], atol=1e-5)


def test_one_table_is_the_decision_function():
    """The table of weights by which texts are scored against the sum over landmarks."""
    units = toxicity.Units(pa.array(["idiot moron stupid kato mire banana"]))
    marks, weights = np.arange(4), np.array([0.7, -0.2, 1.1, -0.9])
    table = toxicity.Table(units, marks).combined(weights)
    f = [[enumerated(units, k, x) for x in toxicity.LENGTHS] for k in range(6)]
    want = [sum(w * kernel(f[k], f[m]) for w, m in zip(weights, marks, strict=True)) for k in range(6)]
    assert np.allclose(table.products(units, np.arange(6))[:, 0], want, atol=1e-5)


def test_units():
    """Chunks between marks, runs of single letters across chunks without letters, and windows of long ones."""
    units = toxicity.Units(pa.array(["i - d - i - o - t ok", "Ídi0t!", "x" * 60]))
    names = [bytes(units.flat[s : s + n]) for s, n in zip(units.start, units.length, strict=True)]
    spell = lambda w: bytes([toxicity.START, *[ord(c) - 96 if c != "^" else toxicity.ACCENT for c in w], toxicity.END])
    assert spell("idiot") in names and spell("i^diot") in names
    covered = {(i, i + 14) for s, n in zip(units.start, units.length, strict=True) if n == toxicity.WIDTH for i in range(s, s + n - 13)}
    x = min(s for s, n in zip(units.start, units.length, strict=True) if n == toxicity.WIDTH)
    assert covered >= {(i, i + 14) for i in range(x, x + 62 - 13)}


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng = random.Random(3)
    bad = ["idiot", "stupid", "moron", "scum"]
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        t = prose("aa", rng.randint(20, 60)).split()
        if toxic:
            t.insert(rng.randrange(len(t)), rng.choice(bad))
        poor = i % 4 == 0
        rows.append((i, " ".join(t) if not poor else " ".join(x.upper() + "!!" for x in t), int(toxic), int(not poor)))
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, x) for i, _, x, q in rows], "doc_id long, quality int, toxic int")


def split(labels):
    return labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)


def test_toxicity(labelled, odd, empty):
    docs, labels = labelled
    model = toxicity.fit(docs, split(labels))
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 3 == 0) for i in held) >= 0.97 * len(held)
    s = model.score(pa.array(["kato i.d.i.o.t mire", "kato idxiot", "such a mo-ron", "kato i - d - i - o - t", "i d i o t", "idiiot kato", "stxupid", "kato ídiot", "kato mire", "", None]))
    assert (s[:8] >= 0.7).all() and s[8] < 0.3 and s[9] == s[10] < 0.3
    assert toxicity.predict(odd, model).count() == 11 and toxicity.predict(empty, model).count() == 0
    assert model.score(pa.array([], pa.string())).tolist() == []
    untrained = toxicity.fit(docs, labels.limit(0))
    assert {r.score for r in toxicity.predict(docs.limit(3), untrained).collect()} == {0.0}


def test_scores_depend_on_text_alone(labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, split(labels))
    moved = docs.withColumn("doc_id", F.col("doc_id") + 10_000).repartition(7)
    a = {r.doc_id: r.score for r in toxicity.predict(docs, model).collect()}
    assert all(abs(a[r.doc_id - 10_000] - r.score) < 1e-12 for r in toxicity.predict(moved, model).collect())


def test_quality(labelled, odd, empty):
    docs, labels = labelled
    model = quality.fit(docs, split(labels))
    got = {r.doc_id: r for r in toxicity.predict(docs, model).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i].predicted == (i % 4 != 0) for i in held) >= 0.97 * len(held)
    assert toxicity.predict(odd, model).count() == 11 and toxicity.predict(empty, model).count() == 0
    assert set(quality.fit(docs, labels.limit(0)).score(pa.array(["x"])).tolist()) == {0.0}


def test_quality_projection_is_the_network():
    texts = ["kato mire kato kato", "SCHU!! BER!!", "", "x"]
    m = quality.Model().fit(texts * 20, np.array([1, 0, 1, 0] * 20), epochs=2)
    for t in texts:
        distinct, codes, offsets = quality.words(pa.array([t]))
        owner, row, weight, whole = quality.word_features(distinct.to_pylist())
        pairs = quality.pair_rows(whole, codes, offsets)
        mean = np.zeros(quality.DIM)
        for i, c in enumerate(codes):
            own = owner == c
            mean += (m.vectors[row[own]].sum(axis=0) + m.vectors[pairs[i]]) / (own.sum() + 1) / len(codes)
        logit = mean @ m.softmax + m.constant
        p = np.exp(logit) / np.exp(logit).sum()
        assert abs(p[1] - m.score(pa.array([t]))[0]) < 1e-5


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), F.when(F.col("id") < 4000, "a").when(F.col("id") < 4010, "b").alias("s"))
    got = bounded_sample(df, "k", "s", 100)
    assert {r["s"]: r["n"] for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()} == {"a": 100, "b": 10, None: 100}
    again = bounded_sample(df.repartition(9), "k", "s", 100)
    assert {r.k for r in got.collect()} == {r.k for r in again.collect()}
