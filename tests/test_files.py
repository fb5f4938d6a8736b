import bz2
import json

import pytest

from lexmill.config import LATIN, Config
from lexmill.operators import wordlist
from lexmill.plans import stages
from lexmill.sources import modelfile, readers, sinks


def test_corpora(spark, tmp_path):
    (tmp_path / "a.txt").write_text("  one \n\n two\n")
    assert sorted(r.text for r in readers.lines(spark, [f"{tmp_path}/a.txt", f"{tmp_path}/missing.txt"]).collect()) == ["one", "two"]
    (tmp_path / "b.csv").write_text('review;rating\n"x; y\nz";1\n ;2\n')
    assert [r.text for r in readers.delimited(spark, f"{tmp_path}/b.csv").collect()] == ["x; y\nz"]
    (tmp_path / "c.jsonl").write_text('{"title": "T", "body_text": "B"}\nbroken\n{"title": "", "body_text": "C"}\n')
    assert sorted(r.text for r in readers.titled(spark, f"{tmp_path}/c.jsonl").collect()) == ["B", "C", "T"]
    xml = '<mediawiki xmlns="http://www.mediawiki.org/xml/export-0.10/"><page><title>P</title><revision><text>\'\'\'A\'\'\' [[B|C]]</text></revision></page></mediawiki>'
    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(xml.encode()))
    assert [r.text for r in readers.texts(spark, "wiki", f"{tmp_path}/d.xml.bz2").collect()] == ["A C"]
    with pytest.raises(KeyError):
        readers.texts(spark, "unknown", "x")
    with pytest.raises(ValueError):
        readers.texts(spark, "dictionary", "x")
    assert {r.corpus: r.available for r in readers.status(spark, {"lines": f"{tmp_path}/a.txt", "wiki": f"{tmp_path}/no"}).collect()} == {"lines": True, "wiki": False}


def test_small_tables(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("overrides:\n  w: [a, b]\n  e: []\n")
    assert [tuple(r) for r in readers.overrides(spark, f"{tmp_path}/o.yaml").collect()] == [("w", ["a", "b"])]
    assert readers.overrides(spark, f"{tmp_path}/none.yaml").count() == 0
    (tmp_path / "x.txt").write_text("# c\n w \n\nv\n")
    assert [r.word for r in readers.words(spark, f"{tmp_path}/x.txt").collect()] == ["w", "v"]
    (tmp_path / "g.tsv").write_text("a\tb\t1\nshort\na\tb\t3\n")
    assert [tuple(r) for r in readers.grams(spark, f"{tmp_path}/g.tsv").collect()] == [(["a", "b"], 3.0)]
    assert readers.grams(spark, f"{tmp_path}/none.tsv").count() == 0
    for v in ("v0.9.0", "v0.10.0"):
        (tmp_path / f"f-{v}.csv").write_text("latin_input,context,expected_top,valid_alternatives,type,notes\n# c,,,,,\nx,,y,,t,\n")
    assert readers.latest(str(tmp_path), "f-*.csv").name == "f-v0.10.0.csv"
    with pytest.raises(FileNotFoundError):
        readers.latest(str(tmp_path), "q-*")
    from lexmill import schemas

    assert readers.table(spark, f"{tmp_path}/f-v0.9.0.csv", schemas.RANKING, comments=True).count() == 1


def test_dataset_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(0, "w", 0.5, ["a", "b"], ["x"]), (1, "v", 0.25, [], [])], "word_id long, word string, frequency double, sources array<string>, romanizations array<string>")
    path = str(tmp_path / "d.json")
    assert sinks.dataset(e, wordlist.metadata(e, "v1.0.0", ["a", "b"]), path) == 2
    assert json.loads((tmp_path / "d.json").read_text())["metadata"]["total_romanization_keys"] == 1
    assert sorted(map(tuple, readers.dataset(spark, path).collect())) == sorted(map(tuple, e.collect()))
    sinks.flat(wordlist.flat_keys(e), str(tmp_path / "flat"), single=True)
    assert next((tmp_path / "flat").glob("part*")).read_text().splitlines()[1] == "0,w,x,0.500000000000,a|b"


def test_model_file(spark, tmp_path):
    words = ["a", "b", "ค"]
    vocab = spark.createDataFrame(list(enumerate(words)), "word_id int, word string")
    uni = spark.createDataFrame([("a", -0.5), ("b", -1.5)], "word string, score double")
    bi = spark.createDataFrame([("b", "a", -0.1), ("a", "b", 0.2), ("a", "zz", 0.1)], "w1 string, w2 string, score double")
    tri = spark.createDataFrame([("a", "b", "ค", -0.3)], "w1 string, w2 string, w3 string, score double")
    path = str(tmp_path / "m.bin")
    header = modelfile.write(path, vocab, uni, bi, tri, 15, build=modelfile.build_info(19_000, 0xBEEF))
    assert (header.n_bigrams, header.n_trigrams) == (2, 1)
    got, u, two, three = modelfile.read(spark, path)
    assert got.vocab_size == 3 and got.min_count == 15 and got.build_info == 19_000 << 16 | 0xBEEF
    assert [(r.word, r.score) for r in u.orderBy("word_id").collect()] == [("a", -0.5), ("b", -1.5), ("ค", -1.5)]
    assert [(r.w1, r.w2) for r in two.collect()] == [(0, 1), (1, 0)]
    assert modelfile.verify(path, words, {0: -0.5, 1: -1.5}, {(0, 1): 0.2, (1, 0): -0.1}, {(0, 1, 2): -0.3}) == []
    assert modelfile.verify(path, words, {0: -0.6}, {}, {})
    (tmp_path / "bad").write_bytes(b"XXXX" + bytes(40))
    with pytest.raises(ValueError):
        modelfile.parse(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        modelfile.write(path, vocab, uni, bi, tri, 300)


def test_stage_is_kept_by_configuration(spark, tmp_path):
    made = []
    build = lambda: (made.append(1), spark.range(3).toDF("x"))[1]
    for config in (Config(), Config(), Config(script=LATIN), {"other": 1}):
        assert stages.stage(spark, str(tmp_path), "s", config, build).count() == 3
    assert len(made) == 2


def test_release(tmp_path):
    (tmp_path / "a").write_text("x")
    m = sinks.manifest("v1.0.0", [str(tmp_path / "a")], str(tmp_path / "m.json"))
    assert m["files"][0]["size"] == 1 and len(m["files"][0]["sha256"]) == 64
    assert sinks.compressed(str(tmp_path / "a")).endswith("a.gz")


def test_words_and_dataset(spark):
    texts = spark.createDataFrame([("x", "the cat sat"), ("y", "the dog")], "corpus string, text string")
    w = stages.words_of(texts, ["x", "y"], Config(), spark.createDataFrame([("zebra",)], "word string"))
    assert {r.word for r in w.collect()} == {"the", "cat", "sat", "dog", "zebra"}
    v = w.selectExpr("word", "array(word) as romanizations")
    none = spark.createDataFrame([], "word string, romanizations array<string>")
    assert [r.word for r in stages.dataset(w, v, none, spark.createDataFrame([("zebra",)], "word string"), Config()).collect()] == ["the"]


def test_streams(spark, tmp_path):
    from lexmill.streaming.counts import gram_counts, word_counts

    spark.createDataFrame([("x", "the cat the")], "corpus string, text string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("corpus string, text string").parquet(str(tmp_path / "in"))
    for name, df in (("w", word_counts(stream, LATIN)), ("g", gram_counts(stream, LATIN, (2,)))):
        df.writeStream.outputMode("complete").format("memory").queryName(f"t_{name}").trigger(availableNow=True).start().awaitTermination()
    assert {(r.word, r.cnt) for r in spark.table("t_w").collect()} == {("the", 2), ("cat", 1)}
    assert spark.table("t_g").count() == 2
