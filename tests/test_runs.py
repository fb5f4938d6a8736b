import json
import math
from collections import Counter

import pytest
import yaml

from lexmill.__main__ import arguments, config_of, done, job_of
from lexmill.operators import variants
from lexmill.plans import runs
from lexmill.sources import modelfile

TEXTS = {"x": ["the cat sat on the mat", "the cat ran", "the dog sat on the mat 12 the cat"], "y": ["the cat sat", "a dog on the mat", "the cat sat on the dog", "extra"]}
MODEL = {"count_min": 1, "min_count": 2, "min_source_count": 2, "min_frequency": 0.0}


@pytest.fixture
def job_file(tmp_path):
    for name, lines in TEXTS.items():
        (tmp_path / f"{name}.txt").write_text("\n".join(lines))
    (tmp_path / "o.yaml").write_text("overrides:\n  dog: [dawg, dog]\n")
    (tmp_path / "gone.txt").write_text("ran\n")
    given = {"out": str(tmp_path / "out"), "corpora": {n: ["lines", f"{tmp_path}/{n}.txt"] for n in TEXTS}, "overrides": f"{tmp_path}/o.yaml", "exclusions": f"{tmp_path}/gone.txt", "config": {"script": "latin", "model": MODEL, "wordlist": {"min_frequency": 0.0}}}
    (tmp_path / "job.yaml").write_text(yaml.safe_dump(given))
    return str(tmp_path / "job.yaml")


def told(spark, job_file, *argv):
    a = arguments(["--job", job_file, *argv])
    return done(spark, job_of(a.job), a)


def expected_scores():
    """Scores of pairs by hand: counted in windows that hold listed words only, from shares of each corpus."""
    shares, raw = {}, Counter()
    for n in (1, 2):
        for lines in TEXTS.values():
            own = Counter()
            for line in lines:
                t = [w if w.isalpha() and len(w) > 1 else None for w in line.split()]
                own.update(g for g in zip(*[t[i:] for i in range(n)]) if None not in g)
            raw.update(own)
            for g, c in own.items():
                shares[g] = shares.get(g, 0.0) + c / sum(own.values()) / len(TEXTS)
    both = {w for w in {g[0] for g in raw} if all(any(w in line.split() for line in lines) for lines in TEXTS.values())}
    return {g: math.log10(f / shares[g[:1]]) for g, f in shares.items() if len(g) == 2 and raw[g] >= 2 and set(g) <= both}


def test_run_from_corpora_to_dataset_and_model(spark, job_file, tmp_path):
    out, well = told(spark, job_file, "run", "--version", "v1.0.0")
    assert well and out["model"]["wrong"] == []
    words = {e["word"]: e for e in json.loads((tmp_path / "out" / "dataset.json").read_text())["entries"]}
    assert set(words) == {"the", "cat", "sat", "on", "mat", "dog"} and words["dog"]["romanizations"] == ["dawg", "dog"]
    assert words["the"]["word_id"] == 0 and out["dataset"]["entries"] == out["model"]["vocab_size"] == out["model"]["valid_in_vocabulary"] == 6
    _, uni, bi, _ = modelfile.read(spark, out["model"]["path"])
    by_id = {r.word_id: r.word for r in uni.collect()}
    got = {(by_id[r.w1], by_id[r.w2]): r.score for r in bi.collect()}
    want = expected_scores()
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-6)
    assert out["model"]["top_1"][0]["word"] == "the"


def test_stages_are_kept_until_forgotten(spark, job_file, tmp_path):
    assert told(spark, job_file, "words")[0] == {"rows": 8}
    (tmp_path / "y.txt").write_text("the cat sat more")
    assert told(spark, job_file, "words")[0] == {"rows": 8}
    (tmp_path / "out" / "words-of-mine").mkdir()
    runs.forget(spark, job_of(job_file))
    assert {r.word for r in runs.words(spark, job_of(job_file)).collect()} == {"the", "cat", "sat", "on", "mat", "ran", "dog", "more"}
    assert (tmp_path / "out" / "words-of-mine").exists()


def test_sizes_and_status(spark, job_file):
    rows = {r["corpus"]: r for r in told(spark, job_file, "sizes")[0]}
    assert (rows["x"]["texts"], rows["x"]["texts_with_tokens"], rows["x"]["tokens"], rows["x"]["valid_tokens"]) == (3, 3, 18, 17)
    assert all(r["available"] for r in told(spark, job_file, "status")[0])


def test_reports_and_search(spark, job_file, tmp_path):
    told(spark, job_file, "run")
    (tmp_path / "b.csv").write_text("latin_input,expected,category,difficulty,notes\ndawg,dog,,,\nkat,cat,,,\nzebra,zebra,,,\n")
    report, _ = told(spark, job_file, "check-dataset", f"{tmp_path}/b.csv")
    assert report["recall"][0]["hits"] == 1 and report["recall"][0]["word_missing"] == 1 and report["most_missed"] == [{"expected": "cat", "n": 1}]
    assert report["collisions"][0] == {"n_keys": 7, "n_collided": 0, "rate": 0.0}
    (tmp_path / "r.csv").write_text("latin_input,context,expected_top,valid_alternatives,type,notes\nx,the,cat,,pair,\nx,cat,the,,pair,\nx,,dog,,word,\n")
    covered, _ = told(spark, job_file, "check-model", f"{tmp_path}/r.csv")
    assert {r["type"]: (r["hits"], r["total"]) for r in covered["coverage"]} == {"pair": (1, 2), "word": (1, 1), "TOTAL": (2, 3)}
    assert covered["top_2"][0]["w1"] == "the" and covered["top_2"][0]["w2"] == "cat"
    (tmp_path / "c.yaml").write_text("- {input: thecatsat, expected: thecatsat}\n- {input: thecat, expected: nothing}\n")
    found, well = told(spark, job_file, "search", f"{tmp_path}/c.yaml")
    assert [r["status"] for r in found] == ["pass", "fail"] and not well


def test_review_log_grows_and_names_what_failed(spark, job_file, tmp_path):
    job = job_of(job_file)

    def ask(words):
        if "the" in words:
            raise TimeoutError("late")
        return "```\n" + "\n".join([*words[:1], "unheard"]) + "\n```"

    job = runs.Job(**{**vars(job), "config": config_of({"review": {"batch": 3, "limit": 6}})})
    first = runs.reviewed(spark, job, ask, "one")
    assert first == {"batches": 2, "failed": [0], "words": 1}
    runs.reviewed(spark, job, ask, "two")
    log = spark.read.json(f"{job.out}/review-log")
    assert [(r.run, r.batch, r.error) for r in log.orderBy("run", "batch").collect()] == [(run, n, e) for run in ("one", "two") for n, e in ((0, "TimeoutError: late"), (1, None))]


def test_file_that_differs_is_told(spark, tmp_path):
    vocab = spark.createDataFrame([(0, "a"), (1, "b")], "word_id int, word string")
    uni = spark.createDataFrame([("a", -0.5)], "word string, score double")
    bi = spark.createDataFrame([("b", "a", -0.1), ("a", "b", 0.2)], "w1 string, w2 string, score double")
    tri = spark.createDataFrame([("a", "b", "a", -0.3)], "w1 string, w2 string, w3 string, score double")
    path = str(tmp_path / "m.bin")
    modelfile.write(path, vocab, uni, bi, tri, 2)
    assert modelfile.differences(path, vocab, uni, bi, tri) == []
    assert len(modelfile.differences(path, vocab, uni, bi.limit(1), tri.limit(0))) == 2
    assert modelfile.differences(path, vocab.limit(1), uni, bi, tri) == ["the string table differs"]
    none = uni.limit(0)
    modelfile.write(path, vocab, none, bi.limit(0), tri.limit(0), 2)
    assert modelfile.differences(path, vocab, none, bi.limit(0), tri.limit(0)) == []


def test_product_size():
    known = {"onset": {"k": ["k", "g"]}, "vowel": {"a": ["a", "u", "ah"]}, "coda": {"n": ["n"]}}
    s = variants.Syllable("k", "a", "n", "0", "")
    assert variants.product_size([s, s], known) == 36 and variants.product_size([], known) == 1


def test_unknown_parameters_are_errors():
    with pytest.raises(TypeError):
        config_of({"model": {"no_such": 1}})
    assert config_of({}).model.alpha == 0.4
