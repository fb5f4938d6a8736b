"""Whole runs: from corpora to a word list, its spellings, a dataset and a model file, and the reports on them.

A job names its inputs and its folder. Each step is a stage that is kept under a fingerprint of all it depends on, so a step whose
parameters or predecessors have changed is made anew, and others are read. Inputs are known by their paths: forget() the stages where
their contents have changed.
"""

from __future__ import annotations

import contextlib
import re
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..config import Config, SearchConfig
from ..operators import evaluation, frequency, lattice, model, ngrams, review, variants, wordlist
from ..sources import modelfile, readers, sinks
from ..store import cut
from . import stages

#: Words and n-grams that a report names.
SAMPLE = 5
STAGES = ("words", "spellings", "entries", "grams")
STAGE_NAME = re.compile(rf"({'|'.join(STAGES)})-[0-9a-f]{{12}}")


@dataclass(frozen=True)
class Job:
    """out: a folder that all executors share and that the driver has mounted, as the dataset and the model are single files. corpora: name ->
    (kind of reader, path). Paths left out are empty tables; without a lexicon each word is its own spelling."""

    out: str
    corpora: dict[str, tuple[str, str]] = field(default_factory=dict)
    dictionary: str = ""
    lexicon: str = ""
    components: str = ""
    overrides: str = ""
    exclusions: str = ""
    config: Config = field(default_factory=Config)

    @property
    def names(self) -> list[str]:
        return sorted(self.corpora)

    def of_words(self) -> tuple:
        return sorted(self.corpora.items()), self.dictionary, self.config.script, self.config.wordlist.compound_min_chars, self.config.wordlist.part_min_chars

    def of_spellings(self) -> tuple:
        return self.of_words(), self.lexicon, self.components, self.config.wordlist.max_variants


def forget(spark: SparkSession, job: Job) -> None:
    """Deletes a job's stages, so that all are made anew."""
    for name in STAGES:
        pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{job.out}/{name}-*")
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in fs.globStatus(pattern) or []:
            # only names that stages.stage() gives: other files of the folder stay
            if STAGE_NAME.fullmatch(found.getPath().getName()):
                fs.delete(found.getPath(), True)


def texts(spark: SparkSession, job: Job) -> DataFrame:
    """(corpus, text) of all corpora."""
    every = spark.createDataFrame([], "corpus string, text string")
    for name in job.names:
        kind, path = job.corpora[name]
        every = every.unionByName(readers.texts(spark, kind, path).withColumn("corpus", F.lit(name)))
    return every


def sizes(spark: SparkSession, job: Job) -> DataFrame:
    """(corpus, texts, texts_with_tokens, tokens, valid_tokens)."""
    t = stages.tokens_of(texts(spark, job), job.config)
    valid = F.size(F.array_compact("tokens"))
    return t.groupBy("corpus").agg(F.count("*").alias("texts"), F.count_if(valid > 0).alias("texts_with_tokens"), F.sum(F.size("tokens")).cast("long").alias("tokens"), F.sum(valid).cast("long").alias("valid_tokens"))


def words(spark: SparkSession, job: Job) -> DataFrame:
    """(word, freq, sources)."""
    known = readers.words(spark, job.dictionary) if job.dictionary else None
    return stages.stage(spark, job.out, "words", job.of_words(), lambda: stages.words_of(texts(spark, job), job.names, job.config, known))


def spellings(spark: SparkSession, job: Job) -> DataFrame:
    """(word, romanizations) of the word list; words that the lexicon lacks have none."""

    def build() -> DataFrame:
        own = words(spark, job)
        if not job.lexicon:
            return own.select("word", F.array("word").alias("romanizations"))
        known = variants.components(readers.components(spark, job.components))
        lexicon = readers.table(spark, job.lexicon, schemas.LEXICON).join(own.select("word"), "word", "left_semi")
        return variants.generated(lexicon, known, job.config.wordlist.max_variants, job.config.script.repeater or "ๆ")

    return stages.stage(spark, job.out, "spellings", job.of_spellings(), build)


def entries(spark: SparkSession, job: Job) -> DataFrame:
    """(word_id, word, frequency, sources, romanizations) of the curated list."""

    def build() -> DataFrame:
        over = readers.overrides(spark, job.overrides) if job.overrides else spark.createDataFrame([], schemas.VARIANTS)
        gone = readers.words(spark, job.exclusions) if job.exclusions else spark.createDataFrame([], "word string")
        return stages.dataset(words(spark, job), spellings(spark, job), over, gone, job.config)

    return stages.stage(spark, job.out, "entries", (job.of_spellings(), job.overrides, job.exclusions, job.config.wordlist), build)


def export(spark: SparkSession, job: Job, version: str = "v0.0.0") -> dict:
    """Writes the dataset as JSON and CSV, and the ranked word list, and gives their statistics."""
    own = entries(spark, job)
    path = f"{job.out}/dataset.json"
    n = sinks.dataset(own, wordlist.metadata(own, version, job.names), path)
    sinks.flat(wordlist.flat_keys(own), f"{job.out}/dataset.csv", single=True)
    sinks.wordlist(frequency.wordlist(words(spark, job)), f"{job.out}/wordlist.csv", single=True)
    stats = wordlist.variant_stats(own).first().asDict()
    return {"dataset": path, "entries": n, **stats, "sources": [r.asDict() for r in wordlist.source_coverage(own).orderBy("source").collect()]}


def grams(spark: SparkSession, job: Job) -> DataFrame:
    """(n, w1, w2, w3, cnt, freq, n_sources) of n-grams whose words are all in the word list."""

    def build() -> DataFrame:
        wide = cut(ngrams.wide_counts(stages.tokens_of(texts(spark, job), job.config), job.names), "wide")
        listed = words(spark, job).select("word")
        inside = None
        for n in (1, 2, 3):
            part = ngrams.within(wide, listed, n)
            inside = part if inside is None else inside.unionByName(part)
        return ngrams.measured(cut(inside, "inside"), job.names, job.config.model.count_min)

    return stages.stage(spark, job.out, "grams", (job.of_words(), job.config.model.count_min), build)


def scores(spark: SparkSession, job: Job) -> stages.Scores:
    """Score tables of the dataset's vocabulary, stored."""
    g, m = grams(spark, job), job.config.model
    own = g.filter("n = 1 and n_sources > 0").select(F.col("w1").alias("word"), "n_sources")
    vocabulary = entries(spark, job).select("word")
    valid = cut(ngrams.valid_tokens(vocabulary, own, g.select("n", "w1", "freq"), m.min_source_count, m.min_frequency), "valid")
    two, three = (ngrams.surviving(g, valid, n, m.min_count) for n in (2, 3))
    return stages.Scores(valid, *[cut(x, "scores") for x in (model.unigram_scores(valid), model.bigram_scores(two, g), model.trigram_scores(three, g))])


def compressed_size(path: str) -> int | None:
    """Bytes of a file after brotli at quality 9; None where that library is missing."""
    with contextlib.suppress(ImportError):
        import brotli

        return len(brotli.compress(Path(path).read_bytes(), quality=9))
    return None


def highest(table: DataFrame, by: str, cols: list[str], n: int) -> list[dict]:
    return [r.asDict() for r in table.orderBy(F.desc(by), *cols).limit(n).select(*cols, by).collect()]


def encode(spark: SparkSession, job: Job, commit: int = 0, days: int | None = None) -> dict:
    """Writes the model file of the dataset's vocabulary, reads it again and compares. `wrong` lists what differs; `path` is null if anything does."""
    m = job.config.model
    s, own = scores(spark, job), entries(spark, job).select("word_id", "word")
    path = f"{job.out}/model_v{modelfile.LAYOUT}_mc{m.min_count}.bin"
    today = int(time.time() // 86_400) if days is None else days
    header = modelfile.write(path, own, s.uni, s.bi, s.tri, m.min_count, m.alpha, modelfile.build_info(today, commit))
    wrong = modelfile.differences(path, own, s.uni, s.bi, s.tri)
    in_vocabulary = s.valid.join(own, "word", "left_semi").count()
    top = {f"top_{n}": highest(t, "score", c, SAMPLE) for n, t, c in ((1, s.uni, ["word"]), (2, s.bi, ["w1", "w2"]), (3, s.tri, ["w1", "w2", "w3"]))}
    return {"path": None if wrong else path, "wrong": wrong, **asdict(header), "valid_in_vocabulary": in_vocabulary, "bytes": Path(path).stat().st_size, "compressed_bytes": compressed_size(path), **top}


def dataset_report(own: DataFrame, benchmark: DataFrame) -> dict[str, DataFrame]:
    """Tables on a dataset: recall of a benchmark (latin_input, expected), pairs missed, words with most keys missed, coverage by source and by
    number of sources, with rates, and keys by how many words share them."""
    rows = evaluation.recall_rows(benchmark, own)
    lost = evaluation.missed(rows)
    rates = lambda df: df.withColumn("rate", F.try_divide(F.col("success").cast("double"), "total")).withColumn("avg_variants", F.coalesce(F.try_divide(F.col("variant_sum").cast("double"), "success"), F.lit(0.0)))
    shared = wordlist.collision_histogram(own)
    collided = F.sum(F.when(F.col("n_words") > 1, F.col("n_keys")).otherwise(0)).cast("long")
    return {
        "recall": evaluation.recall_summary(rows),
        "missed": lost,
        "most_missed": lost.filter("reason = 'key_missing'").groupBy("expected").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "expected").limit(20),
        "sources": rates(wordlist.source_coverage(own)),
        "source_counts": rates(wordlist.coverage_by_source_count(own)),
        "collisions": shared.agg(F.coalesce(F.sum("n_keys").cast("long"), F.lit(0)).alias("n_keys"), F.coalesce(collided, F.lit(0)).alias("n_collided")).withColumn("rate", F.coalesce(F.try_divide(F.col("n_collided").cast("double"), "n_keys"), F.lit(0.0))),
        "collision_sizes": shared,
    }


def model_report(g: DataFrame, ranking: DataFrame) -> dict[str, DataFrame]:
    """Tables on n-grams: coverage of a ranking benchmark by type, and the most frequent pairs and triples."""
    two = g.filter("n = 2")
    covered = evaluation.ranking_coverage(ranking, g.filter("n = 1").select(F.col("w1").alias("word")), two)
    top = lambda df, cols, n: df.orderBy(F.desc("freq"), *cols).limit(n).select(*cols, "freq")
    return {"coverage": covered.withColumn("rate", F.col("hits") / F.col("total")), "top_2": top(two, ["w1", "w2"], 20), "top_3": top(g.filter("n = 3"), ["w1", "w2", "w3"], 10)}


def store_report(tables: dict[str, DataFrame], folder: str) -> dict[str, list[dict]]:
    """Writes each table as CSV and gives back those that are bounded; pairs missed are only written."""
    for name, df in tables.items():
        sinks.report(df, f"{folder}/{name}.csv")
    return {name: [r.asDict() for r in df.collect()] for name, df in tables.items() if name != "missed"}


def searched(spark: SparkSession, cases: DataFrame, own: DataFrame, path: str | None = None, search: SearchConfig | None = None) -> DataFrame:
    """cases with rank and status, by a dataset's keys and, if given, the scores of a model file."""
    found = lattice.edges(cases.select("query_id", "input"), wordlist.flat_keys(own))
    tables: tuple = ()
    if path is not None:
        _, uni, bi, tri = modelfile.read(spark, path)
        named = lambda df, *cols: _named(df, uni, cols)
        tables = (uni.select("word", "score"), named(bi, "w1", "w2"), named(tri, "w1", "w2", "w3"))
    return lattice.judged(cases, lattice.search(cut(found, "lattice"), search or SearchConfig(), *tables))


def _named(df: DataFrame, uni: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    for c in cols:  # at most 65,535 words
        df = df.join(F.broadcast(uni.select(F.col("word_id").alias(c), F.col("word").alias(f"_{c}"))), c)
    return df.select(*[F.col(f"_{c}").alias(c) for c in cols], "score")


def reviewed(spark: SparkSession, job: Job, ask: Callable[[list[str]], str], run: str) -> dict:
    """Asks a callable about the most frequent words, batch by batch; appends the answers to the log, and writes the words named, sorted."""
    r = job.config.review
    answers = cut(review.parsed(review.answered(review.batches(words(spark, job), r.batch, r.limit), ask)), "answers")
    failed = review.logged(answers, f"{job.out}/review-log", run)
    named = cut(review.candidates(answers), "named")
    named.select(F.col("word").alias("value")).coalesce(1).sortWithinPartitions("value").write.mode("overwrite").text(f"{job.out}/review-raw")
    return {"batches": answers.count(), "failed": [x["batch"] for x in failed.orderBy("batch").collect()], "words": named.count()}
