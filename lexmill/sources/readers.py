"""Corpora and tables from files, each with a declared schema. Corpus readers give (corpus, text) rows, one per text."""

from __future__ import annotations

import re
from collections.abc import Callable
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.text import clean_wikitext, strip_space

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
DICTIONARY_ONLY: set[str] = set()


def register(name: str, reader: Callable[[SparkSession, str], DataFrame] | None = None, dictionary_only: bool = False) -> None:
    """Makes a corpus known by name; a dictionary gives words and no texts."""
    if dictionary_only:
        DICTIONARY_ONLY.add(name)
    if reader:
        READERS[name] = reader


def texts(spark: SparkSession, name: str, path: str) -> DataFrame:
    if name in DICTIONARY_ONLY:
        raise ValueError(f"{name} is a dictionary and has no texts")
    if name not in READERS:
        raise KeyError(name)
    return READERS[name](spark, path).select(F.lit(name).alias("corpus"), "text")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether any file is at a path, in whatever file system Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def status(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(corpus, path, available, dictionary_only)."""
    rows = [(n, p, n in DICTIONARY_ONLY or exists(spark, p), n in DICTIONARY_ONLY) for n, p in sorted(paths.items())]
    return spark.createDataFrame(rows, "corpus string, path string, available boolean, dictionary_only boolean")


def lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Texts of files with one text a line; missing files and blank lines are skipped."""
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "text string")
    return spark.read.text(there).select(strip_space(F.col("value")).alias("text")).filter("text <> ''")


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """Texts in the first column of `;`-separated files with a header; quoted texts may hold line breaks."""
    df = spark.read.csv(path, sep=";", header=True, multiLine=True, quote='"', escape='"', schema="text string, rating string", enforceSchema=True)
    return df.select("text").filter(strip_space(F.col("text")) != "")


def titled(spark: SparkSession, path: str) -> DataFrame:
    """Titles and bodies of JSON lines, as texts of their own; malformed lines are dropped."""
    df = spark.read.schema("title string, body_text string").json(path, mode="DROPMALFORMED")
    return df.select(F.explode(F.array("title", "body_text")).alias("text")).filter("text <> ''")


def wiki(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned texts of a MediaWiki dump, plain or .bz2: every text of every revision of every page."""
    df = spark.read.format("xml").option("rowTag", "page").schema("title string, revision array<struct<text: array<string>>>").load(path)
    every = df.select(F.explode(F.flatten(F.transform("revision", lambda r: r["text"]))).alias("text"))
    return every.select(strip_space(clean_wikitext(F.col("text"))).alias("text")).filter("text <> ''")


def words(spark: SparkSession, path: str) -> DataFrame:
    """Words of a list: trimmed lines that are neither blank nor comments."""
    return spark.read.text(path).select(F.trim("value").alias("word")).filter("word <> '' and word not like '#%'")


for _name, _reader in {"lines": lambda s, p: lines(s, [p]), "delimited": delimited, "titled": titled, "wiki": wiki}.items():
    register(_name, _reader)
register("dictionary", dictionary_only=True)


def wordlist(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.csv(path, header=True, schema=schemas.WORDLIST)
    return df.withColumn("sources", F.when(F.coalesce("sources", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("sources", r"\|")))


def first_words(spark: SparkSession, path: str, limit: int) -> DataFrame:
    return wordlist(spark, path).orderBy("rank").limit(limit).select("rank", "word")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an exported dataset."""
    return spark.read.schema(schemas.DATASET).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")


def variants(spark: SparkSession, path: str) -> DataFrame:
    """(word, romanizations) of a JSON object."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("word", "romanizations"))


def grams(spark: SparkSession, path: str) -> DataFrame:
    """(gram, value) of tab-separated lines: all fields but the last, and the last; short lines are dropped, a missing file is empty, and of equal
    n-grams the last counts."""
    if not exists(spark, path):
        return spark.createDataFrame([], "gram array<string>, value double")
    f = F.split("value", "\t")
    df = spark.read.text(path).withColumn("_i", F.monotonically_increasing_id()).filter(F.size(f) >= 2)
    pairs = df.select(F.slice(f, 1, F.size(f) - 1).alias("gram"), F.element_at(f, -1).cast("double").alias("value"), "_i")
    return pairs.groupBy("gram").agg(F.max_by("value", "_i").alias("value"))


def table(spark: SparkSession, path: str, schema: str, comments: bool = False) -> DataFrame:
    """A CSV file with a header and a declared schema; with comments, rows that begin with # are dropped."""
    return spark.read.csv(path, header=True, schema=schema, **({"comment": "#"} if comments else {}))


def overrides(spark: SparkSession, path: str) -> DataFrame:
    """(word, romanizations) of a YAML mapping; empty lists are dropped, a missing file is empty. Such files are written by hand."""
    found = yaml.safe_load(p.read_text("utf-8")) if (p := Path(path)).exists() else {}
    found = (found or {}).get("overrides", found) or {}
    rows = [(str(k), [str(x) for x in v]) for k, v in found.items() if isinstance(v, list) and v]
    return spark.createDataFrame(rows, schemas.VARIANTS)


def components(spark: SparkSession, path: str) -> DataFrame:
    """(kind, g2p, variants) of a component dictionary in YAML."""
    found = yaml.safe_load(Path(path).read_text("utf-8"))
    rows = [(kind, str(e["g2p"]), [str(v) for v in e["variants"]]) for kind, group in (("onset", "onsets"), ("vowel", "vowels"), ("coda", "codas")) for e in found[group].values()]
    return spark.createDataFrame(rows, schemas.COMPONENTS)


def cases(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, input, expected, note) of a YAML list."""
    rows = [(i, str(c["input"]), str(c["expected"]), str(c.get("note", ""))) for i, c in enumerate(yaml.safe_load(Path(path).read_text("utf-8")))]
    return spark.createDataFrame(rows, "query_id long, input string, expected string, note string")


def latest(folder: str, pattern: str) -> Path:
    """The file of the highest version vA.B.C in its name."""
    found = [(tuple(map(int, m.groups())), p) for p in Path(folder).glob(pattern) if (m := re.search(r"v(\d+)\.(\d+)\.(\d+)", p.name))]
    if not found:
        raise FileNotFoundError(f"{folder}/{pattern}")
    return max(found)[1]


def newest(folder: str, pattern: str) -> Path | None:
    """The file changed last."""
    return max(Path(folder).glob(pattern), key=lambda p: p.stat().st_mtime, default=None)
