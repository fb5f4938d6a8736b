"""Building, classifying and reviewing benchmarks; heuristics over entries; external filters in batches; release manifests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Script
from ..functions.text import base_length, has_cluster, longest, nuclei, shortest, vowel_clusters
from .frequency import ranked


def classified(words: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """words (word, romanization, variant_count, rank, syllable_count) with category and difficulty. ambiguous: a table of words."""
    w = words.join(F.broadcast(ambiguous.select("word", F.lit(True).alias("_a")).distinct()), "word", "left")
    doubtful, n, many, cluster = F.col("_a").isNotNull(), F.col("syllable_count"), F.col("variant_count"), has_cluster(F.col("romanization"))
    category = F.when(doubtful, "ambiguous").when(n >= 3, "compound").when(many > 10, "variant").when((F.length("word") <= 2) & (n == 1), "edge").otherwise("common")
    plain = F.when((n == 1) & ~cluster, "easy").when((n <= 2) & (many <= 5), "easy").when((n >= 3) | cluster, "medium").when(many > 8, "medium").otherwise("easy")
    return w.withColumn("category", category).withColumn("difficulty", F.when((n >= 4) | (doubtful & (n >= 2)), "hard").otherwise(plain)).drop("_a")


def decided(draft: DataFrame, decisions: DataFrame) -> DataFrame:
    """draft entries (word, category, difficulty, variants, review_status) after reviewers' decisions, which replace what they set."""
    d = decisions.select("word", *[F.col(c).alias(f"_{c}") for c in ("review_status", "category", "difficulty", "variants")])
    j = draft.join(d, "word", "left")
    for c in ("review_status", "category", "difficulty", "variants"):
        j = j.withColumn(c, F.coalesce(f"_{c}", c))
    return j.select(*draft.columns)


def exported(entries: DataFrame, include_discarded: bool = False) -> DataFrame:
    """A row for each variant of approved and edited entries (or of all), in order of category, difficulty and input."""
    kept = entries if include_discarded else entries.filter(F.col("review_status").isin("approved", "edited"))
    level = F.when(F.col("difficulty") == "easy", 0).when(F.col("difficulty") == "medium", 1).when(F.col("difficulty") == "hard", 2).otherwise(3)
    rows = kept.select(F.explode("variants").alias("latin_input"), F.col("word").alias("expected"), "category", "difficulty")
    return rows.orderBy("category", level, "latin_input", "expected")


def progress(entries: DataFrame) -> DataFrame:
    """(field, value, n, share) of review status, category and difficulty."""
    pair = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("review_status", "category", "difficulty")]))
    total = entries.count()
    return entries.select(pair.alias("p")).groupBy("p.field", "p.value").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.lit(max(total, 1)))


def next_pending(entries: DataFrame, after: int) -> int | None:
    """The first pending entry behind a place, beginning again at the top."""
    at = entries.filter(F.col("review_status") == "pending").agg(F.min(F.when(F.col("place") > after, F.col("place"))), F.min("place")).first()
    return at[0] if at[0] is not None else at[1]


def filtered(entries: DataFrame, source: str | None = None, only_source: str | None = None, sources_min: int | None = None, sources_max: int | None = None, failures: bool = False, variants_min: int | None = None, variants_max: int | None = None, search: str | None = None) -> DataFrame:
    """Entries that meet all conditions given; search looks for its lower-case form in the word and in any romanization."""
    n, v = F.size("sources"), F.size("romanizations")
    tests = []
    if source:
        tests.append(F.array_contains("sources", source))
    if only_source:
        tests.append((n == 1) & F.array_contains("sources", only_source))
    if failures:
        tests.append(v == 0)
    for col, low, high in ((n, sources_min, sources_max), (v, variants_min, variants_max)):
        tests += [col >= low] * (low is not None) + [col <= high] * (high is not None)
    if search:
        q = search.lower()
        tests.append(F.col("word").contains(q) | F.exists("romanizations", lambda r: r.contains(q)))
    for t in tests:
        entries = entries.filter(t)
    return entries


def page(entries: DataFrame, offset: int, limit: int) -> DataFrame:
    """A page of entries by descending frequency, then word."""
    return entries.orderBy(F.desc("frequency"), F.asc("word")).offset(offset).limit(limit)


def benchmark_filter(rows: DataFrame, category: str | None = None, difficulty: str | None = None) -> DataFrame:
    for name, value in (("category", category), ("difficulty", difficulty)):
        rows = rows.filter(F.col(name) == value) if value else rows
    return rows


def heuristics(entries: DataFrame, script: Script) -> dict[str, DataFrame]:
    """Entries whose spellings are doubtful: h1 fewer vowel clusters than nuclei, h2 fewer consonants, h3 too long for the shortest spelling, h4 many
    consonants and a short spelling."""
    consonant = f"[{script.consonants}]" if script.consonants else "[bcdfghjklmnpqrstvwxzßçñ]"
    e = entries.select("word", "frequency", F.size("sources").alias("source_count"), longest(F.col("romanizations")).alias("max_rom"), shortest(F.col("romanizations")).alias("min_rom"))
    count = lambda c, p: F.regexp_count(F.col(c), F.lit(p))
    e = e.withColumn("nuclei", nuclei(F.col("word"), script)).withColumn("consonants", count("word", consonant)).withColumn("base_len", base_length(F.col("word"), script))
    e = e.withColumn("rom_clusters", F.when(F.col("max_rom") == "", 0).otherwise(vowel_clusters(F.col("max_rom")))).withColumn("rom_consonants", count("max_rom", r"(?i)[^aeiouy\s]"))
    silent = count("word", script.silencer) if script.silencer else F.lit(0)
    ratio = F.when(F.length("min_rom") > 0, F.col("base_len") / F.length("min_rom")).otherwise(999.0)
    return {
        "h1": e.withColumn("discrepancy", F.col("nuclei") - F.col("rom_clusters")).filter("discrepancy >= 1").select("word", "frequency", "source_count", "nuclei", "rom_clusters", "discrepancy", "max_rom"),
        "h2": e.withColumn("silent", silent).withColumn("discrepancy", F.col("consonants") - F.col("rom_consonants") - F.col("silent")).filter("discrepancy >= 2").select("word", "frequency", "source_count", "consonants", "rom_consonants", "silent", "discrepancy", "max_rom"),
        "h3": e.withColumn("ratio", ratio).filter("ratio > 2.0").select("word", "frequency", "source_count", "base_len", F.length("min_rom").alias("min_rom_len"), F.round("ratio", 2).alias("ratio"), "min_rom"),
        "h4": e.filter((F.col("consonants") >= 3) & (F.length("max_rom") <= 5)).select("word", "frequency", "source_count", "consonants", F.length("max_rom").alias("max_rom_len"), "max_rom"),
    }


FENCE = r"(?s)```[^\n]*\n(.*?)```"


def batches(words: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """(batch, words): the first limit words by frequency, size to a batch."""
    numbered = ranked(words.select("word", "freq"), zero=True)
    if limit:
        numbered = numbered.filter(F.col("rank") < limit)
    group = F.floor(F.col("rank") / size).alias("batch")
    return numbered.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias("words"))


def answered(batch: DataFrame, ask: Callable[[list[str]], str]) -> DataFrame:
    """(batch, words, answer, error): an answer to each batch, from any callable; what it raises becomes error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for n, words in zip(f["batch"], f["words"], strict=True):
                try:
                    rows.append((n, list(words), ask(list(words)), None))
                except Exception as e:  # noqa: BLE001  any failure of the remote side is data here
                    rows.append((n, list(words), None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["batch", "words", "answer", "error"])

    return batch.mapInPandas(run, "batch long, words array<string>, answer string, error string")


def answer_lines(answer: Column) -> Column:
    """Trimmed lines of the first code fence of an answer, or of all of it."""
    inside = F.regexp_extract(answer, FENCE, 1)
    body = F.when(answer.rlike(FENCE), inside).otherwise(answer)
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: x != "")


def parsed(answers: DataFrame) -> DataFrame:
    """answers with known and unknown: what they name that is, and is not, in their batch."""
    a = answers.withColumn("lines", F.coalesce(answer_lines(F.col("answer")), F.array().cast("array<string>")))
    return a.withColumn("known", F.array_intersect("lines", "words")).withColumn("unknown", F.array_except("lines", "words")).drop("lines")


def logged(answers: DataFrame, path: str, run: str) -> DataFrame:
    """Appends parsed answers as JSON lines in order of batches under the name of their run, and returns (batch, error) of those that failed."""
    n = lambda c: F.size(c).alias(f"n_{c}")
    rows = answers.select(F.lit(run).alias("run"), "batch", n("words"), n("known"), "unknown", "answer", "error")
    rows.orderBy("batch").write.mode("append").json(path)
    return answers.filter(F.col("error").isNotNull()).select("batch", "error")


def candidates(parsed_: DataFrame) -> DataFrame:
    """(word): all known words of all answers, once."""
    return parsed_.select(F.explode("known").alias("word")).distinct()


def approved(lines: DataFrame) -> DataFrame:
    """(word): trimmed lines that are no comment, once."""
    return lines.select(F.trim("value").alias("word")).filter("word <> '' and word not like '#%'").distinct()


def release_diff(new: DataFrame, old: DataFrame) -> DataFrame:
    """(name, status) of files (name, sha256): NEW, CHANGED, UNCHANGED or REMOVED."""
    j = new.select("name", F.col("sha256").alias("a")).join(old.select("name", F.col("sha256").alias("b")), "name", "full")
    return j.select("name", F.when(F.col("b").isNull(), "NEW").when(F.col("a").isNull(), "REMOVED").when(F.col("a") == F.col("b"), "UNCHANGED").otherwise("CHANGED").alias("status"))
