"""Writers. All but the JSON dataset and the release files are distributed; `single` writes one part where a consumer needs one file."""

from __future__ import annotations

import gzip
import hashlib
import json
import shutil
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Script
from ..functions.tokens import with_boundaries
from ..operators import batches


def _parts(df: DataFrame, single: bool) -> DataFrame:
    return df.coalesce(1) if single else df


def gram_counts(grams: DataFrame, n: int, path: str, min_count: int = 2) -> None:
    """Tab-separated counts of n-grams of one size, by descending count, then n-gram, in the order of part files."""
    cols = ["w1", "w2", "w3"][:n]
    df = grams.filter((F.col("n") == n) & (F.col("cnt") >= min_count)).orderBy(F.desc("cnt"), *cols)
    df.select(F.concat_ws("\t", *cols, F.col("cnt").cast("string"))).write.mode("overwrite").text(path)


def gram_freqs(freqs: DataFrame, n: int, path: str, min_freq: float = 0.0) -> None:
    cols = ["w1", "w2", "w3"][:n]
    df = freqs.filter((F.col("n") == n) & (F.col("freq") >= min_freq)).orderBy(F.desc("freq"), *cols)
    df.select(F.concat_ws("\t", *cols, F.format_string("%.12e", "freq"))).write.mode("overwrite").text(path)


def token_files(tokens: DataFrame, path: str) -> None:
    """One token a line, an empty line for each boundary and after each document; documents without tokens are left out."""
    lines = F.regexp_replace(F.regexp_replace(F.array_join("tokens", "\n", ""), r"\A\n+|\n+\z", ""), r"\n{3,}", "\n\n")
    _token_lines(tokens.select("corpus", lines.alias("t")).filter("t <> ''"), path)


def text_tokens(texts: DataFrame, script: Script, path: str) -> None:
    """token_files() of whole texts (corpus, text)."""
    if batches.plain(script):
        _token_lines(batches.lines(texts, script), path)
    else:
        token_files(texts.select("corpus", with_boundaries(F.col("text"), script).alias("tokens")), path)


def _token_lines(t: DataFrame, path: str) -> None:
    t.select("corpus", F.concat("t", F.lit("\n")).alias("value")).write.mode("overwrite").partitionBy("corpus").text(path)


def wordlist(words: DataFrame, path: str, single: bool = False) -> None:
    """words: (rank, word, frequency, source_count, sources)."""
    _parts(words.orderBy("rank"), single).withColumn("frequency", F.format_string("%.12f", "frequency")).write.mode("overwrite").csv(path, header=True)


def variants(df: DataFrame, path: str) -> None:
    df.select("word", "romanizations").write.mode("overwrite").parquet(path)


def flat(df: DataFrame, path: str, single: bool = False) -> None:
    _parts(df, single).withColumn("frequency", F.format_string("%.12f", "frequency")).write.mode("overwrite").csv(path, header=True)


def dataset(entries: DataFrame, metadata: DataFrame, path: str) -> int:
    """The dataset as one JSON document, streamed row by row; returns the number of entries."""
    n = 0
    with open(path, "w", encoding="utf-8") as f:
        f.write('{"metadata": ' + metadata.select(F.to_json(F.struct("*"))).first()[0] + ', "entries": [')
        for r in entries.orderBy("word_id").select(F.to_json(F.struct("*"))).toLocalIterator():
            f.write(",\n" * bool(n) + r[0])
            n += 1
        f.write("]}\n")
    return n


def report(df: DataFrame, path: str) -> None:
    """A small report as one CSV file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def compressed(path: str) -> str:
    """A gzip copy that depends on nothing but the content."""
    with open(path, "rb") as a, open(f"{path}.gz", "wb") as raw, gzip.GzipFile("", "wb", fileobj=raw, mtime=0) as b:
        shutil.copyfileobj(a, b)
    return f"{path}.gz"


def sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(version: str, files: list[str], path: str) -> dict:
    """Names, sizes and digests of a release's files."""
    out = {"version": version, "files": [{"name": Path(p).name, "size": Path(p).stat().st_size, "sha256": sha256(p)} for p in sorted(files)]}
    Path(path).write_text(json.dumps(out, indent=1) + "\n", "utf-8")
    return out
