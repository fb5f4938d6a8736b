"""The packed language-model file: writing, reading and verification.

Spark maps words to ids and sorts; the driver streams the sorted rows into the file, holding one row at a time, and the string table, which the
format limits to 65,535 words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import zip_longest
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

#: Fixed values of the format, little-endian.
MAGIC, LAYOUT = b"TNLM", 1
HEADER = struct.Struct("<4sHHHBBIIIfI")
PAIR, TRIPLE, SCORE = struct.Struct("<HHf"), struct.Struct("<HHHHf"), struct.Struct("<f")
METHODS = {"sbo": 0, "mkn": 1, "katz": 2}


@dataclass(frozen=True)
class Header:
    vocab_size: int
    smoothing: int
    min_count: int
    n_bigrams: int
    n_trigrams: int
    alpha: float
    build_info: int = 0


def build_info(days: int, commit: int) -> int:
    """Days since 1970 above, the beginning of a commit's hash below."""
    return (days & 0xFFFF) << 16 | commit & 0xFFFF


def numbered(vocabulary: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """Scores (w1 .. wn, score) with ids (i1 .. in) for words, sorted by them; n-grams with words outside the vocabulary are left out."""
    ids = [f"i{k}" for k in range(1, n + 1)]
    for k in range(1, n + 1):  # at most 65,535 words
        scores = scores.join(F.broadcast(vocabulary.select(F.col("word_id").alias(f"i{k}"), F.col("word").alias(f"w{k}"))), f"w{k}")
    return scores.select(*ids, "score").orderBy(*ids)


def write(path: str, vocabulary: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame, min_count: int, alpha: float = 0.4, build: int = 0) -> Header:
    """Writes scores (word / w1, w2 / w1, w2, w3, score) of a vocabulary (word_id, word) with ids 0 .. n - 1. Words without a score get the least score of
    all (-10 if there is none); n-grams with words outside the vocabulary are left out."""
    if not 0 <= min_count <= 255:
        raise ValueError(f"min_count {min_count} does not fit in a byte")
    size, low, high, bytes_ = vocabulary.agg(F.count("*"), F.min("word_id"), F.max("word_id"), F.max(F.octet_length("word"))).first()
    if size > 0xFFFF or (size and (low != 0 or high != size - 1)):
        raise ValueError(f"a vocabulary of {size} words with ids from {low} to {high}: ids must be 0 to n - 1, n at most 65535")
    if bytes_ and bytes_ > 255:
        raise ValueError(f"a word of {bytes_} bytes; at most 255 fit")
    floor = uni.agg(F.min("score")).first()[0]
    floor = -10.0 if floor is None else floor
    two, three = numbered(vocabulary, bi, 2), numbered(vocabulary, tri, 3)
    words = vocabulary.join(uni.select("word", "score"), "word", "left").select("word_id", "word", F.coalesce("score", F.lit(floor)).alias("score")).orderBy("word_id").collect()
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    n2 = n3 = 0
    with open(path, "wb") as f:
        f.write(bytes(HEADER.size))
        for r in words:
            raw = r["word"].encode()
            f.write(bytes([len(raw)]) + raw)
        for r in words:
            f.write(SCORE.pack(r["score"]))
        for r in two.toLocalIterator(prefetchPartitions=True):
            f.write(PAIR.pack(*r))
            n2 += 1
        for i, j, k, score in three.toLocalIterator(prefetchPartitions=True):
            f.write(TRIPLE.pack(i, j, k, 0, score))
            n3 += 1
        f.seek(0)
        f.write(HEADER.pack(MAGIC, LAYOUT, 0, size, METHODS["sbo"], min_count, size, n2, n3, alpha, build))
    return Header(size, 0, min_count, n2, n3, alpha, build)


def parse(path: str) -> tuple[Header, list[str], list[float], Iterator[tuple], Iterator[tuple]]:
    """Header, words, scores, and iterators of pairs and triples with their scores. ValueError for files that are not of this format."""
    raw = Path(path).read_bytes()
    if len(raw) < HEADER.size or raw[:4] != MAGIC:
        raise ValueError(f"{path} is no model file")
    _, layout, _, size, method, least, n1, n2, n3, alpha, build = HEADER.unpack_from(raw)
    if layout != LAYOUT or n1 != size:
        raise ValueError(f"{path}: layout {layout} with {n1} unigrams of {size} words")
    words, at = [], HEADER.size
    for _ in range(size):
        words.append(raw[at + 1 : at + 1 + raw[at]].decode())
        at += 1 + raw[at]
    end = at + 4 * size + PAIR.size * n2 + TRIPLE.size * n3
    if end != len(raw):
        raise ValueError(f"{path} has {len(raw)} bytes instead of {end}")
    two, three = at + 4 * size, at + 4 * size + PAIR.size * n2
    triples = ((i, j, k, s) for i, j, k, _, s in TRIPLE.iter_unpack(raw[three:]))
    return Header(size, method, least, n2, n3, alpha, build), words, [x[0] for x in SCORE.iter_unpack(raw[at:two])], PAIR.iter_unpack(raw[two:three]), triples


def read(spark: SparkSession, path: str) -> tuple[Header, DataFrame, DataFrame, DataFrame]:
    """Header and (word_id, word, score), (w1, w2, score), (w1, w2, w3, score) tables."""
    header, words, scores, two, three = parse(path)
    uni = spark.createDataFrame([(i, w, s) for i, (w, s) in enumerate(zip(words, scores, strict=True))], "word_id int, word string, score float")
    return header, uni, spark.createDataFrame(list(two), schemas.BIGRAMS), spark.createDataFrame(list(three), schemas.TRIGRAMS)


def verify(path: str, vocabulary: list[str], uni: dict, bi: dict, tri: dict) -> list[str]:
    """What in a file differs from the scores given, by id, compared as 32-bit floats."""
    header, words, scores, two, three = parse(path)
    single = lambda x: SCORE.unpack(SCORE.pack(x))[0]
    wrong = [] if words == vocabulary else ["the string table differs"]
    wrong += [f"word {i}" for i, s in enumerate(scores) if i in uni and s != single(uni[i])]
    for name, found, want in (("bigrams", two, bi), ("trigrams", three, tri)):
        rows = list(found)
        if rows != sorted(rows, key=lambda r: r[:-1]):
            wrong.append(f"{name} are not sorted")
        if {r[:-1]: r[-1] for r in rows} != {k: single(v) for k, v in want.items()}:
            wrong.append(f"{name} differ")
    if (header.n_bigrams, header.n_trigrams) != (len(bi), len(tri)):
        wrong.append("the header's counts differ")
    return wrong


def differences(path: str, vocabulary: DataFrame, uni: DataFrame, bi: DataFrame, tri: DataFrame) -> list[str]:
    """What in a file differs from the tables that write() takes, first of each kind. Rows of both sides come sorted and are compared one by one,
    so that the driver holds no table but the string table."""
    header, words, scores, two, three = parse(path)
    single = lambda x: SCORE.unpack(SCORE.pack(x))[0]
    wrong = []
    given = vocabulary.join(uni.select("word", "score"), "word", "left").orderBy("word_id").select("word", "score").collect()  # at most 65,535 words
    if words != [r["word"] for r in given]:
        return ["the string table differs"]
    known = [r["score"] for r in given if r["score"] is not None]
    floor = uni.agg(F.min("score")).first()[0] if known or uni.limit(1).count() else -10.0
    wrong += [f"the score of word {i} differs" for i, (s, r) in enumerate(zip(scores, given, strict=True)) if s != single(floor if r["score"] is None else r["score"])][:1]
    for n, found, table, total in ((2, two, bi, header.n_bigrams), (3, three, tri, header.n_trigrams)):
        want = ((*r[:-1], single(r[-1])) for r in numbered(vocabulary, table, n).toLocalIterator(prefetchPartitions=True))
        for i, (a, b) in enumerate(zip_longest(found, want)):
            if a != b:
                wrong.append(f"row {i} of {total} with {n} words differs: {a} instead of {b}")
                break
    return wrong
