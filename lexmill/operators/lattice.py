"""Word lattices over queries, and the search for their best paths.

An edge is a key that occurs in a query: all substrings of a query, up to the longest key's length, meet the key table in one equi-join, so
no prefix index is built. Best paths: an Arrow function per query holds the beam (queries are independent of each other); a
recursive query enumerates all paths of short queries, as a check.
"""

from __future__ import annotations

import uuid
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SearchConfig
from ..functions.text import query_text

EDGES = "query_id long, text string, s int, e int, word string, freq double"


def edges(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, text, s, e, word_id, word, freq) of queries (query_id, input) and keys (romanization_key, word_id, word, frequency); equal
    words on equal places once."""
    longest = keys.agg(F.max(F.length("romanization_key"))).first()[0] or 0
    q = queries.select("query_id", query_text(F.col("input")).alias("text")).filter("text <> ''")
    at = q.select("query_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 1)).alias("s"))
    piece = at.select("*", F.explode(F.sequence(F.lit(1), F.least(F.lit(max(longest, 1)), F.length("text") - F.col("s")))).alias("n")).withColumn("romanization_key", F.substring("text", F.col("s") + 1, F.col("n")))
    found = piece.join(keys.select("romanization_key", "word_id", "word", F.col("frequency").alias("freq")), "romanization_key")
    return found.select("query_id", "text", "s", (F.col("s") + F.col("n")).alias("e"), "word_id", "word", "freq").dropDuplicates(["query_id", "s", "e", "word_id"])


def edge_cost(freq: float, config: SearchConfig) -> float:
    return -log(max(freq, config.floor)) + config.penalty


class Backoff:
    """Scores of words after two others, from dicts of log10 scores."""

    def __init__(self, uni: dict, bi: dict, tri: dict, alpha: float = 0.4, floor: float = 6e-6):
        self.uni, self.bi, self.tri, self.alpha, self.floor = uni, bi, tri, alpha, floor

    def prob(self, prev2: str | None, prev1: str | None, word: str) -> float:
        p = 10 ** self.uni[word] if word in self.uni else self.floor
        if prev1 is not None:
            p = 10 ** self.bi[prev1, word] if (prev1, word) in self.bi else self.alpha * p
            if prev2 is not None:
                p = 10 ** self.tri[prev2, prev1, word] if (prev2, prev1, word) in self.tri else self.alpha * p
        return p


def beam(length: int, rows: list[tuple[int, int, str, float]], config: SearchConfig, scores: Backoff | None) -> list[tuple[str, float, list[str]]]:
    """The config.k best (output, cost, words) of edges (s, e, word, freq); of equal outputs the cheapest. States are the last two words; each
    keeps its k best paths, a place k times beam_multiplier in all. Ties go to the words that sort first."""
    if scores is None:
        return cheapest(length, rows, config)
    ending: dict[int, list] = {}
    for s, e, word, freq in rows:
        ending.setdefault(e, []).append((s, word, edge_cost(freq, config)))
    at: list[dict] = [{} for _ in range(length + 1)]
    at[0] = {(None, None): [(0.0, ())]}
    for e in range(1, length + 1):
        states: dict = {}
        for s, word, cost in ending.get(e, ()):
            for (prev2, prev1), paths in at[s].items():
                step = cost
                if config.ngram_weight:
                    step += config.ngram_weight * -log(max(scores.prob(prev2, prev1, word), 1e-20))
                states.setdefault((prev1, word), []).extend((c + step, (*words, word)) for c, words in paths)
        states = {k: sorted(v)[: config.k] for k, v in states.items()}
        wide = config.k * config.beam_multiplier
        if sum(map(len, states.values())) > wide:
            best = sorted(((c, w, k) for k, v in states.items() for c, w in v), key=lambda x: x[:2])[:wide]
            states = {}
            for c, w, k in best:
                states.setdefault(k, []).append((c, w))
        at[e] = states
    return distinct(sorted(p for v in at[length].values() for p in v) if length else [], config.k)


def distinct(paths: list[tuple[float, tuple]], k: int) -> list[tuple[str, float, list[str]]]:
    """The first k outputs of sorted paths, each with its cheapest path."""
    out: dict[str, tuple[str, float, list[str]]] = {}
    for c, words in paths:
        text = "".join(words)
        if text not in out:
            out[text] = (text, c, list(words))
            if len(out) == k:
                break
    return list(out.values())


def cheapest(length: int, rows: list[tuple[int, int, str, float]], config: SearchConfig) -> list[tuple[str, float, list[str]]]:
    """beam() where a word's cost is its own: one list of the k cheapest paths at each place that an edge reaches."""
    k, floor, penalty = config.k, config.floor, config.penalty
    at: dict[int, list] = {0: [(0.0, ())]} if length else {}
    found: dict[int, list] = {}
    for s, e, word, freq in sorted(rows):  # by beginning: all that ends at a place is known before what begins there
        if s not in at:
            if s not in found:
                continue
            paths = found[s]
            paths.sort()
            at[s] = paths[:k]
        cost = penalty - log(freq if freq > floor else floor)
        own = found.setdefault(e, [])
        for c, words in at[s]:
            own.append((c + cost, (*words, word)))
    return distinct(sorted(found.get(length, ())), k)


RESULT = "query_id long, rank int, output string, cost double, words string"


def search(lattice: DataFrame, config: SearchConfig, uni: DataFrame | None = None, bi: DataFrame | None = None, tri: DataFrame | None = None, alpha: float = 0.4, floor: float = 6e-6) -> DataFrame:
    """(query_id, rank, output, cost, words): the best paths of each query. Score tables, if given, are first cut down to words of each query's
    own lattice by joins, so that a task holds what its queries need and no more."""
    pieces = lattice.select("query_id", F.lit("edge").alias("kind"), "s", "e", F.length("text").alias("n"), F.col("word").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("string").alias("c"), F.col("freq").alias("v"))
    if uni is not None:
        own = lattice.select("query_id", F.col("word").alias("w1")).distinct()
        # neighbours in the lattice, then their scores
        pair = lattice.select("query_id", F.col("e").alias("m"), F.col("word").alias("w1")).join(lattice.select("query_id", F.col("s").alias("m"), F.col("word").alias("w2")), ["query_id", "m"]).select("query_id", "w1", "w2").distinct()
        triple = pair.join(pair.select("query_id", F.col("w1").alias("w2"), F.col("w2").alias("w3")), ["query_id", "w2"]).join(tri, ["w1", "w2", "w3"])
        row = lambda df, kind, a, b, c: df.select("query_id", F.lit(kind).alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("e"), F.lit(0).alias("n"), a.alias("a"), b.alias("b"), c.alias("c"), F.col("score").cast("double").alias("v"))
        none = F.lit(None).cast("string")
        pieces = pieces.unionByName(row(own.join(uni.select(F.col("word").alias("w1"), "score"), "w1"), "uni", F.col("w1"), none, none))
        pieces = pieces.unionByName(row(pair.join(bi, ["w1", "w2"]), "bi", F.col("w1"), F.col("w2"), none)).unionByName(row(triple, "tri", F.col("w1"), F.col("w2"), F.col("w3")).distinct())

    scored = uni is not None

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        edge = rows[rows["kind"] == "edge"]
        names = [c.split()[0] for c in RESULT.split(", ")]
        kinds = {"query_id": "int64", "rank": "int32", "output": object, "cost": "float64", "words": object}
        if not len(edge):
            return pd.DataFrame({c: pd.Series([], dtype=k) for c, k in kinds.items()})
        scores = None
        if scored:
            of = lambda kind: rows[rows["kind"] == kind]
            scores = Backoff(dict(zip(of("uni")["a"], of("uni")["v"], strict=True)), dict(zip(zip(of("bi")["a"], of("bi")["b"], strict=True), of("bi")["v"], strict=True)), dict(zip(zip(of("tri")["a"], of("tri")["b"], of("tri")["c"], strict=True), of("tri")["v"], strict=True)), alpha, floor)
        found = beam(int(edge["n"].iloc[0]), sorted(zip(edge["s"], edge["e"], edge["a"], edge["v"], strict=True)), config, scores)
        query = int(rows["query_id"].iloc[0])
        return pd.DataFrame([(query, i, out, cost, " ".join(words)) for i, (out, cost, words) in enumerate(found, 1)], columns=names).astype(kinds)

    return pieces.groupBy("query_id").applyInPandas(best, RESULT)


def exhaustive(lattice: DataFrame, config: SearchConfig) -> DataFrame:
    """(query_id, output, cost, words) of all paths of all queries, by a recursive query; for short queries, as Spark limits its depth
    (spark.sql.cteRecursionLevelLimit) and rows (spark.sql.cteRecursionRowLimit)."""
    cost = -F.ln(F.greatest(F.col("freq"), F.lit(config.floor))) + config.penalty
    view = f"lattice_{uuid.uuid4().hex}"
    lattice.select("query_id", F.length("text").alias("n"), "s", "e", "word", cost.alias("c")).createOrReplaceTempView(view)
    return lattice.sparkSession.sql(f"""
        WITH RECURSIVE paths(query_id, n, at, cost, output, words) AS (
          SELECT query_id, n, e, c, word, word FROM {view} WHERE s = 0
          UNION ALL
          SELECT p.query_id, p.n, x.e, p.cost + x.c, p.output || x.word, p.words || ' ' || x.word
          FROM paths p JOIN {view} x ON p.query_id = x.query_id AND p.at = x.s)
        SELECT query_id, output, cost, words FROM paths WHERE at = n""")


def judged(cases: DataFrame, results: DataFrame) -> DataFrame:
    """cases (query_id, input, expected) with rank and status: pass at the first place, warn below it, fail where it is missing."""
    hit = results.select("query_id", F.col("output").alias("expected"), "rank").groupBy("query_id", "expected").agg(F.min("rank").alias("rank"))
    return cases.join(hit, ["query_id", "expected"], "left").withColumn("status", F.when(F.col("rank") == 1, "pass").when(F.col("rank").isNotNull(), "warn").otherwise("fail"))
