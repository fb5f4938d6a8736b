"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sizes are words. Sources share `factor` times all words by their weights; what would exceed `most` times a source's words is
shared again among the others. A source's documents lie in blocks by a hash of their id, as many as its words ask for (a power of two from
BLOCKS to MOST_BLOCKS, each of about BLOCK_WORDS words in between). Its target says how often each block is to be drawn: the whole
number of times that fits, then blocks in permuted order as long as they fit in what is left; one more block is drawn in
part, by sub-blocks chosen in the same way, so that the words drawn end next to the target.

These draws are the exact quota of a source. A tree halves the output shards: at each node, the number of draws that
go left is split among sources by a multivariate-hypergeometric draw whose seed is the node's place, so a shard finds its
quotas, and which of each source's permuted draws are its own, by walking down from the root, without any other shard.
Shards thus take disjoint runs of the permuted draws. taken() counts what the shards of the tree draw; mixed() hands out the
documents, each shard a partition of its own (or a few, beyond PARTITIONS), sorted by a hash inside.

All group sizes are bounded: at most MOST_BLOCKS rows for each source, and BLOCKS sub-blocks of its one split block. One row per
source reaches the driver, and more than SOURCES of them are an error. The hash decides everything, so reruns agree and repeated rows (of
one id) are drawn together.

Nulls: a null text has no words, a null source is a source of its own and the last, null ids share a block. Documents without
words follow their block. Extra columns pass through; own columns of the input of the same names as outputs (size; source_size, target,
taken; copy, shard, place) are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, slices, small, small_batches, text_bytes

BLOCKS, MOST_BLOCKS, BLOCK_WORDS = 1 << 10, 1 << 18, 1 << 18
SOURCES = 1_000_000
SHARDS, SHARD_WORDS = 8, 4_000_000  # the least number of shards, and the words of one where there are more
PARTITIONS = 20_000
#: Own columns, under names that tables don't have.
MIX, BLOCK, SUB, MANY, CHOSEN, COPY, PARTLY, SHARD = (f"_mix_{x}" for x in ("source", "block", "sub", "many", "chosen", "copy", "partly", "shard"))
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_counts(texts: pa.Array) -> np.ndarray:
    """The number of words `[^\\x20\\x09-\\x0D]+` of each text."""
    raw, at = text_bytes(texts)
    inside = ~SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = at[:-1][np.diff(at) > 0]
    begins[first] = inside[first]
    return np.diff(np.searchsorted(np.flatnonzero(begins), at))


def sizes(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the column size instead of its text."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (text, "size")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["size long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(word_counts(b.column(text)))], [*[f.name for f in kept], "size"])

    return df.mapInArrow(run, schema)


def targets(totals: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), factor: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """The words that each source should give."""
    names = sorted((n for n in totals if n is not None)) + [n for n in totals if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, open_, out = factor * sum(totals.values()), set(names), {}
    while open_:
        share = left / sum(weight[n] for n in names if n in open_)
        full = [n for n in names if n in open_ and weight[n] * share >= most * totals[n]]
        if not full:
            out |= {n: weight[n] * share for n in names if n in open_}
            break
        for n in full:
            out[n] = float(most * totals[n])
            left -= out[n]
            open_.remove(n)
    return out


def greedy(words: np.ndarray, room: float) -> np.ndarray:
    """Which of the entries, in their order, fit in the room left."""
    taken = np.zeros(len(words), bool)
    for i, w in enumerate(words.tolist()):
        if w <= room:
            taken[i] = True
            room -= w
    return taken


def split(quota: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(where a shard's run of draws begins in each source, how many it has), by the way down from the root."""
    begin, low, high = np.zeros(len(quota), np.int64), 0, shards
    while high - low > 1:
        mid = (low + high) // 2
        total = int(quota.sum())
        n = total * (mid - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        left = rng.multivariate_hypergeometric(quota, n, method="marginals") if total else quota
        if shard < mid:
            quota, high = left, mid
        else:
            begin, quota, low = begin + left, quota - left, mid
    return begin, quota


def blocks_of(words: int) -> int:
    """The number of blocks of a source of so many words."""
    return min(MOST_BLOCKS, max(BLOCKS, 1 << ceil(words / BLOCK_WORDS).bit_length()))


class Plan:
    """targets and totals, by source; blocks (MIX, BLOCK, copies, partly, draw); subs (MIX, BLOCK, SUB) of the blocks drawn in part."""

    def __init__(self, sized: DataFrame, key: str = "doc_id", source: str = "source", seed: int = 17, **how):
        self.seed, self.key, self.source, self.spark = seed, key, source, sized.sparkSession
        per_source = sized.select(named_source(source).alias(MIX), "size").groupBy(MIX).agg(F.sum("size").alias("n"))
        found = per_source.limit(SOURCES + 1).collect()
        if len(found) > SOURCES:
            raise ValueError(f"more than {SOURCES} sources")
        self.totals = {r[MIX]: r["n"] for r in found}
        named = {None if k == "none" else k[1:]: k for k in self.totals}
        self.targets = {named[n]: t for n, t in targets({n: self.totals[k] for n, k in named.items()}, **how).items()}
        rows = [(k, int(n), float(self.targets[k]), blocks_of(n)) for k, n in self.totals.items()]
        self.sources = small(cut(self.spark.createDataFrame(rows, f"{MIX} string, source_size long, target double, {MANY} int"), "sources"))
        placed = self.placed(sized.select(key, source, "size"))
        by_block = placed.groupBy(MIX, BLOCK).agg(F.sum("size").alias("words")).join(self.sources.select(MIX, "source_size", "target"), MIX)

        def choose(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.iloc[np.argsort([hash_of(seed, keys[0], b) for b in rows[BLOCK]], kind="stable")]
            words, total, aim = rows["words"].to_numpy(), int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
            each = int(aim // total) if total else 0
            taken = greedy(words, aim - each * total)
            left = aim - each * total - words[taken].sum()
            rows = rows.assign(copies=each + taken.astype(int), partly=False, room=float(left), draw=np.arange(len(rows)))
            skipped = np.flatnonzero(~taken)
            if left > 0 and len(skipped):
                rows.iloc[skipped[words[skipped].argmin()], rows.columns.get_loc("partly")] = True
            return rows[[MIX, BLOCK, "copies", "partly", "room", "draw"]]

        self.blocks = cut(by_block.groupBy(MIX).applyInPandas(choose, f"{MIX} string, {BLOCK} int, copies int, partly boolean, room double, draw int"), "choice")
        partly = self.blocks.filter("partly").select(MIX, BLOCK, "room")  # one row a source

        def finish(keys: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.iloc[np.argsort([hash_of(seed + 1, keys[0], b) for b in rows[SUB]], kind="stable")]
            words, room = rows["words"].to_numpy(), float(rows["room"].iloc[0])
            taken = greedy(words, room)
            left = room - words[taken].sum()
            if (~taken).any():
                i = np.flatnonzero(~taken)[words[~taken].argmin()]
                taken[i] = words[i] - left < left
            return rows[taken][[MIX, BLOCK, SUB]]

        parts = placed.join(small(partly), [MIX, BLOCK]).groupBy(MIX, BLOCK, SUB).agg(F.sum("size").alias("words"), F.max("room").alias("room"))
        self.subs = cut(parts.groupBy(MIX, BLOCK).applyInPandas(finish, f"{MIX} string, {BLOCK} int, {SUB} int"), "subs").withColumn(CHOSEN, F.lit(True))

    def placed(self, df: DataFrame) -> DataFrame:
        """df with the columns MIX (the source, never null), BLOCK and SUB."""
        h = lambda k: F.xxhash64(F.lit(self.seed + k), F.col(self.key))
        mixed = df.withColumn(MIX, named_source(self.source)).join(self.sources.select(MIX, MANY), MIX)
        return mixed.withColumn(BLOCK, F.pmod(h(0), F.col(MANY)).cast("int")).withColumn(SUB, F.pmod(h(1), F.lit(BLOCKS)).cast("int")).drop(MANY)

    def shards(self, shard_words: int = SHARD_WORDS) -> int:
        """How many shards the mix has: by words, and no more than a quarter of the draws."""
        draws = self.blocks.agg(F.sum(F.col("copies") + F.col("partly").cast("int"))).first()[0] or 0
        return max(1, min(max(SHARDS, ceil(sum(self.targets.values()) / shard_words)), draws // 4))

    def draws(self, shards: int) -> DataFrame:
        """(MIX, BLOCK, COPY, PARTLY, SHARD): every draw of a block, by the shard of the tree that makes it."""
        seed = self.seed
        # a source's draws: pass by pass over its permuted blocks, the one drawn in part last
        times = F.col("copies") + F.col("partly").cast("int")
        every = self.blocks.filter(times > 0).withColumn(COPY, F.explode(F.sequence(F.lit(1), times))).withColumn(PARTLY, F.col("partly") & (F.col(COPY) > F.col("copies")))
        every = cut(every.withColumn("nth", F.row_number().over(Window.partitionBy(MIX).orderBy(PARTLY, COPY, "draw")) - 1).select(MIX, BLOCK, COPY, PARTLY, "nth"), "draws")
        quota = {r[MIX]: r["n"] for r in every.groupBy(MIX).agg(F.count("*").alias("n")).collect()}
        names = sorted(quota)
        counts = np.array([quota[n] for n in names], np.int64)

        def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for shard in f["id"].tolist() if names else ():
                    begin, n = split(counts, shards, shard, seed)
                    yield pd.DataFrame({SHARD: shard, MIX: names, "begin": begin, "n": n})

        runs = self.spark.range(shards).mapInPandas(walk, f"{SHARD} long, {MIX} string, begin long, n long").filter("n > 0")
        owned = runs.select(SHARD, MIX, F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("n") - 1)).alias("nth"))
        return cut(every.join(owned, [MIX, "nth"]).select(MIX, BLOCK, COPY, PARTLY, SHARD), "owned")

    def taken(self, sized: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
        """sized with source_size, target and taken: a document's words as often as shards of the tree draw it."""
        owned = self.draws(self.shards(shard_words)).groupBy(MIX, BLOCK).agg(F.count_if(~F.col(PARTLY)).alias(COPY), F.count_if(PARTLY).alias(PARTLY))
        rows = self.placed(sized.drop("source_size", "target", "taken")).join(small(cut(owned, "taken")), [MIX, BLOCK], "left").join(small(self.subs), [MIX, BLOCK, SUB], "left")
        times = F.coalesce(COPY, F.lit(0)) + F.when(F.col(CHOSEN), F.coalesce(PARTLY, F.lit(0))).otherwise(0)
        return rows.join(self.sources.drop(MANY), MIX, "left").withColumn("taken", F.col("size") * times).drop(MIX, BLOCK, SUB, COPY, PARTLY, CHOSEN)

    def mixed(self, df: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
        """A row of df for each time that the mix takes it, with copy, shard and place, sorted within shards."""
        shards = self.shards(shard_words)
        rows = self.placed(df.drop("copy", "shard", "place")).join(small(self.draws(shards)), [MIX, BLOCK]).join(small(self.subs), [MIX, BLOCK, SUB], "left")
        rows = rows.filter(~F.col(PARTLY) | F.col(CHOSEN)).withColumn("place", F.xxhash64(F.lit(self.seed + 2), SHARD, self.key, COPY))
        named = rows.drop(MIX, BLOCK, SUB, PARTLY, CHOSEN).withColumnsRenamed({COPY: "copy", SHARD: "shard"})
        parts = min(shards, PARTITIONS)
        return named.repartitionById(parts, F.pmod("shard", F.lit(parts)).cast("int")).sortWithinPartitions("shard", "place")


def named_source(source: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("none"))


def hash_of(seed: int, mix: str, n: int) -> int:
    """A permutation of blocks: the same for the same source, whatever machine."""
    x = 1469598103934665603
    for b in f"{seed}/{mix}/{n}".encode():
        x = (x ^ b) * 1099511628211 % 2**64
    x ^= x >> 33
    return x * 0xFF51AFD7ED558CCD % 2**64
