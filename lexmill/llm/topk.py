"""Exact top-k search by inner product: tiled matrix products, partial selection per tile, merging.

Vectors become integers floor(scale * x), kept in the narrowest of KINDS that holds their block. Candidates are packed into blocks of
SHARD rows, queries into blocks of QUERIES rows. A tile is a pair of blocks. Candidate blocks are dealt into FAN parts, query blocks
into parts of about PART_BYTES with their lists; a task takes one part of each and keeps the k best of each query over all its tiles.
So nothing is broadcast or copied for each tile: what is written is one list of a query for each of the FAN parts, in proportion to the
queries, and the last step merges these.

Products are exact: where the bound dim * max|q| * max|c| is below 2 ** 24 they are taken in floats, below 2 ** 53 in doubles, else in
integers of any size, cut off at the range of long. Ties go to the smaller id. A query's own row is no candidate: lists hold one place more until, at
the end, one entry of the query's id and of its product with itself goes, so other rows of the same id stay.
Nulls: null vectors, vectors with a null or non-finite component, and null ids take no part; vectors meet
only those of their own length. Rows of a repeated id are queries and candidates each for itself, so such a query_id
has a list for each of its rows. Empty tables give no rows; with fewer than k
candidates, all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

SHARD, QUERIES, FAN = 2048, 1024, 16
#: About so many bytes of queries and their lists does a task hold.
PART_BYTES = 32 << 20
#: Types of stored components, by the bytes of one.
KINDS = {1: np.int8, 2: np.int16, 8: np.float64}
BLOCK = "no long, dim int, ids binary, rows binary"
LIST = "qb long, queries binary, own binary, ids binary, scores binary"
LOW, HIGH = -(2**63), 2**63 - 1
NONE = LOW  # an id that fills up lists; a row of this id is left out


def narrow(rows: np.ndarray) -> np.ndarray:
    """Whole numbers in the first of KINDS that holds them all."""
    most = np.abs(rows).max(initial=0)
    return rows.astype(np.int8 if most < 2**7 else np.int16 if most < 2**15 else np.float64)


def matrix(rows: pa.Buffer, n: int, dim: int) -> np.ndarray:
    """The n rows of a block as doubles."""
    return np.frombuffer(rows, KINDS[rows.size // (n * dim)]).reshape(n, dim).astype(np.float64)


def packed(df: DataFrame, vec_id: str, vector: str, scale: int, size: int) -> DataFrame:
    """Blocks (no, dim, ids, rows) of at most size integer vectors of one length; no is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: dict[int, list] = {}

        def block(dim: int, n: int) -> pa.RecordBatch:
            nonlocal number
            ids, rows = (np.concatenate([x[i] for x in held[dim]]) for i in (0, 1))
            held[dim] = [(ids[n:], rows[n:])]
            number += 1
            return pa.RecordBatch.from_pydict({"no": [number - 1], "dim": pa.array([dim], pa.int32()), "ids": [ids[:n].tobytes()], "rows": [narrow(rows[:n]).tobytes()]})

        for b in batches:
            column = b.column(1)
            length = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.cumsum(length) - length
            for dim in np.unique(length).tolist():
                if not dim:
                    continue
                own = np.flatnonzero(length == dim)
                rows = np.floor(scale * flat[at[own][:, None] + np.arange(dim)])
                ok = np.isfinite(rows).all(axis=1)
                held.setdefault(dim, []).append((ids[own[ok]], rows[ok]))
                while sum(len(x[0]) for x in held[dim]) >= size:
                    yield block(dim, size)
        for dim in held:
            while n := sum(len(x[0]) for x in held[dim]):
                yield block(dim, min(n, size))

    whole = df.filter((F.col(vec_id).cast("long") != LOW) & F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull()))
    return whole.select(F.col(vec_id).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(run, BLOCK)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, as long."""
    bound = np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(c).T, LOW, HIGH).astype(np.int64)


def scored(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products as well, as floats where these hold them."""
    if np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] < 2**24:
        return q.astype(np.float32) @ c.astype(np.float32).T
    return products(q, c)


def squares(q: np.ndarray) -> np.ndarray:
    """Exact products of integer rows with themselves, as long."""
    if np.abs(q).max(initial=0) ** 2 * q.shape[1] < 2**53:
        return (q * q).sum(axis=1).astype(np.int64)
    return np.concatenate([products(row[None], row[None])[0] for row in q])


def best(scores: np.ndarray, ids: np.ndarray, valid: np.ndarray, k: int, sorted_ids: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row by score, then smaller id; ids of NONE fill up. sorted_ids: the ids of each row ascend."""
    n = scores.shape[1]
    keep = valid
    if sorted_ids and n > k:  # all above the k-th score, and of those that equal it the first
        rank = np.where(valid, scores, LOW)
        kth = np.partition(rank, n - k, axis=1)[:, n - k, None]
        above, same = rank > kth, (rank == kth) & valid
        keep = above | same & (np.cumsum(same, axis=1, dtype=np.int32) <= k - above.sum(axis=1, keepdims=True))
    r, c = np.nonzero(keep)
    return ranked(r, scores[r, c], ids[r, c], len(scores), k)


def ranked(r: np.ndarray, scores: np.ndarray, ids: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each of n rows, from entries of rows r in any order."""
    order = np.lexsort((ids, ~scores, r))
    r, scores, ids = r[order], scores[order], ids[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    few = place < k
    out_s, out_i = np.full((n, k), LOW), np.full((n, k), NONE)
    out_s[r[few], place[few]], out_i[r[few], place[few]] = scores[few], ids[few]
    return out_s, out_i


def marked(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.nonzero of a matrix, faster where few are set: eight are looked at at once."""
    flat = keep.reshape(-1)
    whole = len(flat) // 8 * 8
    eights = np.flatnonzero(flat[:whole].view(np.uint64)) * 8
    at = np.concatenate([(eights[:, None] + np.arange(8)).reshape(-1), np.arange(whole, len(flat))])
    return np.divmod(at[flat[at]], keep.shape[1])


class Lists:
    """The k best candidates so far of each query of a block."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), LOW), np.full((n, k), NONE)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Takes in a tile's scores (a row per query); the ids ascend."""
        n, k = self.scores.shape
        empty = self.ids[:, -1] == NONE
        least, last = self.scores[:, -1], np.where(empty, HIGH, self.ids[:, -1])
        # rounding a held score to float keeps its order towards the tile's, which floats hold exactly
        floor = least.astype(scores.dtype)
        if empty.any() and scores.shape[1] > k:  # what is below the tile's own k best can't stay
            floor = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k])
        r, c = marked(scores >= floor[:, None])
        found = scores[r, c].astype(np.int64)
        better = (found > least[r]) | (ids[c] <= last[r])
        r, c, found = r[better], c[better], found[better]
        if len(r) > 8 * n * k:
            keep = np.zeros(scores.shape, bool)
            keep[r, c] = True
            top, own = best(scores.astype(np.int64), np.broadcast_to(ids, scores.shape), keep, k, True)
            both, own = np.hstack([self.scores, top]), np.hstack([self.ids, own])
            self.scores, self.ids = best(both, own, own != NONE, k)
        elif len(r):
            rows, at = np.unique(r, return_inverse=True)
            held = self.ids[rows] != NONE
            h = np.nonzero(held)
            at, found, own = np.concatenate([at, h[0]]), np.concatenate([found, self.scores[rows][h]]), np.concatenate([ids[c], self.ids[rows][h]])
            self.scores[rows], self.ids[rows] = ranked(at, found, own, len(rows), k)


def search(df: DataFrame, is_query: F.Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that is_query marks, the k rows of df of the highest inner products."""
    shards = cut(packed(df, vec_id, vector, scale, SHARD), "shards")
    n_queries = max(1, df.filter(is_query).count())
    spread = df.filter(is_query).select(vec_id, vector).repartition(-(-n_queries // (32 * QUERIES)), F.xxhash64(vec_id))
    queries = cut(packed(spread, vec_id, vector, scale, QUERIES), "queries")
    # of each query: its components, and in longs its id, its product with itself and its list
    held = queries.agg(F.sum(F.octet_length("rows").cast("long") + F.octet_length("ids").cast("long") * (2 * k + 4))).first()[0] or 0
    right = queries.select(F.col("no").alias("qb"), F.col("dim").alias("qdim"), F.col("ids").alias("qids"), F.col("rows").alias("qrows")).repartition(max(1, math.ceil(held / PART_BYTES)))
    # a hint, as Spark might take one side for small and broadcast it: tasks read their part of both sides instead
    tiles = shards.repartition(FAN).hint("shuffle_replicate_nl").crossJoin(right)

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, tuple] = {}
        no = ids = rows = None
        for b in batches:
            at = {name: b.column(i) for i, name in enumerate(b.schema.names)}
            for i in range(b.num_rows):
                dim, qb = at["dim"][i].as_py(), at["qb"][i].as_py()
                if at["qdim"][i].as_py() != dim:
                    continue
                if no != at["no"][i].as_py():
                    no, ids = at["no"][i].as_py(), np.frombuffer(at["ids"][i].as_buffer(), np.int64)
                    order = np.argsort(ids, kind="stable")
                    ids, rows = ids[order], matrix(at["rows"][i].as_buffer(), len(ids), dim)[order]
                if qb not in blocks:
                    q = np.frombuffer(at["qids"][i].as_py(), np.int64)
                    blocks[qb] = (q, narrow(matrix(at["qrows"][i].as_buffer(), len(q), dim)), Lists(len(q), k + 1))
                q, m, top = blocks[qb]
                top.add(scored(m.astype(np.float64), rows), ids)
        for qb, (q, m, top) in blocks.items():
            yield pa.RecordBatch.from_pydict({"qb": [qb], "queries": [q.tobytes()], "own": [squares(m.astype(np.float64)).tobytes()], "ids": [top.ids.tobytes()], "scores": [top.scores.tobytes()]})

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        n = len(rows["queries"].iloc[0]) // 8
        ids = np.hstack([np.frombuffer(x, np.int64).reshape(n, k + 1) for x in rows["ids"]])
        scores = np.hstack([np.frombuffer(x, np.int64).reshape(n, k + 1) for x in rows["scores"]])
        top, ids = best(scores, ids, ids != NONE, k + 1)
        return rows.iloc[:1].assign(ids=[ids.tobytes()], scores=[top.tobytes()])

    lists = cut(tiles.mapInArrow(tile, LIST), "lists").groupBy("qb").applyInPandas(merge, LIST)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                q = np.frombuffer(t["queries"], np.int64)
                ids, scores = (np.frombuffer(t[x], np.int64).reshape(len(q), k + 1) for x in ("ids", "scores"))
                own = (ids == q[:, None]) & (scores == np.frombuffer(t["own"], np.int64)[:, None])
                other = ~(own & (np.cumsum(own, axis=1) == 1)) & (ids != NONE)
                place = np.cumsum(other, axis=1) - 1
                r, c = np.nonzero(other & (place < k))
                yield pa.RecordBatch.from_arrays([pa.array(q[r]), pa.array((place[r, c] + 1).astype(np.int32)), pa.array(ids[r, c]), pa.array(scores[r, c])], ["query_id", "rank", "vec_id", "score"])

    return lists.mapInArrow(spell, "query_id long, rank int, vec_id long, score long")
