"""N-gram Jaccard join: MinHash banding, then verification on full n-gram sets.

A text's n-grams are all runs of `size` words `[^\\x20\\x09-\\x0D]+` in lower case (a shorter text is one n-gram of all its words), as a set.
Bands and rows follow from the recall wanted at the threshold: of all pairs (bands, rows) of at most `hashes` hash functions, the
one of most rows whose bands find a pair at the threshold with probability `recall`; the chance grows with similarity.

1. One pass over the texts gives each document a digest of its n-gram set and its band hashes. Equal sets are one class, whose
   representative is the smallest id; from here on there is one node per class, with the number of its documents.
2. A shuffle on (band, hash) finds buckets of two nodes or more. A node's home is the largest of its buckets, and each home joins the
   largest that it meets in a bucket, twice, so a group of near copies has one home or few. Homes that meet in a bucket are to be compared, each
   pair of homes once, however many buckets they share; homes without a common bucket are not, so texts that hang together only
   through many others are never compared.
3. The n-gram sets of nodes in buckets are built from the whole texts and dealt out in tiles: a home of m nodes makes blocks of about
   TILE nodes or TILE_BYTES bytes, and each pair of blocks of two homes to compare is one task, that counts common n-grams of all its pairs by
   sparse products. All pairs of nodes with a common bucket are among them, so large groups of near copies lose no link; nothing is
   capped or sampled.
4. Tiles give each node the number of documents it is linked to and the edges of a spanning forest of its links; those
   edges' components are the classes of the result.
Keys that many rows share (hubs of stars, sets with many copies, large classes) are few and broadcast instead of shuffled.

Output: class_id (the smallest id among all documents connected by links), copy_of (the smallest id of an equal n-gram set) and n_links, the
number of other documents with a similarity of the threshold or more, copies included.
Nulls: a null or empty text has no n-gram; all of these are equal to each other and similar to nothing else. Rows with equal ids are
documents of their own as far as their texts differ; a null id counts as a document, and classes of null ids alone have a null class.
Extra columns pass through; own columns of the outputs' names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small, small_batches, spread_join, words

TILE, TILE_BYTES = 256, 16 << 20
HEAVY = 1000  # rows of a key that is not shuffled; more, where there are more than HEAVY * HEAVY * 100 rows
NODE, BANDS, SIZE = "_jaccard_node", "_jaccard_bands", "_jaccard_size"  # own columns, under names that tables don't have
ODD = np.uint64(0x9E3779B97F4A7C15)


def banding(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows with which so many hashes reach the recall at the threshold."""
    best = None
    for rows in range(1, hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(log(1 - recall) / log(1 - p)))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so few hashes")
    return best


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def ngram_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, one after the other, and the n + 1 offsets of the texts in them."""
    distinct, codes, offsets = words(texts)
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.lower()) for w in distinct.to_pylist()), np.uint64, len(distinct))[codes]
    n = np.diff(offsets)
    text = np.repeat(np.arange(len(n)), n)
    grams, owner = [], []
    if len(h) >= size:
        whole = np.flatnonzero(text[size - 1 :] == text[: len(text) - size + 1])
        run = np.full(len(whole), size, np.uint64)
        for k in range(size):
            run = mix(run * ODD + h[whole + k])
        grams.append(run)
        owner.append(text[whole])
    for t in np.flatnonzero((n > 0) & (n < size)).tolist():
        run = np.full(1, n[t], np.uint64)
        for x in h[offsets[t] : offsets[t + 1]]:
            run = mix(run * ODD + x)
        grams.append(run)
        owner.append(np.array([t]))
    if not grams:
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    gram, text = np.concatenate(grams), np.concatenate(owner)
    at = np.searchsorted(text, np.arange(len(n) + 1)) if len(grams) == 1 else None
    if at is None:
        order = np.argsort(text, kind="stable")
        gram, text = gram[order], text[order]
        at = np.searchsorted(text, np.arange(len(n) + 1))
    out = [np.unique(gram[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
    return np.concatenate(out), np.concatenate(([0], np.cumsum([len(x) for x in out])))


class Hashes:
    """MinHash signatures, as hashes of bands."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(20_240_229)
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """A row of band hashes for each text; texts without n-grams have rows without meaning."""
        n = np.diff(at)
        filled = np.flatnonzero(n)
        out = np.zeros((len(n), self.bands), np.uint64)
        for band in range(self.bands):
            h = np.full(len(filled), band + 1, np.uint64)
            for k in range(band * self.rows, (band + 1) * self.rows):
                low = np.minimum.reduceat((grams * self.a[k] + self.b[k]) >> np.uint64(24), at[:-1][filled]) if len(filled) else h
                h = mix(h * ODD + low)
            out[filled, band] = h
        return out.view(np.int64)


def digest(grams: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(grams.tobytes()) if len(grams) else ""


def heavy_from(rows: int) -> int:
    """From how many rows on a key is heavy, so that there are at most 100,000 heavy keys."""
    return max(HEAVY, rows // 100_000)


def signatures(df: DataFrame, text: str, size: int, bands: int, rows: int) -> DataFrame:
    """df with NODE (a digest of the n-gram set, '' for none), SIZE (of the set) and BANDS instead of its text; no BANDS, if bands is 0."""
    small_batches(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{NODE} string", f"{SIZE} long"] + [f"{BANDS} array<long>"] * bool(bands))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = Hashes(bands, rows)
        for b in slices(batches, text):
            grams, at = ngram_sets(b.column(text), size)
            made = [pa.array([digest(grams[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)], pa.string()), pa.array(np.diff(at))]
            if bands:
                h = family.of(grams, at)
                made.append(pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1, dtype=np.int32) * bands), pa.array(h.ravel())))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + made, [*[f.name for f in kept], NODE, SIZE, BANDS][: len(kept) + len(made)])

    return df.mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the connected components of edges (a, b): each node's root is the smallest of its component. Alternates large
    and small stars, whose number grows with the logarithm of a component's size, until nothing changes. Hubs stay out of the shuffles."""
    edges = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, least = now, heavy_from(now[0])
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n")), "low")
        large = cut(spread_join(both.filter("b > a"), low, "a", F.col("n") >= least).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "stars")
        low = cut(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "low")
        kept = spread_join(large, low, "a", F.col("n") >= least).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(kept.unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().join(edges.select(F.col("a").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def linked(sets: list[np.ndarray], half: int, threshold: float) -> np.ndarray:
    """Which pairs (row, column) of sets reach the threshold: rows are the first half sets, columns the rest (all, if half is 0)."""
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    gram = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(owner) else owner
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    shared = np.bincount(gram)[gram] > 1 if len(gram) else np.zeros(0, bool)
    gram, owner = gram[shared], owner[shared]
    if len(gram):
        gram = np.cumsum(np.concatenate(([0], gram[1:] != gram[:-1])))
    left, right = (np.arange(half), np.arange(half, len(sets))) if half else (np.arange(len(sets)),) * 2
    common = np.zeros((len(left), len(right)), np.float32)
    for s in range(0, int(gram[-1]) + 1 if len(gram) else 0, 4096):
        a, b = np.searchsorted(gram, [s, s + 4096])
        dense = np.zeros((len(sets), 4096), np.float32)
        dense[owner[a:b], gram[a:b] - s] = 1
        common += dense[left] @ dense[right].T
    # |A & B| / |A | B| >= t, in whole numbers as far as they are whole
    union = size[left][:, None] + size[right][None] - common
    return (common >= threshold * union - 1e-6) & (common > 0)


def forest(links: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix of links the smallest node that it is connected to."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None], len(links)).min(axis=1, initial=len(links)))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


class Classes:
    """signed (the rows without texts, with NODE) and known (node, first, copies, n, root, low: the smallest id of a class), one row a node."""

    def __init__(self, df: DataFrame, key: str, text: str, size: int, threshold: float, recall: float, hashes: int):
        bands, rows = banding(threshold, recall, hashes)
        self.signed = cut(signatures(df, text, size, bands, rows), "signed")
        self.nodes = cut(self.signed.groupBy(F.col(NODE).alias("node")).agg(F.min(key).alias("first"), F.count("*").alias("copies"), F.first(BANDS).alias("bands"), F.first(SIZE).alias("size")), "nodes")
        links, final = verify(df.select(key, text), key, text, size, threshold, *self.homes())
        # the smallest id of each class, null ids last
        member = cut(final.join(self.nodes.select("node", "first"), "node"), "classes")
        by_root = cut(member.groupBy("root").agg(F.min("first").alias("low"), F.min(F.struct(F.col("first").isNull(), "first", "node")).getField("node").alias("keeper"), F.count("*").alias("m")), "roots")
        least = heavy_from(member.count())
        low = spread_join(member.select("node", "root"), by_root, "root", F.col("m") >= least).drop("m")
        counted = links.groupBy("node").agg(F.sum("n").alias("n"))
        self.known = cut(self.nodes.select("node", "first", "copies").join(counted, "node", "left").join(low, "node", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "low": F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")), "keeper": F.coalesce("keeper", "node")}), "known")

    def homes(self) -> tuple[DataFrame, DataFrame]:
        """((node, first, copies, home, blocks, block) of nodes in buckets of two or more; (a, b): homes to compare, a <= b)."""
        # rows of all bands are narrow: 16 bytes of a digest, and a bucket
        placed = cut(self.nodes.filter("node <> ''").select(F.unhex("node").alias("node"), F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket")), "placed")
        buckets = cut(placed.groupBy("bucket").agg(F.count("*").alias("m")).filter("m > 1"), "buckets")
        shared = spread_join(placed, buckets, "bucket", F.col("m") >= heavy_from(placed.count()))
        home = shared.groupBy("node").agg(F.max(F.struct("m", "bucket")).getField("bucket").alias("home"), F.collect_set("bucket").alias("buckets")).withColumn("node", F.lower(F.hex("node")))
        home = cut(home.join(self.nodes.select("node", "first", "copies", "size"), "node"), "homes")
        # a bucket whose members have k homes gives k * k / 2 pairs; as each of these homes is as large as the bucket, k is small
        met = home.select("home", F.explode("buckets").alias("bucket")).distinct().groupBy("bucket").agg(F.array_sort(F.collect_set("home")).alias("h"))
        other = F.transform("h", lambda x, i: F.struct(x.alias("a"), F.slice("h", i + 1, F.size("h") - i).alias("bs")))
        pairs = cut(met.select(F.explode(other).alias("x")).select("x.a", F.explode("x.bs").alias("b")).distinct(), "met")  # each home meets itself
        # each home joins the largest that it meets, twice, so that a group of near copies becomes one
        home = home.drop("buckets")
        for _ in range(2):
            count = cut(home.groupBy(F.col("home").alias("b")).agg(F.count("*").alias("m")), "counts")
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
            into = both.join(small(count), "b").groupBy("a").agg(F.max(F.struct("m", "b")).getField("b").alias("into"), F.count("*").alias("n"))
            into = cut(into.join(small(count.withColumnRenamed("b", "a")), "a"), "into")
            heavy = F.col("n") >= heavy_from(pairs.count())
            left = spread_join(pairs, into.drop("m"), "a", heavy).select(F.col("into").alias("x"), F.col("b").alias("a"))
            pairs = cut(spread_join(left, into.drop("m"), "a", heavy).select(F.least("x", "into").alias("a"), F.greatest("x", "into").alias("b")).distinct(), "met")
            home = cut(spread_join(home.withColumnRenamed("home", "a"), into, "a", F.col("m") >= heavy_from(home.count())).drop("a", "n", "m").withColumnRenamed("into", "home"), "homes")
        blocks = F.greatest(F.ceil(F.count("*") / TILE), F.ceil(8 * F.sum("size") / TILE_BYTES)).cast("int")
        sizes = cut(home.groupBy("home").agg(F.count("*").alias("m"), blocks.alias("blocks")), "sizes")
        member = spread_join(home, sizes, "home", F.col("m") >= heavy_from(home.count()))
        member = cut(member.select("node", "first", "copies", "home", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "members")
        return member, pairs


def join(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 128) -> DataFrame:
    """df without its text and with class_id, copy_of and n_links."""
    c = Classes(df.drop(*[x for x in ("class_id", "copy_of", "n_links") if x not in (key, text)]), key, text, size, threshold, recall, hashes)
    known = c.known.select(F.col("node").alias(NODE), F.col("low").alias("class_id"), F.col("first").alias("copy_of"), (F.col("n") + F.col("copies") - 1).cast("long").alias("n_links"), F.col("copies").alias("_jaccard_copies"))
    return spread_join(c.signed.drop(BANDS, SIZE), cut(known, "known"), NODE, F.col("_jaccard_copies") >= heavy_from(c.signed.count())).drop(NODE, "_jaccard_copies")


def verify(texts: DataFrame, key: str, text: str, size: int, threshold: float, member: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, n): documents linked to a node, by tile; (node, root): components of links)."""
    # texts of the representatives: found by id, told from other texts of the same id by their node
    wanted = small(cut(member.select(F.col("first").alias("_jaccard_first")).distinct(), "wanted"))
    found = texts.join(wanted, F.col(key).eqNullSafe(F.col("_jaccard_first")), "left_semi").select(text)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            grams, at = ngram_sets(b.column(text), size)
            own = [grams[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([digest(x) for x in own], pa.string()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "grams"])

    sets = cut(found.mapInArrow(build, "node string, grams binary").dropDuplicates(["node"]).join(member.drop("first"), "node"), "sets")
    # a node meets the other blocks of its own home (tiles i <= j), and all blocks of other homes
    home = sets.select("home", "blocks").distinct()
    left = pairs.join(home.select(F.col("home").alias("a"), F.col("blocks").alias("na")), "a").join(home.select(F.col("home").alias("b"), F.col("blocks").alias("nb")), "b")
    meets = cut(left.select(F.col("a").alias("home"), F.lit(False).alias("right"), "a", "b", F.col("nb").alias("others")).unionByName(left.filter("a <> b").select(F.col("b").alias("home"), F.lit(True).alias("right"), "a", "b", F.col("na").alias("others"))), "meets")
    numbers = F.sequence(F.lit(0), F.col("others") - 1)
    tile = F.when(F.col("a") == F.col("b"), F.transform(numbers, lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    tile = tile.when(F.col("right"), F.transform(numbers, lambda j: F.struct(j.alias("i"), F.col("block").alias("j")))).otherwise(F.transform(numbers, lambda j: F.struct(F.col("block").alias("i"), j.alias("j"))))
    tiled = sets.join(small(meets), "home").withColumn("t", F.explode(tile)).select("node", "copies", (F.col("right") | (F.col("block") == F.col("t.j")) & (F.col("a") == F.col("b")) & (F.col("t.i") < F.col("t.j"))).alias("right"), "grams", "a", "b", "t.i", "t.j")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        same = rows["a"].iloc[0] == rows["b"].iloc[0] and rows["i"].iloc[0] == rows["j"].iloc[0]
        rows = rows.sort_values(["right", "node"], kind="stable")
        names, copies = rows["node"].to_numpy(), rows["copies"].to_numpy()
        sets_ = [np.frombuffer(x, np.uint64) for x in rows["grams"]]
        half = 0 if same else int((~rows["right"]).sum())
        if len(sets_) < 2 or (not same and half in (0, len(sets_))):
            return pd.DataFrame({"node": names[:0], "n": copies[:0], "low": names[:0]})
        found = linked(sets_, half, threshold)
        links = np.zeros((len(names), len(names)), bool)
        if half:
            links[:half, half:] = found
            links |= links.T
        else:
            links = found
            np.fill_diagonal(links, False)
        return pd.DataFrame({"node": names, "n": links.astype(np.int64) @ copies, "low": names[forest(links)]})

    done = cut(tiled.groupBy("a", "b", "i", "j").applyInPandas(compare, "node string, n long, low string"), "tiles")
    return done.select("node", "n"), components(done.filter("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 128) -> DataFrame:
    """One row of df for each class, with df's columns: of the rows with the class's smallest id (null ids last), that whose n-gram set has the
    smallest digest, and one of those that are equal in both. Ids that one row has are judged by id; rows of repeated ids by their set, too."""
    c = Classes(df.select(key, text), key, text, size, threshold, recall, hashes)
    times = cut(c.signed.groupBy(key).agg(F.count("*").alias("n")), "ids")
    odd = small(cut(times.filter((F.col("n") > 1) | F.col(key).isNull()).select(F.col(key).alias("_jaccard_id")), "odd"))
    keepers = cut(c.known.filter("node = keeper").select(F.col("first").alias("_jaccard_id"), F.col("node").alias("_jaccard_keeper")), "keepers")
    plain = keepers.join(odd, "_jaccard_id", "left_anti")
    kept = df.join(small(cut(plain.select("_jaccard_id"), "kept")), F.col(key) == F.col("_jaccard_id"), "left_semi")
    if odd.isEmpty():
        return kept
    shown = "_jaccard_text"
    rows = signatures(df.join(odd, F.col(key).eqNullSafe(F.col("_jaccard_id")), "left_semi").withColumn(shown, F.col(text)), shown, size, 0, 0)
    one = rows.dropDuplicates([key, NODE]).join(small(keepers), F.col(key).eqNullSafe(F.col("_jaccard_id")) & (F.col(NODE) == F.col("_jaccard_keeper")), "left_semi")
    return kept.unionByName(one.select(*df.columns))
