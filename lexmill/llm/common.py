"""What several operators share: the shared folder, cut lineage, bounded samples, words as arrays."""

from __future__ import annotations

import contextlib
import ctypes
import pickle
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..store import cut

#: Python works on slices of about so many bytes of text, whatever the size of Spark's batches.
SLICE_BYTES = 6 << 20
#: A table of at most so many rows, and bytes, may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def is_small(df: DataFrame) -> bool:
    """Whether df (already cut) has few enough rows, counted, and few enough bytes in its texts to be broadcast."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema.fields if f.dataType.typeName() in ("string", "binary")]
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(reduce(add, wide, F.lit(0))), F.lit(0))).first()
    return n <= BROADCAST_ROWS and held + 8 * n * len(df.columns) <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df (already cut), marked for broadcast if it is small; else as it is, for a shuffled join."""
    return F.broadcast(df) if is_small(df) else df


def spread_join(rows: DataFrame, keyed: DataFrame, key: str, heavy: F.Column) -> DataFrame:
    """Inner join of rows with keyed (one row a key; both cut). If keyed is not small, keys that heavy marks are broadcast, so their many rows
    stay where they lie, and the others are joined by a shuffle. heavy must mark so many rows of a key that there can't be more than
    100,000 such keys."""
    if is_small(keyed):
        return rows.join(F.broadcast(keyed), key)
    hot = F.broadcast(keyed.filter(heavy))
    rest = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(~heavy), key)
    return rows.join(hot, key).unionByName(rest)


class Shared:
    """An object of this package, sent once to each executor; open() gives a task its copy."""

    def __init__(self, spark: SparkSession, value: object):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def open(self):
        return pickle.loads(self.sent.value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, n: int) -> F.Column:
    """crc32 of the key as text, modulo n (null for a null key)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int) -> DataFrame:
    """At most per_stratum rows of each stratum: those with the smallest hash of key, whatever the partitions.

    Counts of each stratum, joined back, give a hash threshold that leaves about one and a half times the bound, so that only
    a bounded remainder is ranked. df should hold only key, stratum and what is cheap to scan twice.
    """
    share = F.least(F.lit(1.0), F.lit(1.5 * per_stratum + 50) / F.col("_n"))
    top = F.when(share >= 1, F.lit(2**63 - 1)).otherwise((share * float(2**64) - float(2**63)).cast("long"))
    counts = small(cut(df.groupBy(F.col(stratum).alias("_s")).agg(F.count("*").alias("_n")).select("_s", top.alias("_top")), "strata"))
    low = df.withColumn("_h", F.xxhash64(key)).join(counts, F.col(stratum).eqNullSafe(F.col("_s"))).filter(F.col("_h") <= F.col("_top"))
    w = F.row_number().over(Window.partitionBy(stratum).orderBy("_h", key))
    return low.withColumn("_r", w).filter(F.col("_r") <= per_stratum).select(*df.columns)


def labelled_texts(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, documents: int, letters: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels (0 or 1) of a bounded sample: at most so many documents of each class and so many letters of their texts, in the order of
    a hash of their key. Texts stay whole; one that no longer fits is left out. An id counts once: with its highest label, and with the
    text that sorts first."""
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max((F.col(label) == 1).cast("int")).alias("_label"))
    sample = cut(bounded_sample(cut(known, "labels"), key, "_label", documents), "sample")
    found = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_text")).join(F.broadcast(sample), key).groupBy(key, "_label").agg(F.min("_text").alias("_text"))
    order = Window.partitionBy("_label").orderBy("_hash", key)
    found = found.withColumn("_hash", F.xxhash64(key)).withColumn("_sum", F.sum(F.length("_text")).over(order)).filter(F.col("_sum") <= letters)
    rows = found.orderBy("_hash", key).select("_text", "_label").collect()
    return [r["_text"] for r in rows], np.array([r["_label"] for r in rows], np.int64)


def tidy() -> None:
    """Gives memory that Python no longer uses back to the machine: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # C libraries without it keep theirs
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Spark hands them to Python by this many at a time, unless the session says less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about max_bytes; one longer text stands alone."""
    tidy()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        at = 0
        while at < n:
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + max_bytes, side="right"))
            to = max(to, at + 1)
            yield batch.slice(at, to - at)
            at = to
        del batch
        tidy()


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other (null: none), and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words `[^\\x20\\x09-\\x0D]+`, the code of each word in order, and the n + 1 offsets of the texts in the codes."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = parts.flatten()
    filled = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    before = np.concatenate(([0], np.cumsum(filled)))
    coded = flat.filter(pa.array(filled)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), before[starts]


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values of each text."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def padded(strings: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of strings no longer than width, as rows of a matrix padded with 0, and their lengths."""
    a = np.array(strings, dtype=f"<U{width}")
    return a.view(np.uint32).reshape(len(strings), width), np.char.str_len(a)
