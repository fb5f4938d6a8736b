"""Words and n-grams of whole texts, counted in Arrow batches before the shuffle.

A task cuts its texts into tokens as arrays of bytes, judges each distinct token once, numbers the words that it has met, and counts
n-grams as numbers; what goes to the shuffle is one row per n-gram of some million tokens, as one string, its words joined by spaces. The
results equal those of with_boundaries() and explode_grams().
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Script

#: Bytes of text that are cut at once, tokens that are counted at once, and rows of a batch for Spark.
SLICE_BYTES, CHUNK, OUT_ROWS = 4 << 20, 4_000_000, 100_000
#: Bytes of text whose n-grams of one size go to one partition of the shuffle: about a million.
PARTITION_BYTES = 6 << 20
COUNTS = "corpus string, n int, gram string, cnt long"
SPACE, LETTER, OTHER = 0, 1, 2


def plain(script: Script) -> bool:
    """Whether tokens are runs of a script's letters, or of what is neither letter nor space: others are left to expressions."""
    return script.tokens == rf"[{script.letters}]+|[^{script.letters}\s]+" and re.escape(script.repeater) == script.repeater


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts are long: Spark hands them to Python by this many at a time, unless the session says less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def table_of(body: str) -> np.ndarray:
    """For each code point, whether it is in a regular-expression class."""
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in re.finditer(f"[{body}]", every) if body else ():
        out[ord(m[0])] = True
    return out


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other (null: none), and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


class Cutter:
    """Cuts lower-case texts into tokens of one script."""

    def __init__(self, script: Script):
        self.script = script
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        self.kinds[table_of(script.letters)] = LETTER
        self.kinds[[9, 10, 11, 12, 13, 32]] = SPACE  # Java's \s
        self.consonants = table_of(script.consonants) if script.consonants else None

    def classes(self, raw: np.ndarray) -> np.ndarray:
        """The kind of the letter that each byte belongs to."""
        kind = self.kinds[:256][raw]
        lead = np.flatnonzero(raw >= 0xC0)
        if len(lead):
            first = raw[lead].astype(np.int64)
            more = 1 + (first >= 0xE0) + (first >= 0xF0)
            code = np.where(more == 1, first & 0x1F, np.where(more == 2, first & 0x0F, first & 0x07))
            for k in (1, 2, 3):
                code = np.where(more >= k, code << 6 | raw[np.minimum(lead + k, len(raw) - 1)] & 0x3F, code)
            own = self.kinds[code]
            for k in (0, 1, 2, 3):
                there = more >= k
                kind[lead[there] + k] = own[there]
        return kind

    def cut(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray, np.ndarray]:
        """The runs of letters of texts as a dictionary array, whether each goes on from the one before with only spaces between, the text of each,
        and their n + 1 offsets in their own bytes, one after the other."""
        raw, offsets = text_bytes(texts)
        if not len(raw):
            none = np.zeros(0, np.int64)
            return pa.array([], pa.string()).dictionary_encode(), none.astype(bool), none, np.zeros(1, np.int32)
        kind = self.classes(raw)
        letter = kind == LETTER
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], letter[:-1])) & ~edge[:-1]
        starts = np.flatnonzero(letter & ~before)
        after = np.concatenate((letter[1:], [False])) & ~edge[1:]
        ends = np.flatnonzero(letter & ~after) + 1
        text = np.searchsorted(offsets, starts, "right") - 1
        others = np.cumsum(kind == OTHER, dtype=np.int32)[starts]
        joined = np.zeros(len(starts), bool)
        joined[1:] = (text[1:] == text[:-1]) & (others[1:] == others[:-1])
        at = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(at), pa.py_buffer(raw[letter]))
        return words.dictionary_encode(), joined, text, at

    def valid(self, words: pa.Array) -> np.ndarray:
        """Which of some runs of letters are valid words: text.is_valid()."""
        script = self.script
        length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(length)
        starts = ends - length
        raw, _ = text_bytes(words)
        code = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        inside = np.ones(len(code), bool)
        inside[starts] = False
        same = np.concatenate(([False], code[1:] == code[:-1])) & inside
        run = same.copy()
        run[1:] &= same[:-1]
        run[2:] &= same[:-2]
        sums = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags)))[np.concatenate(([0], ends))])
        ok = (length >= script.shortest) & (length <= script.longest) & (sums(run) == 0) & (sums(inside & ~same) > 0)
        if script.repeater:
            ok &= ~pc.starts_with(words, script.repeater).to_numpy(zero_copy_only=False)
        if self.consonants is not None:
            ok &= sums(self.consonants[code]) > 0
        return ok


@lru_cache(4)
def cutter_of(script: Script) -> Cutter:
    return Cutter(script)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts hold about SLICE_BYTES; one longer text stands alone."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, side="right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def windows(codes: np.ndarray, at: np.ndarray, n: int, size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct n-grams that end at the places at, as a list of n columns of codes below size, and their counts."""
    if n == 1:
        found = np.bincount(codes[at], minlength=size)
        keys = np.flatnonzero(found)
        return [keys], found[keys]
    last = codes[at].astype(np.int64)
    if n == 2 or size**3 < 2**63:
        keys = codes[at - 1].astype(np.int64) * size + last
        if n == 3:
            keys += codes[at - 2].astype(np.int64) * size**2
        keys, found = distinct(keys)
        return [keys // size ** (n - 1 - k) % size for k in range(n)], found
    pairs, number = np.unique(codes[at - 2].astype(np.int64) * size + codes[at - 1], return_inverse=True)
    keys, found = distinct(number.astype(np.int64) * size + last)
    return [pairs[keys // size] // size, pairs[keys // size] % size, keys % size], found


def places(joined: np.ndarray, good: np.ndarray) -> dict[int, np.ndarray]:
    """Where n-grams of good tokens end, for each n."""
    two, three = (np.zeros(len(good), bool) for _ in range(2))
    two[1:] = joined[1:] & good[1:] & good[:-1]
    three[1:] = two[1:] & two[:-1]
    return {1: good, 2: two, 3: three}


def counter(script: Script, sizes: Sequence[int], totals: Sequence[int], vocabulary: Callable[[], pa.Array] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow, from (corpus, text), lower case, to COUNTS: the n-grams of the given sizes, those only whose words are in the vocabulary, if
    given; rows whose n-gram is null count all n-grams of the sizes in totals, whatever the vocabulary. Equal rows may come more than once."""
    schema = pa.schema([("corpus", pa.string()), ("n", pa.int32()), ("gram", pa.string()), ("cnt", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = cutter_of(script), vocabulary() if vocabulary else None
        names: list[str | None] = []
        held: list[tuple[pa.DictionaryArray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            parts = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
            words = parts.chunk(0).dictionary
            codes = np.concatenate([c.indices.to_numpy() for c in parts.chunks])
            joined, corpus = (np.concatenate([h[i] for h in held]) for i in (1, 2))
            held.clear()
            ok = cutter.valid(words)
            if totals:
                ends = places(joined, ok[codes])
                for n in totals:
                    found = np.bincount(corpus[ends[n]], minlength=len(names))
                    yield pa.record_batch([pa.array(names, pa.string()), pa.array([n] * len(names), pa.int32()), pa.nulls(len(names), pa.string()), pa.array(found, pa.int64())], schema=schema)
            if known is not None:
                ok &= pc.is_in(words, value_set=known).to_numpy(zero_copy_only=False)
            ends = places(joined, ok[codes]) if sizes else {}
            own = np.flatnonzero(ok)
            short = np.zeros(len(ok), np.int64)
            short[own] = np.arange(len(own))
            words, codes = words.take(pa.array(own)), short[codes]
            for n in sizes:
                for c, name in enumerate(names):
                    cols, found = windows(codes, np.flatnonzero(ends[n] & (corpus == c)), n, len(own))
                    for i in range(0, len(found), OUT_ROWS):
                        taken = [words.take(pa.array(k[i : i + OUT_ROWS])) for k in cols]
                        gram = taken[0] if n == 1 else pc.binary_join_element_wise(*taken, " ")
                        yield pa.record_batch([pa.array([name] * len(gram), pa.string()), pa.array(np.full(len(gram), n, np.int32)), gram, pa.array(found[i : i + OUT_ROWS], pa.int64())], schema=schema)

        tokens = 0
        for batch in slices(batches, "text"):
            of = batch.column("corpus").to_pylist()
            for name in dict.fromkeys(of):
                if name not in names:
                    names.append(name)
            number = {name: i for i, name in enumerate(names)}
            words, joined, text, _ = cutter.cut(batch.column("text"))
            if len(words):
                held.append((words, joined, np.array([number[x] for x in of], np.int32)[text]))
                tokens += len(words)
            if tokens >= CHUNK:
                yield from flush()
                tokens = 0
        if held:
            yield from flush()

    return run


def counted(texts: DataFrame, script: Script, sizes: Sequence[int], totals: Sequence[int] = (), vocabulary: list[str] | None = None) -> DataFrame:
    """COUNTS of texts (corpus, text), partly summed; see counter()."""
    spark = texts.sparkSession
    small_batches(spark)
    shared = None if vocabulary is None else spark.sparkContext.broadcast(vocabulary)
    own = None if shared is None else lambda: pa.array(shared.value, pa.string())
    return texts.select("corpus", F.lower("text").alias("text")).mapInArrow(counter(script, tuple(sizes), tuple(totals), own), COUNTS)


def liner(script: Script) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("corpus", pa.string()), ("t", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = cutter_of(script)
        for batch in slices(batches, "text"):
            words, joined, text, _ = cutter.cut(batch.column("text"))
            if not len(words):
                continue
            good = cutter.valid(words.dictionary)[words.indices.to_numpy()]
            two = places(joined, good)[2]
            own = np.flatnonzero(good)
            if not len(own):
                continue
            text = text[own]
            first = np.concatenate(([True], text[1:] != text[:-1]))
            # a token after a boundary has the boundary's empty line before it, but for the first of a text
            lead = pc.if_else(pa.array(~two[own] & ~first), "\n", "")
            line = pc.binary_join_element_wise(lead, words.dictionary.take(words.indices.take(pa.array(own))), "")
            starts = np.flatnonzero(first)
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(starts, len(own)), pa.int64()), line)
            yield pa.record_batch([batch.column("corpus").take(pa.array(text[starts])), pc.binary_join(lists, "\n").cast(pa.string())], schema=schema)

    return run


def lines(texts: DataFrame, script: Script) -> DataFrame:
    """(corpus, t) of texts (corpus, text) with a valid token: these, one a line, and an empty line for one boundary or more between two."""
    small_batches(texts.sparkSession)
    return texts.select("corpus", F.lower("text").alias("text")).mapInArrow(liner(script), "corpus string, t string")


def partitions(texts: DataFrame, sizes: int) -> int:
    """So many partitions that each holds about a million n-grams, by the bytes of all texts."""
    held = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), sizes * held // PARTITION_BYTES)
