"""Quality rules whose thresholds come from mergeable quantile sketches of each language and source.

Sketch: a value x falls into bucket ceil(log(x + 1/1000) / log(1.02)), a logarithmic grid with 1 % relative error. A sketch
is a table of (group, measure, bucket, count); sketches of parts merge by adding counts, which Spark does partly before
its shuffle, so no group is ever gathered in one task. Quantiles follow from running counts over at most ~1100 buckets.

Threshold of a measure in a group, over the documents that pass the base rule: its upper quantile (0.75, or 0.95 where most texts
have nothing of it and some have much) plus `reach` times the distance from its 0.5 quantile (or a twentieth of that quantile, if
that is more). No threshold has a floor; instead a text's own count is reduced by what one occurrence gives, so that a group of
nothing but zeros tolerates that and no more. Word lengths have a lower limit as well, by the 0.25 quantile. Groups of fewer than
`least` such documents take the threshold of their language, and those of rare languages the one of all documents.

Nulls: a null text has no words; null languages and sources form groups of their own. Empty texts fail the base rule.
Repeated rows count each time. Extra columns pass through; own columns of the input with the same names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, per_text, slices, small, small_batches, text_bytes, words

#: Spaces (20, 09-0D in hexadecimal) and symbols of the base rule, and the marks that a further measure counts.
SPACES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?|#*$%&<>=_~^/@+"

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_marks long, n_upper long, n_lines long"
#: Measures under adaptive thresholds: (name, numerator, denominator, count of one occurrence, upper quantile). One repeat makes two
#: windows of three words; marks come in pairs.
MEASURES = [
    ("symbol_share", "n_symbols", "word_chars", 1, 0.75),
    ("mark_share", "n_marks", "word_chars", 2, 0.75),
    ("upper_share", "n_upper", "word_chars", 1, 0.75),
    ("repeat_share", "n_repeat_words", "n_words", 6, 0.95),
    ("dup_line_share", "n_dup_lines", "n_lines", 1, 0.95),
    ("word_length", "word_chars", "n_words", 0, 0.75),
]
BOTH_SIDES = ["word_length"]
REACH = 10.0


def doubled(keys: np.ndarray) -> np.ndarray:
    """For each key whether it occurs twice or more."""
    found = np.sort(keys)
    found = found[1:][found[1:] == found[:-1]]
    if not len(found):
        return np.zeros(len(keys), bool)
    found = found[np.concatenate(([True], found[1:] != found[:-1]))]
    return found[np.minimum(np.searchsorted(found, keys), len(found) - 1)] == keys


def counted(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each text the number of its bytes that the mask marks."""
    return np.diff(np.searchsorted(np.flatnonzero(mask), at))


def repeats(codes: np.ndarray, offsets: np.ndarray, n_codes: int) -> np.ndarray:
    """For each text the number of words that stand in a 3-word window found twice or more in the text."""
    n = len(codes)
    out = np.zeros(len(offsets) - 1, np.int64)
    if n < 3:
        return out
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    starts = np.flatnonzero(text[2:] == text[:-2])
    if not len(starts):
        return out
    a = codes.astype(np.int64)
    key = a[starts] * n_codes + a[starts + 1]
    # exact keys: pairs are numbered before the third word joins, and triples before the text does
    for more, size in ((a[2:], n_codes), (text, len(out))):
        often = doubled(key)  # most windows stand alone and leave here
        starts, key = starts[often], key[often]
        if key.max(initial=0) >= 2**62 // size:
            key = np.unique(key, return_inverse=True)[1]
        key = key * size + more[starts]
    twice = starts[doubled(key)]
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[twice + k] = True
    return per_text(hit, offsets)


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of STATS for whole texts."""
    raw, at = text_bytes(texts)
    other, symbol, mark, upper = (np.zeros(256, bool) for _ in range(4))
    other[128:192] = True  # bytes that continue a code point
    other[list(SPACES)] = symbol[list(SYMBOLS)] = mark[list(MARKS)] = upper[65:91] = True
    big = upper[raw]
    accented = np.flatnonzero(raw[:-1] == 0xC3)
    big[accented[(raw[accented + 1] <= 0x9E) & (raw[accented + 1] != 0x97)]] = True  # À to Þ without the multiplication sign, in UTF-8
    distinct, codes, offsets = words(texts)
    dups, lines = [], []
    for t in texts.to_pylist():
        own = [x for x in (t or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        lines.append(len(own))
        dups.append(len(own) - len(set(own)))
    return {
        "n_words": np.diff(offsets), "word_chars": np.diff(at) - counted(other[raw], at), "n_symbols": counted(symbol[raw], at), "n_dup_lines": np.array(dups, np.int64),
        "n_repeat_words": repeats(codes, offsets, len(distinct)), "n_marks": counted(mark[raw], at), "n_upper": counted(big, at), "n_lines": np.array(lines, np.int64),
    }


def with_stats(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with the columns of STATS, by default without its text."""
    own = {x.split()[0] for x in STATS.split(", ")}
    df = df.select(*[c for c in df.columns if c not in own or c == text])
    rest = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + [STATS])

    small_batches(df.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            found = measure(b.column(text))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in rest] + [pa.array(v.astype(np.int64)) for v in found.values()], [f.name for f in rest] + list(found))

    return df.mapInArrow(run, schema)


def share(num: str, den: str, less: int = 0) -> F.Column:
    return F.coalesce(F.try_divide(F.col(num).cast("double") - less, F.col(den).cast("double")), F.lit(0.0))


def base_rule() -> F.Column:
    """Whether a row of stats fails the base rule."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


GRID = 1.02


def sketch(stats: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, measure, bucket, n): mergeable by adding n."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.ceil(F.log(share(a, b) + F.lit(0.001)) / F.log(F.lit(GRID))).cast("int").alias("bucket")) for m, a, b, *_ in MEASURES]))
    return stats.select(*groups, each.alias("e")).groupBy(*groups, "e.measure", "e.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], at: tuple[float, ...] = (0.5, 0.75)) -> DataFrame:
    """(groups, measure, n, q0, q1, ...) of merged sketches."""
    merged = sketches.groupBy(*groups, "measure", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*groups, "measure")
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    value = F.pow(F.lit(GRID), F.col("bucket") - 0.5) - F.lit(0.001)
    return run.groupBy(*groups, "measure").agg(F.max("all").alias("n"), *[F.greatest(F.lit(0.0), F.min(F.when(F.col("upto") >= F.col("all") * q, value))).alias(f"q{i}") for i, q in enumerate(at)])


def thresholds(stats: DataFrame, reach: float, least: int) -> DataFrame:
    """One row for each language and source: lang, source, a limit max_ for each measure and min_ for those of both sides."""
    base = cut(sketch(stats.filter(~base_rule()), ["lang", "source"]), "sketch")
    far = F.create_map(*[F.lit(x) for m, *_, q in MEASURES for x in (m, q)])[F.col("measure")]

    def limits(groups: list[str], n: int) -> DataFrame:
        top = F.when(far == 0.95, F.col("q3")).otherwise(F.col("q2"))
        spread = lambda end: F.greatest(F.abs(end - F.col("q1")), 0.05 * end)
        pair = F.struct((top + reach * spread(top)).alias("high"), (F.col("q0") - reach * spread(F.col("q0"))).alias("low"))
        names = [F.col(c).alias(c if not n else f"{c}{n}") for c in [*groups, "measure"]]
        return quantiles(base, groups, (0.25, 0.5, 0.75, 0.95)).select(*names, F.col("n").alias(f"n{n}"), pair.alias(f"l{n}"))

    fine, mid, top = limits(["lang", "source"], 0), limits(["lang"], 1), limits([], 2)
    both = fine.join(mid, F.col("lang").eqNullSafe(F.col("lang1")) & (F.col("measure") == F.col("measure1")), "left").join(F.broadcast(top), F.col("measure") == F.col("measure2"), "left")
    chosen = F.when(F.col("n0") >= least, F.col("l0")).when(F.col("n1") >= least, F.col("l1")).otherwise(F.col("l2"))
    of = lambda m, side: F.max(F.when(F.col("measure") == m, chosen[side]))
    return both.groupBy("lang", "source").agg(*[of(m, "high").alias(f"max_{m}") for m, *_ in MEASURES], *[of(m, "low").alias(f"min_{m}") for m in BOTH_SIDES])


def limit_columns(columns: list[str]) -> list[str]:
    return [c for c in columns if c.startswith(("max_", "min_"))]


def judged(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """stats with the limits of each row's group, base_failed and kept."""
    other = limits.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *limit_columns(limits.columns))
    joined = stats.drop(*limit_columns(limits.columns)).join(small(other), F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    failed = base_rule()
    within = F.lit(True)
    for m, a, b, one, _ in MEASURES:
        within &= share(a, b, one) <= F.coalesce(F.col(f"max_{m}"), F.lit(float("inf")))
        if m in BOTH_SIDES:
            within &= share(a, b) >= F.coalesce(F.col(f"min_{m}"), F.lit(0.0))
    return joined.withColumn("base_failed", failed).withColumn("kept", ~failed & within)


def judge(df: DataFrame, reach: float = REACH, least: int = 50) -> DataFrame:
    """df's columns without text, STATS, the limits of the row's group, base_failed and kept."""
    stats = cut(with_stats(df), "stats")
    return judged(stats, cut(thresholds(stats, reach, least), "limits"))


def keep(df: DataFrame, reach: float = REACH, least: int = 50) -> DataFrame:
    """The rows of df that judge() keeps, with df's columns. Texts are measured once more where they lie, so none is shuffled."""
    stats = cut(with_stats(df.select("text", "lang", "source")), "stats")
    limits = cut(thresholds(stats, reach, least), "limits")
    own = [x.split()[0] for x in STATS.split(", ")]
    clash = {c: f"_own_{c}" for c in df.columns if c in [*own, "base_failed", "kept"] or c in limit_columns(df.columns)}
    named = df.withColumnsRenamed(clash)
    kept = judged(with_stats(named, keep_text=True), limits).filter("kept").select(*named.columns)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()})
