"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of its labelled text accepts exactly that sample's substrings.
A text is parsed greedily: each phrase is the longest match that starts where the last one ended (one letter at least).
With c phrases over n letters and spaces and a sample of m, the normalised number is c * log2(m + 2) / n; the
language with the least wins, ties going to the name that sorts first. Blocks of BLOCK letters and spaces of all texts advance together as
numpy arrays, and are then joined so that phrases go on from block to block: the result is that of parsing letter by letter.

Normal form: code points that are letters, in lower case; each run of other characters is one space. Every letter of any sample has
a code of its own; letters that no sample has share one. Each language's automaton has an alphabet of its own, that of its sample; its
transitions are a full table where that is small, as with alphabets, and else a sorted list of (state, letter), as with Chinese.

Bounds: at most `docs_per_language` documents of a language are sampled (the smallest hashes of their key) and at most
`chars` letters of them are used, in whole texts where they fit, of texts that hold four times as many characters; an id counts once in a
language, with the text that sorts first. More than LANGUAGES languages are an error.
Nulls: a null text, or one without a letter, is `und` with score 0. Null languages teach nothing; no learned language at
all makes every text `und`. Repeated rows repeat; extra columns pass through, own columns lang_pred and score are replaced.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, cut, Shared, slices, small_batches

BLOCK, OVERRUN = 256, 1024
LANGUAGES = 2_000
LEAST = 200  # letters of a text that tells what is usual
FULL = 4_000_000  # the most entries of a full table of transitions of a language


def letter_table(sample: list[str]) -> np.ndarray:
    """The code of each code point: 0 for what is no letter, 1 for letters that the sample lacks, and one for each that it has."""
    own = {ch: i for i, ch in enumerate(sorted({ch.lower()[0] for ch in set().union(*sample) if ch.isalpha()}), 2)}
    table = np.zeros(0x110000, np.uint8 if len(own) < 254 else np.uint32)
    for cp in (x for r in (range(0xD800), range(0xE000, 0x110000)) for x in r):
        ch = chr(cp)
        if ch.isalpha():
            table[cp] = own.get(ch.lower()[0], 1)
    return table


def codes(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts in normal form, each with a space before it, and the n + 1 offsets of the texts in them."""
    texts = pc.fill_null(texts, "")
    n = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    points = np.frombuffer((" " + " ".join(texts.to_pylist())).encode("utf-32-le"), np.uint32) if len(texts) else np.zeros(0, np.uint32)
    found = table[points]
    keep = np.ones(len(found), bool)
    keep[1:] = (found[1:] > 0) | (found[:-1] > 0)
    start = np.concatenate(([0], np.cumsum(n)))[:-1]
    keep[start] = True
    return found[keep], np.concatenate(([0], np.cumsum(keep)))[np.concatenate((start, [len(found)]))]


def transitions(text: np.ndarray) -> list[dict[int, int]]:
    """The state after each code, for each state of the suffix automaton of text; 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] != length[p] + 1:
                twin = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = twin
                q = twin
            link[cur] = q
        last = cur
    return step


def suffix_automaton(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Transitions of the suffix automaton of text: next[state, code], -1 where the substring ends; 0 is the start."""
    step = transitions(text)
    out = np.full((len(step), alphabet), -1, np.int32)
    for s, d in enumerate(step):
        out[s, list(d.keys())] = list(d.values())
    return out


class Automaton:
    """The suffix automaton of one sample. States are row offsets: the number of the state times the size of the alphabet."""

    def __init__(self, text: np.ndarray, n_codes: int):
        letters = np.unique(text)
        # code 0 of its own is that of what the sample lacks
        self.own = np.zeros(n_codes, np.int32)
        self.own[letters] = np.arange(1, len(letters) + 1)
        self.width = width = len(letters) + 1
        step = transitions(self.own[text])
        n = len(step)
        self.full = self.keys = None
        if (n + 1) * width <= FULL:
            # the last state is that after a letter which the sample lacks: every match ends there
            self.full = np.full((n + 1) * width, -1, np.int32)
            for s, d in enumerate(step):
                for c, to in d.items():
                    self.full[s * width + c] = to * width
        else:
            pairs = sorted((s * width + c, to * width) for s, d in enumerate(step) for c, to in d.items())
            self.keys, self.to = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.restart = np.full(width, n * width, np.int32 if self.keys is None else np.int64)  # the state after the start has read the code
        for c, to in step[0].items():
            self.restart[c] = to * width

    def next(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The states after the codes, -1 where the substring ends."""
        if self.keys is None:
            return self.full[state + code]
        key = state + code
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], -1)


    def parse_blocks(self, codes_: np.ndarray, begin: np.ndarray, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where phrases start, if each block (the longest first; alive says how many are longer than each step) begins with one, and the
        states after the blocks."""
        starts = np.zeros(len(codes_), bool)
        state = np.zeros(len(begin), self.restart.dtype)
        starts[begin] = True
        for step in range(BLOCK):
            k = alive[step]
            if not k:
                break
            place = begin[:k] + step
            c = codes_[place]
            if not step:
                state[:] = self.restart[c]
                continue
            to = self.next(state[:k], c)
            ends = np.flatnonzero(to < 0)
            to[ends] = self.restart[c[ends]]
            starts[place[ends]] = True
            state[:k] = to
        return starts, state

    def parse(self, codes_: np.ndarray) -> int:
        """The number of phrases of one text, letter by letter."""
        if not len(codes_):
            return 0
        restart, n = self.restart.tolist(), 1
        if self.keys is None:
            step = memoryview(self.full)
            state = restart[codes_[0]]
            for c in codes_[1:].tolist():
                state = step[state + c]
                if state < 0:
                    state, n = restart[c], n + 1
            return n
        keys, to = memoryview(self.keys), memoryview(self.to)
        state = restart[codes_[0]]
        for c in codes_[1:].tolist():
            i = bisect_left(keys, state + c)
            if i < len(keys) and keys[i] == state + c:
                state = to[i]
            else:
                state, n = restart[c], n + 1
        return n


def joined(automaton: Automaton, codes_: np.ndarray, starts: np.ndarray, state: np.ndarray, begin: np.ndarray, end: np.ndarray, at: np.ndarray, text: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Phrases of each text, from those of its blocks. The last phrase of a block goes on into the next; from where one of the phrases after it
    starts on a start of the next block's own parse, both are the same. Parses that don't meet for OVERRUN letters, as in a long
    copy of the sample, are done again letter by letter."""
    stop = at[1:][text]
    run = np.flatnonzero(end < stop)
    place, now = end[run].copy(), state[run]
    more, meet = np.zeros(len(begin), np.int64), stop.copy()  # phrases after the block's last until the parses meet, and where
    for _ in range(OVERRUN):
        if not len(run):
            break
        c = codes_[place]
        to = automaton.next(now, c)
        ends = to < 0
        met = ends & starts[place]
        meet[run[met]] = place[met]
        more[run[ends & ~met]] += 1
        now = np.where(ends, automaton.restart[c], to)
        place = place + 1
        open_ = ~met & (place < stop[run])
        run, place, now = run[open_], place[open_], now[open_]
    total = np.zeros(len(n), np.int64)
    before = np.concatenate(([0], np.cumsum(starts)))
    here = np.arange(len(begin)) - first[text]
    entry = np.where(here > 0, np.concatenate(([0], meet[:-1])), begin)  # where the true parse meets that of the block
    total += np.bincount(text, weights=before[end] - before[np.minimum(entry, end)] + more, minlength=len(n)).astype(np.int64)
    # texts in which a block's phrases pass over the whole next one
    late = np.zeros(len(n), bool)
    late[text[run]] = True
    passed = np.unique(text[:-1][(text[1:] == text[:-1]) & (meet[:-1] >= end[1:]) & (end[1:] < stop[1:])])
    late[passed] = True
    for t in np.flatnonzero(late).tolist():
        total[t] = automaton.parse(codes_[at[t] : at[t + 1]])
    return total


class Model:
    """The automata of all languages."""

    def __init__(self, samples: dict[str, list[str]], chars: int):
        self.langs = sorted(samples)
        self.table = letter_table([t for lang in self.langs for t in samples[lang]])
        n_codes = int(self.table.max(initial=0)) + 1
        self.automata, self.bits, rest = [], [], []
        for lang in self.langs:
            found, at = codes(pa.array(samples[lang], pa.string()), self.table)
            use, left = [], chars
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s <= left or not use:
                    use.append(found[s : min(e, s + left)])
                    left -= len(use[-1])
                elif e - s >= LEAST:
                    rest.append((len(self.automata), found[s:e]))
            self.automata.append(Automaton(np.concatenate(use), max(n_codes, 2)))
            self.bits.append(np.log2(2 + chars - left))
        # what is usual: texts of the language that its automaton doesn't know
        self.usual = np.full(len(self.langs), np.inf)
        for j, automaton in enumerate(self.automata):
            own = [automaton.parse(automaton.own[x]) * self.bits[j] / len(x) for k, x in rest if k == j]
            if len(own) >= 10:
                self.usual[j] = max(own)

    def phrases(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Phrases of each text (rows) and language (columns)."""
        size = np.diff(at)
        n = -(-size // BLOCK)
        text = np.repeat(np.arange(len(size)), n)
        first = np.cumsum(n) - n
        begin = at[:-1][text] + (np.arange(len(text)) - first[text]) * BLOCK
        end = np.minimum(begin + BLOCK, at[1:][text])
        order = np.argsort(begin - end, kind="stable")
        alive = np.searchsorted((begin - end)[order], -np.arange(BLOCK), side="left")  # blocks longer than each step
        total = np.zeros((len(size), len(self.automata)), np.int64)
        for j, automaton in enumerate(self.automata):
            codes_ = automaton.own[found]
            starts, state = automaton.parse_blocks(codes_, begin[order], alive)
            last = np.empty(len(begin), state.dtype)
            last[order] = state
            total[:, j] = joined(automaton, codes_, starts, last, begin, end, at, text, first, n)
        return total

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The language, the score, and the normalised number of phrases as a share of the most that is usual in texts of that language."""
        found, at = codes(texts, self.table)
        letters = np.add.reduceat(np.concatenate((found > 0, [False])).astype(np.int64), at[:-1]) if len(texts) else np.zeros(0)
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        norm = self.phrases(found, at) * np.array(self.bits) / np.diff(at)[:, None]
        best = norm.argmin(axis=1)
        low = norm[np.arange(len(norm)), best]
        score = np.ones(len(norm))
        if len(self.langs) > 1:
            score = 1 - low / np.partition(norm, 1, axis=1)[:, 1]
        none = letters == 0
        return ["und" if z else self.langs[i] for z, i in zip(none, best, strict=True)], np.where(none, 0.0, np.clip(score, 0, 1)), np.where(none, 0.0, low / self.usual[best])


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", docs_per_language: int = 100, chars: int = 24_000) -> Model:
    """Learns from the labelled rows of docs."""
    rows = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, lang, text)
    if rows.select(lang).distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    keys = cut(bounded_sample(rows.select(key, lang), key, lang, docs_per_language), "sample").distinct()
    found = rows.join(F.broadcast(keys), [key, lang], "left_semi").groupBy(key, lang).agg(F.min(F.left(text, F.lit(4 * chars))).alias(text))
    order = Window.partitionBy(lang).orderBy("_hash", key)
    found = found.withColumn("_hash", F.xxhash64(key)).withColumn("_before", F.sum(F.length(text)).over(order) - F.length(text)).filter(F.col("_before") < 4 * chars)
    samples: dict[str, list[str]] = {}
    for r in found.orderBy("_hash", key, lang).collect():
        samples.setdefault(r[lang], []).append(r[text])
    return Model(samples, chars)


OUTPUTS = {"lang_pred": "string", "score": "double", "oddness": "double"}


def predict(df: DataFrame, model: Model, text: str = "text", keep_text: bool = True, outputs: tuple[str, ...] = ("lang_pred", "score")) -> DataFrame:
    """df with lang_pred and score, and with oddness if asked for: above 1, a text has more phrases than any that the fit saw of its language
    beyond the sample (0, where the fit saw fewer than ten of LEAST letters)."""
    small_batches(df.sparkSession)
    shared = Shared(df.sparkSession, model)
    kept = [f for f in df.schema.fields if f.name not in outputs and (keep_text or f.name != text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{x} {OUTPUTS[x]}" for x in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.open()
        for b in slices(batches, text):
            made = dict(zip(OUTPUTS, m.predict(b.column(text)), strict=True))
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(made[x]) for x in outputs], [*[f.name for f in kept], *outputs])

    return df.mapInArrow(run, schema)
