"""Toxicity scores by a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

Unit of evidence: the letters of a white-space separated chunk, between marks of its beginning and end (an accent becomes a sign after its
letter, other characters are dropped, digits that stand for letters replaced), or of a run of two or more chunks of one letter each, as
in `i d i o t` or `i - d - i - o - t`: chunks without letters don't end a run. Units longer than WIDTH signs become overlapping
windows, so that any WIDTH - STRIDE signs in a row stand in one. A sentence is as toxic as its worst unit, a text as its worst sentence.
Words cut into longer pieces, as in `idi ot`, are not joined.

Kernel: k(s, t) sums, over the LENGTHS of subsequences, the products of phi_u(s) * phi_u(t) over all subsequences u of so many signs, where
phi_u(s) adds DECAY ** span for each place of u in s, gaps included; each length is normalised by sqrt(k(s, s) k(t, t)) of its own.
Inserted or dropped letters thus weaken a match and don't end it. Nyström: with landmarks L (witnesses and the
worst innocent units, chosen for being unlike each other) and K = k(L, L), a unit's features are k(x, L) K^(-1/2), on
which a linear machine with squared hinge loss is fitted by Newton steps. As the kernel is a sum over subsequences, the
decision function sum_i b_i k(x, l_i) equals one table of weights per subsequence, by which all text is scored.

Training: sentences of labelled documents. A document's label says only that some sentence is toxic, so units that set
toxic documents apart are taken as witnesses first, then, round by round, the worst unit of each toxic document; units of
other documents are negative, the worst of them joining in each round. Witnesses with one letter inserted are positive, too, as often as
the witness itself is found.
Bounds: `documents` labelled documents of either class at most, those with the smallest hashes of their key, and `letters` of their texts;
texts that no longer fit are left out.

Null and empty texts, and texts without a unit of three letters, get the score of no evidence. Without labels of both classes
every score is 0. An id counts once, with its highest label and the text that sorts first; null labels don't count. Extra columns pass through; own columns score and predicted are replaced.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import ranges
from .common import labelled_texts, Shared, slices, small_batches, words

WIDTH, STRIDE = 20, 6
SHORT = 1  # letters of chunks that make runs
DECAY = 0.6
LENGTHS = (3, 4)
NOISY = 1.0  # what witnesses with an inserted letter weigh, in all, beside the witnesses
CODES = 32
START, END, ACCENT = 31, 30, 29  # stand before the first letter of a unit, after its last one, and after a letter with an accent
LOOKALIKE = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a"}  # fixed values


def fold_table() -> np.ndarray:
    """A code for each code point below U+0250: 1 to 26 for a to z, that plus 32 for those with an accent, 27 and 28 for other letters, 0 for the rest."""
    table = np.zeros(0x250, np.uint8)
    for cp in range(0x250):
        ch = LOOKALIKE.get(chr(cp), chr(cp)).lower()
        parts = unicodedata.normalize("NFD", ch)
        if "a" <= parts[:1] <= "z":
            table[cp] = ord(parts[0]) - 96 + 32 * (len(parts) > 1)
        elif ch.isalpha():
            table[cp] = 27 + cp % 2
    return table


FOLD = fold_table()


def fold(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all strings, one after the other, and how many each has. A string that has any letters stands between START and END, and
    ACCENT follows a letter that has one. Letters beyond the table have one of two codes."""
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    code = FOLD[np.minimum(points, 0x24F)]
    far = points >= 0x250
    code[far] = 27 + points[far] % 2
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    owner = np.repeat(np.arange(len(strings)), n)
    keep = code > 0
    code, owner = code[keep], owner[keep]
    last = np.concatenate((owner[1:] != owner[:-1], [True])) if len(owner) else np.zeros(0, bool)
    first = np.concatenate(([True], last[:-1])) if len(owner) else last
    size = 1 + (code > 32) + first + last  # codes that a letter makes
    at = np.cumsum(size) - size + first
    out = np.full(int(size.sum()), ACCENT, np.uint8)
    out[at] = code & 31
    out[at[first] - 1] = START
    out[(np.cumsum(size) - 1)[last]] = END
    return out, np.bincount(np.repeat(owner, size), minlength=len(strings))


class Units:
    """Distinct units of a slice of texts, as codes, and which text has which."""

    def __init__(self, texts: pa.Array):
        chunks, codes, offsets = words(texts)
        flat, n = fold(chunks.to_pylist())
        start = np.cumsum(n) - n
        self.n_texts = len(texts)
        # windows: a row (start, length) of flat for each; long chunks have several
        more = np.where(n > WIDTH, -(-(n - WIDTH) // STRIDE) + 1, 1) * (n > 4)
        chunk = np.repeat(np.arange(len(n)), more)
        k = ranges(np.zeros(len(n), np.int64), more)
        self.start = start[chunk] + np.minimum(k * STRIDE, np.maximum(n[chunk] - WIDTH, 0))
        self.length = np.minimum(n[chunk], WIDTH)
        self.flat = flat
        self.chunk = chunk
        self.codes, self.offsets, self.n_chunks = codes, offsets, len(n)
        # runs of short chunks: pieces of a further string, one run after the other; chunks without letters neither end a run nor belong to it
        self.run_text = np.zeros(0, np.int64)
        text = np.repeat(np.arange(len(texts)), np.diff(offsets))
        lettered = np.flatnonzero(n[codes] > 0)
        codes, text = codes[lettered], text[lettered]
        one = (n[codes] - 2 <= SHORT) if len(codes) else np.zeros(0, bool)
        same = np.concatenate((one[1:] & one[:-1] & (text[1:] == text[:-1]), [False])) if len(one) else one
        first = np.flatnonzero(one & ~np.concatenate(([False], same[:-1]))) if len(one) else np.zeros(0, np.int64)
        last = np.flatnonzero(one & ~same) if len(one) else first
        upto = np.concatenate(([0], np.cumsum(n[codes] - 2)))
        long = (last > first) & (upto[last + 1] - upto[first] >= 3)
        first, last = first[long], last[long]
        if len(first):
            chunks_ = codes[ranges(first, last - first + 1)]
            letters = flat[ranges(start[chunks_] + 1, n[chunks_] - 2)]
            size = upto[last + 1] - upto[first]
            at = np.cumsum(size) - size
            letters = np.insert(letters, np.concatenate((at, at + size)), np.repeat([START, END], len(at)).astype(np.uint8))
            at, size = at + 2 * np.arange(len(at)), size + 2
            more = np.where(size > WIDTH, -(-(size - WIDTH) // STRIDE) + 1, 1)
            run = np.repeat(np.arange(len(size)), more)
            k = ranges(np.zeros(len(size), np.int64), more)
            self.start = np.concatenate((self.start, len(flat) + at[run] + np.minimum(k * STRIDE, np.maximum(size[run] - WIDTH, 0))))
            self.length = np.concatenate((self.length, np.minimum(size[run], WIDTH)))
            self.flat = np.concatenate((flat, letters))
            self.run_text = text[first][run]

    def add(self, strings: list[bytes]) -> np.ndarray:
        """Further units of no text, as codes; returns their indices."""
        n = np.fromiter(map(len, strings), np.int64, len(strings))
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(strings), np.uint8)))
        self.start, self.length = np.concatenate((self.start, at)), np.concatenate((self.length, n))
        self.run_text = np.concatenate((self.run_text, np.full(len(strings), -1)))
        return np.arange(len(self.start) - len(strings), len(self.start))

    def worst(self, score: np.ndarray, least: float) -> np.ndarray:
        """The highest score of each text's units, least where it has none."""
        n = len(self.chunk)
        by_chunk = np.full(self.n_chunks, least)
        np.maximum.at(by_chunk, self.chunk, score[:n])
        out = np.full(self.n_texts, least)
        filled = np.flatnonzero(np.diff(self.offsets))
        if len(filled):
            out[filled] = np.maximum.reduceat(by_chunk[self.codes], self.offsets[:-1][filled])
        np.maximum.at(out, self.run_text[self.run_text >= 0], score[n:][self.run_text >= 0])
        return out

    def by_text(self) -> list[np.ndarray]:
        """Indices of the distinct units of each text."""
        order = np.argsort(self.chunk, kind="stable")
        n = np.bincount(self.chunk, minlength=self.n_chunks)
        at = np.cumsum(n) - n
        runs = len(self.chunk) + np.arange(len(self.run_text))
        out = []
        for t in range(self.n_texts):
            c = np.unique(self.codes[self.offsets[t] : self.offsets[t + 1]])
            out.append(np.concatenate((order[ranges(at[c], n[c])], runs[self.run_text == t])).astype(np.int64))
        return out

    def rows(self, pick: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(indices into pick, their codes as a matrix), a bounded number of units of one length at a time."""
        for n in np.unique(self.length[pick]).tolist():
            at = np.flatnonzero(self.length[pick] == n)
            for s in range(0, len(at), 4096):
                part = at[s : s + 4096]
                yield part, self.flat[self.start[pick[part]][:, None] + np.arange(n)].astype(np.int32)


def places(n: int, length: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """All ascending places of so many letters below n (a row for each letter), and DECAY ** span."""
    if (n, length) not in cache:
        rows = np.arange(n)[None]
        for _ in range(length - 1):
            more = n - 1 - rows[-1]
            rows = np.vstack((np.repeat(rows, more, axis=1), np.repeat(rows[-1] + 1, more) + ranges(np.zeros(len(more), np.int64), more)))
        cache[n, length] = rows, DECAY ** (rows[-1] - rows[0] + 1.0)
    return cache[n, length]


def subsequences(rows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of codes the number of each subsequence of so many letters, and the weights of the places."""
    at, w = places(rows.shape[1], length)
    key = rows[:, at[0]]
    for k in at[1:]:
        key = key * CODES + rows[:, k]
    return key, w


def norms(rows: np.ndarray) -> dict[int, np.ndarray]:
    """sqrt(k(s, s)) of each row for each length, by dynamic programming over pairs of positions."""
    n = rows.shape[1]
    match = (rows[:, :, None] == rows[:, None, :]) * np.float32(DECAY**2)
    part, out = match, {}
    for length in range(2, max(LENGTHS) + 1):
        run = np.zeros_like(part)  # run[i, j]: sum over i' < i, j' < j of part, decayed by the letters between
        for i in range(1, n):
            run[:, i] = DECAY * run[:, i - 1] + part[:, i - 1]
        both = np.zeros_like(part)
        for j in range(1, n):
            both[:, :, j] = DECAY * both[:, :, j - 1] + run[:, :, j - 1]
        part = match * both
        if length in LENGTHS:
            out[length] = np.maximum(np.sqrt(part.sum(axis=(1, 2))), 1e-12)
    return out


class Table:
    """Weights of subsequences, a column for each of several functions: a row for each subsequence that any of them knows, row 0 for all others."""

    def __init__(self, units: Units, pick: np.ndarray):
        """Normalised weights of the picked units themselves."""
        found: dict[int, list] = {x: [] for x in LENGTHS}
        for at, rows in units.rows(pick):
            norm = norms(rows)
            for x in LENGTHS:
                key, w = subsequences(rows, x)
                found[x].append((key.ravel(), np.repeat(at, key.shape[1]), (w[None] / norm[x][:, None]).ravel()))
        self.row = {x: np.zeros(CODES**x, np.int32) for x in LENGTHS}
        size, parts = 1, []
        for x in LENGTHS:
            key, column, w = (np.concatenate([f[i] for f in found[x]]) if found[x] else np.zeros(0, np.int64) for i in range(3))
            known, at = np.unique(key, return_inverse=True)
            self.row[x][known] = size + np.arange(len(known))
            parts.append((size + at, column, w))
            size += len(known)
        self.weights = np.zeros((size, len(pick)), np.float32)
        for r, c, w in parts:
            np.add.at(self.weights, (r, c), w)

    def combined(self, by: np.ndarray) -> Table:
        """One function: the sum of the columns, each times its share."""
        out = object.__new__(Table)
        out.row, out.weights = self.row, (self.weights @ by)[:, None].astype(np.float64)  # so that sums don't depend on what is summed beside them
        return out

    def products(self, units: Units, pick: np.ndarray) -> np.ndarray:
        """Kernel values of the picked units (rows) with each function (columns)."""
        columns = self.weights.shape[1]
        out = np.zeros((len(pick), columns))
        for at, rows in units.rows(pick):
            norm = norms(rows)
            for x in LENGTHS:
                n = places(rows.shape[1], x)[0].shape[1]
                step = max(1, (200_000 if columns == 1 else 4_000_000) // max(1, n * columns))
                for s in range(0, len(rows), step):
                    key, w = subsequences(rows[s : s + step], x)
                    index = self.row[x][key]
                    if columns == 1:
                        found = self.weights[:, 0][index] @ w
                        out[at[s : s + step], 0] += found / norm[x][s : s + step]
                    else:
                        out[at[s : s + step]] += np.einsum("nct,c->nt", self.weights[index], w.astype(np.float32)) / norm[x][s : s + step, None]
        return out


def newton(z: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> np.ndarray:
    """Weights, the last for a constant, of the linear machine with weighted squared hinge loss."""
    z = np.hstack((z, np.ones((len(z), 1))))
    weight = weight / weight.sum()
    v = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        inside = y * (z @ v) < 1
        zi, wi = z[inside], weight[inside]
        new = np.linalg.solve((zi * wi[:, None]).T @ zi + np.diag(penalty + 1e-12), zi.T @ (wi * y[inside]))
        if np.allclose(new, v, atol=1e-9):
            break
        v = new
    return v


class Model:
    """Weights of subsequences, a constant, and the scale of scores."""

    table: Table | None = None

    def fit(self, texts: list[str], labels: np.ndarray, landmarks: int = 64, rounds: int = 6) -> Model:
        labels = np.asarray(labels, bool)
        apart = np.arange(len(labels)) % 4 == 3  # these set the scale only
        if min((labels & apart).sum(), (~labels & apart).sum()) < 50:
            apart[:] = False
        if not (labels & ~apart).any() or labels[~apart].all():
            return self
        self.learn([t for t, x in zip(texts, apart, strict=True) if not x], labels[~apart], landmarks, rounds)
        apart = apart if apart.any() else ~apart
        units = Units(pa.array([t for t, x in zip(texts, apart, strict=True) if x], pa.string()))
        self.scale(units.worst(self.raw(units), self.constant), labels[apart])
        return self

    def learn(self, texts: list[str], labels: np.ndarray, landmarks: int, rounds: int) -> None:
        """Sets the weights of subsequences and the constant."""
        units = Units(pa.array(texts, pa.string()))
        of = units.by_text()
        bad = [of[t] for t in np.flatnonzero(labels)]
        good_all = np.unique(np.concatenate([of[t] for t in np.flatnonzero(~labels)]))
        # a unit's lift: the log likelihood ratio of that of its pieces which sets toxic documents most apart
        piece, begin, count = piece_ids(units)
        seen = np.zeros((2, int(piece.max(initial=0)) + 1), np.int64)
        for side, group in enumerate((bad, [of[t] for t in np.flatnonzero(~labels)])):
            for own in group:
                seen[side, np.unique(piece[ranges(begin[own], count[own])])] += 1
        ratio = likelihood_ratio(seen[0], seen[1], len(bad), int((~labels).sum()))
        by_unit = np.zeros(len(units.start))
        filled = count > 0
        by_unit[filled] = np.maximum.reduceat(ratio[piece], begin[filled])
        del piece
        witness = []
        for own in bad:
            if len(own):
                witness.append(own[by_unit[own] >= 0.95 * by_unit[own].max()][:8])
        # distinct strings among units, as windows of different chunks may be equal
        name = lambda u: bytes(units.flat[units.start[u] : units.start[u] + units.length[u]])
        order = np.array(sorted(good_all.tolist(), key=lambda u: (hash_name(name(u)), u)))
        good = order[:8000]
        hard = order[:32]
        common = Counter()
        for t in np.flatnonzero(~labels):
            common.update(map(name, of[t].tolist()))
        innocent = common.keys()
        often = np.ones(len(units.start))
        often[good_all] = np.sqrt([common[name(u)] for u in good_all.tolist()])
        boost = np.ones(len(often))
        for step in range(rounds):
            counts = Counter(name(u) for own in witness for u in own.tolist())
            one = {name(u): u for own in witness for u in own.tolist()}
            keys = [k for k in sorted(counts, key=lambda k: (-counts[k], k)) if k not in innocent] or sorted(counts)
            pos = np.array([one[k] for k in keys])
            pos_w = np.sqrt(np.array([counts[k] for k in keys], float))
            changed = [(v, counts[k]) for k in keys[:300] for v in inserted(k) if v not in innocent]
            noisy = units.add([v for v, _ in changed])
            noisy_w = np.array([c for _, c in changed], float)
            marks = np.concatenate((self.choose(units, pos, landmarks), self.choose(units, hard, landmarks)))
            tables = Table(units, marks)
            gram = tables.products(units, marks)
            val, vec = np.linalg.eigh((gram + gram.T) / 2)
            ok = val > 1e-4 * val.max()
            half = vec[:, ok] / np.sqrt(val[ok])
            pick = np.concatenate((pos, noisy, good))
            y = np.concatenate((np.ones(len(pos) + len(noisy)), -np.ones(len(good))))
            weight = np.concatenate((pos_w / pos_w.sum(), NOISY * noisy_w / max(1, noisy_w.sum()), 2.0 * (often * boost)[good] / (often * boost)[good].sum()))
            v = newton(tables.products(units, pick) @ half, y, weight)
            self.table = tables.combined(half @ v[:-1])
            self.constant = float(v[-1])
            if step < rounds - 1:
                score = self.raw(units)
                close = good_all[score[good_all] > -0.4]
                often, boost = (np.concatenate((x, np.ones(len(score) - len(x)))) for x in (often, boost))
                boost[close] *= 4  # what is mistaken weighs more in the next round
                worst = good_all[np.argsort(-score[good_all], kind="stable")[:3000]]
                good, hard = np.unique(np.concatenate((good, worst))), worst[:600]
                witness = [own[(score[own] >= 0.3) | (score[own] == score[own].max())] for own in bad if len(own)]

    @staticmethod
    def choose(units: Units, pos: np.ndarray, n: int) -> np.ndarray:
        """Landmarks: the first, then always the one least like those chosen."""
        pos = pos[:1000]
        near = Table(units, pos[:1]).products(units, pos)[:, 0] / len(LENGTHS)
        chosen = [0]
        while len(chosen) < min(n, len(pos)):
            nxt = int(near.argmin())
            if near[nxt] > 0.98:
                break
            chosen.append(nxt)
            near = np.maximum(near, Table(units, pos[nxt : nxt + 1]).products(units, pos)[:, 0] / len(LENGTHS))
        return pos[chosen]

    def scale(self, top: np.ndarray, labels: np.ndarray) -> None:
        """The cut that errs least on documents that taught nothing else becomes score 0.7."""
        order = np.argsort(top, kind="stable")
        t, y = top[order], labels[order]
        wrong = np.concatenate(([0], np.cumsum(y))) + (~y).sum() - np.concatenate(([0], np.cumsum(~y)))
        best = np.flatnonzero(wrong == wrong.min())
        low, high = t[max(best[0] - 1, 0)], t[min(best[-1], len(t) - 1)]
        self.cut = float(low + 0.5 * (high - low))
        spread = max(np.median(top[labels]) - self.cut, self.cut - np.median(top[~labels]), 1e-3)
        self.slope = 4.0 / spread

    def raw(self, units: Units) -> np.ndarray:
        """The decision function of all units."""
        return self.constant + self.table.products(units, np.arange(len(units.start)))[:, 0]

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.zeros(len(texts))
        units = Units(texts)
        top = units.worst(self.raw(units), self.constant)
        return 1 / (1 + np.exp(np.clip(-(self.slope * (top - self.cut) + np.log(0.7 / 0.3)), -50, 50)))


def piece_ids(units: Units) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of the pieces of all units, one unit after the other, where each begins and how many it has. Pieces are beginnings
    of 5 to 10 letters, whole units, and runs of 4 and of 6 letters."""
    parts, owners = [], []
    for at, rows in units.rows(np.arange(len(units.start))):
        n, found = rows.shape[1], []
        runs = [(0, k) for k in {*range(5, min(n, 10) + 1), n}] + [(i, k) for k in (4, 6) for i in range(n - k + 1)]
        for i, k in dict.fromkeys(runs):
            h = np.full(len(rows), k, np.uint64)
            for c in rows[:, i : i + k].T:
                h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(31)
            found.append(h)
        parts.append(np.stack(found, axis=1).ravel())
        owners.append(np.repeat(at.astype(np.int32), len(found)))
    if not parts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner, h = np.concatenate(owners), np.concatenate(parts)
    ids = np.unique(h, return_inverse=True)[1].astype(np.int32)
    count = np.bincount(owner, minlength=len(units.start))
    return ids[np.argsort(owner, kind="stable")], np.cumsum(count) - count, count


def likelihood_ratio(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Of a in n against b in m, where a is more frequent (else 0)."""
    with np.errstate(divide="ignore", invalid="ignore"):
        log = lambda k, p: np.where(k > 0, k * np.log(p), 0.0)
        part = lambda k, size, p: log(k, p) + log(size - k, 1 - p)
        p = (a + b) / (n + m)
        found = part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p)
    return np.where(a * m > b * n, found, 0.0)


def inserted(unit: bytes, n: int = 4) -> list[bytes]:
    """The unit with one more letter inside, n times, always the same for the same unit."""
    rng = np.random.default_rng(hash_name(unit))
    at = rng.integers(2, len(unit), n)
    return [(unit[:i] + bytes([c]) + unit[i:])[:WIDTH] for i, c in zip(at.tolist(), rng.integers(1, 27, n).tolist(), strict=True)]


def hash_name(b: bytes) -> int:
    return zlib.crc32(b)


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = 1500, letters: int = 20_000_000) -> Model:
    """Learns from the texts of labelled documents."""
    texts, known = labelled_texts(docs, labels, key, text, label, documents, letters)
    return Model().fit(texts, known)


def predict(df: DataFrame, model: object, threshold: float = 0.7, text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with score and predicted, by any model with score(texts)."""
    small_batches(df.sparkSession)
    shared = Shared(df.sparkSession, model)
    kept = [f for f in df.schema.fields if f.name not in ("score", "predicted") and (keep_text or f.name != text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + ["score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.open()
        for b in slices(batches, text):
            score = m.score(b.column(text)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*[f.name for f in kept], "score", "predicted"])

    return df.mapInArrow(run, schema)
