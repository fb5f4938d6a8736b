"""Byte-level BPE with word ends: encoding and decoding with the vocabulary file of a public tokenizer.

Merging: the ranks of a word's adjacent pairs are the leaves of a segment tree of minima, each leaf holding
rank * width + position. The root is the leftmost pair of the lowest rank; a merge updates three leaves and the nodes
above them, and merging ends when the root holds no rank. Trees of many words of like length advance together, as rows of
one matrix, which changes neither the order of merges within a word nor the result; a tree that stands alone is a list. Words of more than
LONG bytes are first cut between bytes that stand side by side in no piece of the vocabulary, as no merge ever joins them.

Words (white-space separated chunks) repeat, so a worker remembers the ids of chunks, up to KNOWN of them; memory is bounded
by that and by the slice of texts at hand. Only the vocabulary (about 2 MB) travels to executors.

Ids equal the library's for every code point (a test asks it): its letters and numbers are those of Unicode 15.1, as Python 3.13 has them,
and some later ones, stated below.
Nulls and empty texts have no tokens and decode to ''. A text without white space is one long chunk: exact, only slower.
Repeated rows repeat; extra columns pass through, and own columns of the same names as outputs are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Shared, slices, small_batches, words

#: What counts as white space (as escapes of a character class), and the contractions that are pieces.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"


#: Letters and numbers that the library knows beyond Unicode 15.1, as ranges, and capitals with how far their small letters are.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
#: Marks of Unicode 10 and later, which the library's composition takes for letters of their own.
NEW_MARKS = [(0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA), (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC), (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B), (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943), (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42), (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F), (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF)]
NEW_CAPITALS = [(0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, 0x264 - 0xA7CB), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, 0x19B - 0xA7DC), (0x10D50, 0x10D65, 0x20), (0x16EA0, 0x16EB8, 0x1B)]
SMALL = {i: i + by for a, b, by in NEW_CAPITALS for i in range(a, b + 1)}
MARKS = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEW_MARKS) + "])")
CAPITALS = re.compile("[" + "".join(map(chr, SMALL)) + "]")


def code_points(kind: str, new: list[tuple[int, int]]) -> str:
    """The code points of a general category (by its first letter) beyond ASCII and the new ones, as ranges of a character class."""
    more = {i for a, b in new for i in range(a, b + 1)}
    inside = [i > 0x7F and (unicodedata.category(chr(i))[0] == kind or i in more) for i in range(0x110000)] + [False]
    edges = [i for i in range(0x80, 0x110001) if inside[i] != inside[i - 1]]
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2], edges[1::2], strict=True))


def piece_pattern() -> re.Pattern:
    letters, numbers = "a-zA-Z" + code_points("L", NEW_LETTERS), "0-9" + code_points("N", NEW_NUMBERS)
    return re.compile(f"{CONTRACTIONS}|[{letters}]+|[{numbers}]|[^{WHITE}{letters}{numbers}]+")


PIECES = piece_pattern()
ASCII_PIECES = re.compile(CONTRACTIONS + r"|[a-z]+|[0-9]|[^" + WHITE + r"a-z0-9]+", re.ASCII)
NONE = np.int64(2**62)
CELLS = 1 << 17  # of a matrix of trees
LONG = 4096  # bytes
ALONE = 12  # so many trees of one width are cheaper one by one
KNOWN = 150_000  # chunks whose ids a worker remembers, about 30 MB; then it begins anew


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself where it prints, else the next free one from U+0100 on."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its count says."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


class Model:
    """A vocabulary: pieces by id, merge ranks by pair, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        m, letters = j["model"], byte_letters()
        end = m["end_of_word_suffix"]
        vocab = m["vocab"]
        self.added = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.texts = [""] * (1 + max([*vocab.values(), *self.added.values()]))
        for k, v in [*vocab.items(), *self.added.items()]:
            self.texts[v] = k
        self.first = np.array([vocab[x] for x in letters], np.int64)
        self.last = np.array([vocab[x + end] for x in letters], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in m["merges"]]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.full(1 << self.bits, NONE, np.int64)
        slot = self.slot(keys)
        for k, rank, s in zip(keys.tolist(), range(len(keys)), slot.tolist(), strict=True):
            while self.keys[s] >= 0:
                s = s + 1 & (1 << self.bits) - 1
            self.keys[s], self.ranks[s] = k, rank
        self.beside = np.zeros((256, 256), bool)  # bytes that stand side by side in a piece
        spelled = {x: b for b, x in enumerate(letters)}
        for k in vocab:
            own = np.array([spelled[x] for x in k.removesuffix(end)], np.int64)
            self.beside[own[:-1], own[1:]] = True
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pairs: dict[int, int] | None = None
        self.forget()
        self.decimal = np.array([f"{i} ".encode() for i in range(len(self.texts))])
        self.spelled = np.array([f"{t} ".encode() for t in self.texts])

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs of ids, NONE where there is none."""
        key = left << 32 | right
        at = self.slot(key)
        out = np.where(self.keys[at] == key, self.ranks[at], NONE)
        todo = np.flatnonzero((self.keys[at] != key) & (self.keys[at] >= 0))
        while len(todo):
            at[todo] = at[todo] + 1 & (1 << self.bits) - 1
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def merge(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids after all merges and which cells still hold one. ids: a row for each word, as wide as a power of two."""
        n, width = ids.shape
        cell = np.arange(width)
        after = np.where(cell[None] + 1 < length[:, None], cell[None] + 1, width)
        before = np.broadcast_to(cell - 1, ids.shape).copy()
        alive = cell[None] < length[:, None]
        tree = np.full((n, 2 * width), NONE)
        r, c = np.nonzero(after < width)
        found = self.rank(ids[r, c], ids[r, c + 1])
        tree[r, width + c] = np.where(found < NONE, found * width + c, NONE)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        ids, after, before, alive_, tree = ids.reshape(-1), after.reshape(-1), before.reshape(-1), alive.reshape(-1), tree.reshape(-1)
        row = np.flatnonzero(tree[1 :: 2 * width] < NONE)
        while len(row):
            root = tree[row * 2 * width + 1]
            pos, made = root % width, self.made[root // width]
            base, top = row * width, row * 2 * width
            at = base + pos
            gone = after[at]
            nxt = after[base + gone]
            prev = before[at]
            ids[at], after[at], alive_[base + gone] = made, nxt, False
            has = nxt < width
            before[(base + nxt)[has]] = pos[has]
            self.put(tree, top, width, gone, NONE)
            right = np.full(len(row), NONE)
            right[has] = self.rank(made[has], ids[(base + nxt)[has]])
            self.put(tree, top, width, pos, np.where(right < NONE, right * width + pos, NONE))
            has = prev >= 0
            if has.any():
                left = self.rank(ids[(base + prev)[has]], made[has])
                self.put(tree, top[has], width, prev[has], np.where(left < NONE, left * width + prev[has], NONE))
            row = row[tree[top + 1] < NONE]
        return ids.reshape(n, width), alive

    def merge_alone(self, ids: list[int]) -> list[int]:
        """The same for one word, with its tree as a list."""
        n = len(ids)
        shift = max(1, (n - 1).bit_length())
        width, none = 1 << shift, int(NONE)
        if self.pairs is None:
            held = self.keys >= 0
            self.pairs = dict(zip(self.keys[held].tolist(), self.ranks[held].tolist(), strict=True))
        rank, made = self.pairs.get, self.made
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank(ids[i] << 32 | ids[i + 1])
            if r is not None:
                tree[width + i] = r << shift | i
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n

        def put(leaf: int, value: int) -> None:
            node = leaf + width
            tree[node] = value
            while node > 1:
                other = tree[node ^ 1]
                node >>= 1
                if other < value:
                    value = other
                if tree[node] == value:
                    return
                tree[node] = value

        while tree[1] < none:
            pos = tree[1] & width - 1
            new = int(made[tree[1] >> shift])
            gone = after[pos]
            nxt, prev = after[gone], before[pos]
            ids[pos], after[pos], alive[gone] = new, nxt, False
            put(gone, none)
            r = None
            if nxt < n:
                before[nxt] = pos
                r = rank(new << 32 | ids[nxt])
            put(pos, none if r is None else r << shift | pos)
            if prev >= 0:
                r = rank(ids[prev] << 32 | new)
                put(prev, none if r is None else r << shift | prev)
        return [x for x, a in zip(ids, alive, strict=True) if a]

    @staticmethod
    def put(tree: np.ndarray, top: np.ndarray, width: int, leaf: np.ndarray, value: np.ndarray | np.int64) -> None:
        """Sets a leaf of each tree and the minima above it."""
        node = leaf + width
        tree[top + node] = value
        while width > 1:
            width //= 2
            node = node >> 1
            two = top + 2 * node
            tree[top + node] = np.minimum(tree[two], tree[two + 1])

    def merged(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one after the other, and how many each has."""
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.first[raw]
        ids[np.cumsum(length)[length > 0] - 1] = self.last[raw[np.cumsum(length)[length > 0] - 1]]
        if not len(length) or length.max() <= LONG:
            return self.merged_parts(ids, length)
        # long pieces fall into parts where their bytes never stand side by side
        start = np.cumsum(length) - length
        cuts = [np.zeros(0, np.int64)]
        for i in np.flatnonzero(length > LONG).tolist():
            own = raw[start[i] : start[i] + length[i]]
            cuts.append(start[i] + 1 + np.flatnonzero(~self.beside[own[:-1], own[1:]]))
        bounds = np.union1d(np.concatenate(([0], np.cumsum(length))), np.concatenate(cuts))
        flat, n = self.merged_parts(ids, np.diff(bounds))
        upto = np.concatenate(([0], np.cumsum(n)))
        return flat, np.diff(upto[np.searchsorted(bounds, np.concatenate((start, [len(raw)])))])

    def merged_parts(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of so many ids each."""
        start = np.cumsum(length) - length
        count = np.zeros(len(length), np.int64)
        parts, rows = [], []
        width_of = 1 << np.ceil(np.log2(np.maximum(length, 2))).astype(np.int64)
        for width in np.unique(width_of).tolist():
            group = np.flatnonzero(width_of == width)
            if len(group) <= ALONE and width > 16:
                for i in group.tolist():
                    done = self.merge_alone(ids[start[i] : start[i] + length[i]].tolist())
                    parts.append(np.array(done, np.int64))
                    rows.append(np.array([i]))
                    count[i] = len(done)
                continue
            step = max(1, CELLS // width)
            for at in range(0, len(group), step):
                g = group[at : at + step]
                cells = np.zeros((len(g), width), np.int64)
                r = np.repeat(np.arange(len(g)), length[g])
                k = ranges(start[g], length[g])
                cells[r, k - np.repeat(start[g], length[g])] = ids[k]
                done, alive = self.merge(cells, length[g])
                parts.append(done[alive])
                rows.append(g)
                count[g] = alive.sum(axis=1)
        if not parts:
            return np.zeros(0, np.int64), count
        order = np.concatenate(rows)
        flat, n = np.concatenate(parts), count[order]
        from_ = np.zeros(len(length), np.int64)
        from_[order] = np.cumsum(n) - n
        return flat[ranges(from_, count)], count

    def pieces(self, chunk: str) -> list[bytes | int]:
        """The pieces of a chunk without white space of ASCII: bytes to merge, or the id of an added token."""
        out: list[bytes | int] = []
        for part in self.special.split(chunk) if self.special and "<" in chunk else [chunk]:
            if part in self.added:
                out.append(self.added[part])
            elif part.isascii():
                low = part.lower()
                out += [low.encode()] if low.isalpha() else [x.encode() for x in ASCII_PIECES.findall(low)]
            else:
                if MARKS.search(part):  # nothing composes or is reordered across one of these
                    part = "".join(unicodedata.normalize("NFC", x) for x in MARKS.split(part))
                else:
                    part = unicodedata.normalize("NFC", part)
                if CAPITALS.search(part):
                    part = part.translate(SMALL)
                low = part.lower() if "Σ" not in part else "".join(map(str.lower, part))  # a final sigma stays as it is
                out += [low.encode()] if low.isalpha() else [x.encode() for x in PIECES.findall(low)]
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the n + 1 offsets of the texts in them."""
        chunks, codes, offsets = words(texts)
        chunks = chunks.to_pylist()
        if len(self.known) > KNOWN:
            self.forget()
        row = list(map(self.known.get, chunks))
        new = [i for i, k in enumerate(row) if k is None]
        if new:
            size, ids = self.encode_chunks([chunks[i] for i in new])
            begin = len(self.pool) + np.cumsum(size) - size
            first = len(self.known)
            self.begin, self.size, self.pool = (np.concatenate(x) for x in ((self.begin, begin), (self.size, size), (self.pool, ids)))
            for k, i in enumerate(new, first):
                row[i] = self.known[chunks[i]] = k
        at = np.array(row, np.int64)[codes]
        size = self.size[at]
        return self.pool[ranges(self.begin[at], size)], np.concatenate(([0], np.cumsum(size)))[offsets]

    def forget(self) -> None:
        """Drops what is known of chunks: their rows, and in each row where the ids begin in the pool and how many there are."""
        self.known: dict[str, int] = {}
        self.begin, self.size, self.pool = (np.zeros(0, np.int64) for _ in range(3))

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each chunk has, and the ids of all, one after the other."""
        index: dict[bytes, int] = {}
        flat: list[int] = []  # an index of a piece, or -1 - the id of an added token
        counts = np.zeros(len(chunks), np.int64)
        for i, chunk in enumerate(chunks):
            own = [index.setdefault(p, len(index)) if isinstance(p, bytes) else -1 - p for p in self.pieces(chunk)]
            counts[i] = len(own)
            flat += own
        ids, n = self.merged(list(index))
        start = np.cumsum(n) - n
        piece = np.array(flat, np.int64)
        extra = -1 - piece[piece < 0]
        start, n, ids = np.concatenate((start, len(ids) + np.arange(len(extra)))), np.concatenate((n, np.ones(len(extra), np.int64))), np.concatenate((ids, extra))
        piece[piece < 0] = len(index) + np.arange(len(extra))
        upto = np.concatenate(([0], np.cumsum(n[piece])))
        ends = np.cumsum(counts)
        return upto[ends] - upto[ends - counts], ids[ranges(start[piece], n[piece])]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.spelled[ids].tobytes().translate(None, b"\0")[:-1]

    def decode(self, ids) -> str:
        """The tokens' own texts, joined by a space, as the vocabulary names no other decoder."""
        return self.decode_bytes(np.asarray(ids, np.int64)).decode()

    def digits(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by a space."""
        return self.decimal[ids].tobytes().translate(None, b"\0")[:-1]


OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string"}


def encode(df: DataFrame, path: str, outputs: tuple[str, ...] = ("ids", "n_tokens"), text: str = "text", keep_text: bool = True) -> DataFrame:
    """df with the outputs named, of OUTPUTS: ids, their number, the text decoded from them, and digests of both."""
    small_batches(df.sparkSession)
    model = Shared(df.sparkSession, Model(path))
    kept = [f for f in df.schema.fields if f.name not in outputs and (keep_text or f.name != text)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{o} {OUTPUTS[o]}" for o in outputs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.open()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in slices(batches, text, 3 << 20):
            ids, at = m.encode(b.column(text))
            each = [ids[s:e] for s, e in zip(at[:-1], at[1:], strict=True)]
            back = [m.decode_bytes(x) for x in each] if any(o.startswith("decoded") for o in outputs) else []
            made = {
                "n_tokens": lambda: pa.array(np.diff(at)),
                "ids": lambda: pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))),
                "decoded": lambda: pa.array([x.decode() for x in back], pa.string()),
                "ids_sha256": lambda: pa.array([sha(m.digits(x)) for x in each], pa.string()),
                "decoded_sha256": lambda: pa.array([sha(x) for x in back], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [made[o]() for o in outputs], [f.name for f in kept] + list(outputs))

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that its array of ids decodes to (null for null)."""
    model = Shared(df.sparkSession, Model(path))
    kept = [f for f in df.schema.fields if f.name != out]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"{out} string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.open()
        for b in batches:
            texts = [None if x is None else m.decode(x) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(f.name) for f in kept] + [pa.array(texts, pa.string())], [*[f.name for f in kept], out])

    return df.mapInArrow(run, schema)
