"""Document quality by supervised subword embeddings.

A word's features are itself, its character n-grams of 3 to 5 letters (with marks for its ends) and the word n-gram of two
that it makes with the word before it; a word that repeats the one before makes the same n-gram whatever the word. Features are
hashed into 2 ** BITS rows. A document's vector is the mean over its words of the mean of their features' vectors; a softmax
over the classes follows. Vectors and softmax are learned together by numpy stochastic gradient descent over
mini-batches. As all before the softmax is linear, text is scored by one number per row, the projection of its vector on the
difference of the classes, so memory is bounded by that table and the slice of texts at hand.

Bounds: `documents` labelled documents of each class at most, those with the smallest hashes of their key, and `letters` of their texts;
texts that no longer fit are left out.
Null and empty texts have a zero vector and so the score of the softmax's constants. Without labels of both classes every
score is 0. Null labels are left out; an id counts once, with its highest label and the text that sorts first. Extra columns pass through; own columns score and
predicted are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import labelled_texts, words

BITS = 18
DIM = 8
SIZES = (3, 4, 5)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """Rows of hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) * PRIME >> np.uint64(64 - BITS)).astype(np.int64)


def word_features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, row, weight) of the features of distinct words, without word n-grams, and a hash of each word."""
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    points = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32).astype(np.uint64)
    start = np.cumsum(n) - n
    length = n + 2
    flat = np.full(int(length.sum()), 3, np.uint64)  # ends of words are 2 and 3
    at = np.cumsum(length) - length
    flat[at] = 2
    owner = np.repeat(np.arange(len(n)), n)
    flat[at[owner] + 1 + np.arange(len(points)) - start[owner]] = points
    word_of = np.repeat(np.arange(len(n)), length)
    # polynomial hashes of prefixes give those of words
    power = PRIME ** (np.arange(len(flat), dtype=np.uint64) - at.astype(np.uint64)[word_of])
    with np.errstate(over="ignore"):
        whole = np.add.reduceat(flat * power, at) if len(at) else np.zeros(0, np.uint64)
    owners, rows = [np.arange(len(n))], [mixed(whole)]
    for size in SIZES:
        if len(flat) < size:
            continue
        ok = np.flatnonzero(word_of[size - 1 :] == word_of[: len(word_of) - size + 1])
        h = np.full(len(ok), size, np.uint64)
        for k in range(size):
            h = h * PRIME + flat[ok + k]
        owners.append(word_of[ok])
        rows.append(mixed(h))
    owner, row = np.concatenate(owners), np.concatenate(rows)
    count = np.bincount(owner, minlength=len(n))
    return owner, row, 1.0 / (count[owner] + 1.0), whole


def pair_rows(whole: np.ndarray, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row of each word's n-gram with the word before it in its text; the first word's is that with none."""
    before = np.empty(len(codes), np.int64)
    before[1:] = codes[:-1]
    filled = offsets[:-1][np.diff(offsets) > 0]
    before[filled] = -1
    h = np.where(before < 0, np.uint64(7), whole[before])
    h = np.where(before == codes, np.uint64(11), h * PRIME + whole[codes])
    return mixed(h)


class Model:
    vectors: np.ndarray | None = None

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 6, rate: float = 8.0, batch: int = 64) -> Model:
        labels = np.asarray(labels, np.int64)
        if len(np.unique(labels)) < 2:
            return self
        # rows and weights of each document; equal rows of one document are added up
        docs = []
        for at in range(0, len(texts), 500):
            distinct, codes, offsets = words(pa.array(texts[at : at + 500], pa.string()))
            owner, row, weight, whole = word_features(distinct.to_pylist())
            n_features = np.bincount(owner, minlength=len(whole))
            begin = np.searchsorted(owner[order := np.argsort(owner, kind="stable")], np.arange(len(whole)))
            row, weight = row[order], weight[order]
            pairs = pair_rows(whole, codes, offsets)
            for s, e in zip(offsets[:-1], offsets[1:], strict=True):
                own, times = np.unique(codes[s:e], return_counts=True)
                n = n_features[own]
                k = np.arange(n.sum()) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
                used, at_ = np.unique(np.concatenate((row[k], pairs[s:e])), return_inverse=True)
                total = np.bincount(at_, np.concatenate((np.repeat(times, n) * weight[k], 1.0 / (n_features[codes[s:e]] + 1.0))), len(used))
                docs.append((used.astype(np.int32), (total / max(1, e - s)).astype(np.float32)))
        rng = np.random.default_rng(0)
        vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
        out, const = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
        share = np.bincount(labels, minlength=2) / len(labels)
        steps, done = epochs * -(-len(docs) // batch), 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                rows = np.concatenate([docs[i][0] for i in pick])
                weight = np.concatenate([docs[i][1] for i in pick])
                size = np.array([len(docs[i][0]) for i in pick])
                doc = np.repeat(np.arange(len(pick)), size)
                hidden = np.zeros((len(pick), DIM), np.float32)
                filled = size > 0
                if filled.any():
                    hidden[filled] = np.add.reduceat(vectors[rows] * weight[:, None], (np.cumsum(size) - size)[filled])
                logit = hidden @ out + const
                p = np.exp(logit - logit.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                y = labels[pick]
                p[np.arange(len(pick)), y] -= 1
                p *= (0.5 / share[y])[:, None]
                lr = rate * (1 - done / steps)
                done += 1
                back = p @ out.T
                np.add.at(vectors, rows, -lr * weight[:, None] * back[doc])
                out -= lr / len(pick) * hidden.T @ p
                const -= lr / len(pick) * p.sum(axis=0)
        self.vectors, self.softmax, self.constant = vectors, out, const
        self.flat = (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64)
        self.bias = float(const[1] - const[0])
        return self

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probability of class 1."""
        if self.vectors is None:
            return np.zeros(len(texts))
        distinct, codes, offsets = words(texts)
        owner, row, weight, whole = word_features(distinct.to_pylist())
        by_word = np.bincount(owner, self.flat[row] * weight, len(whole))
        share = 1.0 / (np.bincount(owner, minlength=len(whole)) + 1.0)
        each = by_word[codes] + self.flat[pair_rows(whole, codes, offsets)] * share[codes]
        upto = np.concatenate(([0.0], np.cumsum(each)))
        n = np.diff(offsets)
        logit = (upto[offsets[1:]] - upto[offsets[:-1]]) / np.maximum(n, 1) + self.bias
        return 1 / (1 + np.exp(np.clip(-logit, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", documents: int = 2000, letters: int = 20_000_000) -> Model:
    """Learns from the texts of labelled documents."""
    texts, known = labelled_texts(docs, labels, key, text, label, documents, letters)
    return Model().fit(texts, known)
