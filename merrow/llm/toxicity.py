"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is cut into windows of ``window`` words. A window's vector is the mean of the vectors of the character
3- to 5-grams of its words (with word ends); a linear softmax scores it, and the text scores as its highest window,
so that a few words in a long text are not averaged away. Embeddings and softmax are trained together on a bounded
sample, each epoch on the windows that score highest so far; an unseen misspelling shares most n-grams with the word it
comes from. A logistic curve fitted on a part of the sample that training has not seen turns the highest window into a
probability.

Defined cases: an empty or null text, or one without letters, scores as a text without any known n-gram; a text of any
length is scored whole, by its windows; without labelled rows of both kinds every text scores the share of label 1 (0 in an
empty table of labels); rows that share an identifier are scored each for itself, and a null identifier is held out; an
empty table gives no rows; ``score_toxicity`` ignores further columns, ``keep_clean`` keeps them.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .labelled import fit_logistic, scored, set_apart, training_sample, with_labels

PER_CLASS, MAX_CHARS, THRESHOLD = 1500, 12_000, 0.7
NOT_LETTERS = re.compile(r"[\W\d_]+")


def ngram_ids(text: str, bits: int, window: int, least: int = 3, most: int = 5) -> np.ndarray:
    """window number << bits | bucket of each distinct character n-gram within a word, both ends of the word marked."""
    bare = " " + NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    code = np.frombuffer(bare.encode("utf-32-le"), np.uint32).astype(np.uint64)
    if len(code) < 3:
        return np.zeros(0, np.int64)
    spaces = np.concatenate([[0], np.cumsum(code == 32)])
    windows = spaces[1:] // window
    found = []
    h, base = code, np.uint64(0x100000001B3)
    for n in range(2, most + 1):
        if len(code) < n:
            break
        h = h[: len(code) - n + 1] * base + code[n - 1 :]
        if n >= least:
            ok = np.flatnonzero(spaces[n - 1 : n - 1 + len(h)] == spaces[1 : 1 + len(h)])
            bucket = ((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
            found.append(bucket.astype(np.int64) | windows[ok] << bits)
    found = np.sort(np.concatenate(found))
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def gradients(
    vectors: np.ndarray, heads: np.ndarray, bias: np.ndarray, bags: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets in the bags, the gradient of the mean weighted cross entropy by their vectors, and by the heads."""
    size = np.array([len(bag) for bag in bags])
    flat, over = np.concatenate(bags), np.maximum(size, least).astype(np.float32)
    mean = np.add.reduceat(vectors[flat], np.concatenate([[0], np.cumsum(size)[:-1]])) / over[:, None]
    logits = mean @ heads + bias
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    p[np.arange(len(bags)), labels] -= 1
    p *= (weight / len(bags))[:, None].astype(np.float32)
    rows = np.repeat((p @ heads.T) / over[:, None], size, axis=0)
    ids, back = np.unique(flat, return_inverse=True)
    total = np.column_stack([np.bincount(back, rows[:, d], len(ids)) for d in range(vectors.shape[1])]).astype(np.float32)
    return ids, total, mean.T @ p


class SubwordSoftmax:
    """``least`` is the number of n-grams that a window's mean is taken over at least, the rest counting as zero."""

    def __init__(self, bits: int = 18, dim: int = 10, window: int = 24, least: int = 250, epochs: int = 14, rate: float = 0.25, seed: int = 7) -> None:
        self.bits, self.buckets, self.dim, self.window = bits, 1 << bits, dim, window
        self.least, self.epochs, self.rate, self.seed = least, epochs, rate, seed

    def windows(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of each window: their buckets and their window's number, by window."""
        pairs = ngram_ids(text, self.bits, self.window)
        return pairs & (self.buckets - 1), pairs >> self.bits

    def means(self, ids: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        size = np.bincount(at, minlength=n)
        return np.bincount(at, self.table[ids], minlength=n) / np.maximum(size, self.least)

    def fit(self, texts: list[tuple[str, int]], share: float) -> "SubwordSoftmax":
        self.table, self.curve, self.share = None, None, share
        labels = np.array([y for _, y in texts], int)
        if len(set(labels.tolist())) < 2:
            return self
        rng = np.random.default_rng(self.seed)
        apart = set_apart(labels)
        train = np.flatnonzero(~apart)
        bags = [tuple(x.astype(np.int32) for x in self.windows(texts[i][0])) for i in train]
        texts_with = np.zeros(self.buckets, np.int64)
        for ids, _ in bags:
            texts_with[np.unique(ids)] += 1
        known = texts_with >= 2
        for i, (ids, at) in enumerate(bags):  # in place: the sample's n-grams are held once
            bags[i] = ids[known[ids]], at[known[ids]]
        vectors = np.where(known[:, None], rng.normal(0, 0.05, (self.buckets, self.dim)), 0).astype(np.float32)
        # the bias is fixed: a window without evidence is clean, and clean words need not be learnt as such
        heads, bias = rng.normal(0, 0.5, (self.dim, 2)).astype(np.float32), np.array([2, -2], np.float32)
        squares, head_squares = np.full(self.buckets, 1e-6, np.float32), np.float32(1e-4)
        y = labels[train]
        weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))
        for epoch in range(self.epochs):
            self.table = vectors @ (heads[:, 1] - heads[:, 0])
            chosen = []
            for ids, at in bags:  # the window that speaks for its text; at first the whole text does
                if epoch < 2 or not len(ids):
                    chosen.append(np.unique(ids))
                else:
                    chosen.append(ids[at == self.means(ids, at, int(at[-1]) + 1).argmax()])
            order = rng.permutation(len(bags))
            for start in range(0, len(order), 16):
                part = [i for i in order[start : start + 16] if len(chosen[i])]
                if not part:
                    continue
                ids, total, down = gradients(vectors, heads, bias, [chosen[i] for i in part], y[part], weight[y[part]], self.least)
                squares[ids] += (total**2).mean(1)
                vectors[ids] -= self.rate * total / np.sqrt(squares[ids])[:, None]
                head_squares += (down**2).mean()
                heads -= 0.1 * down / np.sqrt(head_squares)
        # what stays of the model for scoring: each bucket's vector through the softmax's difference
        self.table = (vectors @ (heads[:, 1] - heads[:, 0])).astype(np.float32)
        known, y = [self.evidence(texts[i][0]) for i in np.flatnonzero(apart)], labels[apart]
        blank = max(1, len(y) // 10)  # texts without evidence, so that the curve has them clean
        self.curve = fit_logistic(np.array(known + [(0.0, 0.0, 0.0)] * blank), np.concatenate([y, np.zeros(blank, int)]), share)
        return self

    def evidence(self, text: str) -> tuple[float, float, float]:
        """The highest window, the mean of the three highest, and the number of windows (log)."""
        ids, at = self.windows(text)
        if not len(ids):
            return 0.0, 0.0, 0.0
        means = np.sort(self.means(ids, at, int(at[-1]) + 1))[::-1]
        return float(means[0]), float(means[:3].sum() / 3), float(np.log(len(means)))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.share)
        x = np.array([self.evidence(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> SubwordSoftmax:
    return SubwordSoftmax().fit(*training_sample(docs, labels, "toxic", per_class, max_chars))


def score_toxicity(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, model.score, threshold)


def keep_clean(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores under the threshold, as they are."""

    def keep(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array(model.score([t or "" for t in texts]) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = with_labels(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, labels))
