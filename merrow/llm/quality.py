"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

One dictionary is trained on each kind. A text is compressed in blocks of ``block`` bytes with either dictionary; the
difference of the sizes, over their sum, is turned into a probability by a logistic curve fitted on labelled texts
that the dictionaries have not seen; the curve also sees how far the text shrinks at all (one word over and over
shrinks alike with either dictionary). Every byte of a text takes part, whatever its length.

Defined cases: an empty or null text has difference 0; a text of any length is compressed whole, block after block;
without labelled rows of both kinds every text scores the share of label 1 (0 in an empty table of labels); rows that share
an identifier are scored each for itself, and a null identifier is held out; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession

from .labelled import fit_logistic, scored, set_apart, training_sample, with_labels

PER_CLASS, MAX_CHARS, THRESHOLD = 2000, 20_000, 0.5


class CompressionQuality:
    def __init__(self, block: int = 512, size: int = 110_000, level: int = 3) -> None:
        self.block, self.size, self.level = block, size, level
        self.dictionaries: list[bytes] = []
        self.curve = None
        self._pair = None

    def __getstate__(self):
        return {**self.__dict__, "_pair": None}

    def blocks(self, text: str) -> list[bytes]:
        data = text.encode("utf-8")
        return [data[i : i + self.block] for i in range(0, len(data), self.block)]

    def fit(self, texts: list[tuple[str, int]], share: float) -> "CompressionQuality":
        self.share = share
        labels = np.array([y for _, y in texts], int)
        if len(set(labels.tolist())) < 2:
            return self
        apart = set_apart(labels)
        for kind in (1, 0):
            samples = [b for (t, y), a in zip(texts, apart, strict=True) if y == kind and not a for b in self.blocks(t)]
            self.dictionaries.append(self.trained(samples))
        x = np.array([self.sizes(t) for t, _ in texts])
        self.curve = fit_logistic(x[apart], labels[apart], share)
        return self

    def trained(self, samples: list[bytes]) -> bytes:
        try:
            return zstandard.train_dictionary(self.size, samples).as_bytes()
        except zstandard.ZstdError:  # too little text for a trained one: the text itself serves
            return b"".join(samples)[-self.size :]

    def pair(self):
        if self._pair is None:
            kinds = [zstandard.ZstdCompressionDict(d) for d in self.dictionaries]
            self._pair = [zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_dict_id=False) for d in kinds]
        return self._pair

    def sizes(self, text: str) -> tuple[float, float, float]:
        """The normalised difference of the compressed sizes, and how far the text shrinks at all (with its square)."""
        good, bad = self.pair()
        blocks = self.blocks(text)
        a, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
        ratio = min((a + b) / 2 / max(1, sum(map(len, blocks))), 1.0)
        return 10 * (b - a) / max(1, a + b), ratio, ratio * ratio

    def score(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.full(len(texts), self.share)
        x = np.array([self.sizes(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[:-1] + self.curve[-1], -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> CompressionQuality:
    return CompressionQuality().fit(*training_sample(docs, labels, "quality", per_class, max_chars))


def score_quality(docs: DataFrame, model: CompressionQuality, threshold: float = THRESHOLD) -> DataFrame:
    return scored(docs, model.score, threshold)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = with_labels(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, labels))
