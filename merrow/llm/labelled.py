"""A bounded sample of labelled training rows, and the split by hash of the identifier."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def held_out(id_col: str = "doc_id") -> Column:
    """True for the rows whose labels are never learnt from; a null identifier is held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(True))


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int
) -> tuple[list[tuple[str, int]], float]:
    """At most ``per_class`` texts of each label, of at most ``max_chars`` characters, and the share of label 1.

    The rows are chosen by a hash of their identifier among texts within the bound; only where there are too few of
    those do longer ones take part, each with a window of ``max_chars`` characters at a place that the hash chooses. So
    the sample is bounded (2 * per_class * max_chars characters), alike on every run, and empty only where no labelled
    text has a character. A document with several label rows has label 1 if any of them has; every row of a repeated
    identifier is a text of its own; a null identifier is never learnt from.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    totals = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    key, size = F.xxhash64("doc_id", F.lit(label)), F.char_length("text")
    sizes = docs.select("doc_id", (size > max_chars).alias("long")).where(size > 0).join(known, "doc_id")
    chosen = None
    for value in (0, 1):
        part = sizes.where(F.col("label") == value).orderBy("long", key, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    start = F.pmod(F.xxhash64("doc_id", F.lit("start")), F.greatest(size - max_chars + 1, F.lit(1))).cast("int") + 1
    texts = docs.select("doc_id", F.substring("text", start, F.lit(max_chars)).alias("text")).where(size > 0)
    # the chosen identifiers are 2 * per_class rows at most
    rows = texts.join(F.broadcast(chosen.dropDuplicates(["doc_id"])), "doc_id").orderBy("long", key, "doc_id", "text")
    rows = rows.select("text", "label").limit(2 * per_class).collect()
    share = totals.get(1, 0) / max(1, sum(totals.values()))
    return [(r.text, r.label) for r in rows], share


def fit_logistic(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> np.ndarray:
    """Weights and intercept of a logistic curve, by Newton steps with a small ridge; classes weigh as in the corpus."""
    x = np.column_stack([x, np.ones(len(x))])
    of_one = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    weight = np.where(y == 1, share / of_one[0], (1 - share) / of_one[1]) * len(y)
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-3)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-9)
        step = np.linalg.solve(hessian, gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def set_apart(labels: np.ndarray, every: int = 4) -> np.ndarray:
    """True for every fourth row of each label: kept from training, for the curve."""
    out = np.zeros(len(labels), bool)
    for value in np.unique(labels):
        out[np.flatnonzero(labels == value)[every - 1 :: every]] = True
    return out


def with_labels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """One row a document: doc_id, held_out, score, predicted. ``score(texts)`` gives an array for a list of texts."""
    import pyarrow as pa

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        for batch in batches:
            scores = np.clip(np.asarray(score(batch.column(2).to_pylist()), np.float64), 0, 1)
            made = [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(made, schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
