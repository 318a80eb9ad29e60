"""Whitening of embeddings from a covariance over distinct vectors, each weighted by its multiplicity.

Vectors become integers, x = floor(scale * c) + shift for each entry c, and equal x-vectors are grouped: a distinct vector
carries the number of its rows, which is its weight in the fit (or one, for a fit in which copies count once). Sums and
deviations are exact 64-bit integers. The covariance is a centred weighted matrix product a task of distinct vectors;
the tasks' matrices are added by entry in Spark, so only one matrix of the vectors' dimension reaches the driver, where
its eigenvectors are taken. Each distinct vector is whitened once and the rows take their result by a join on the
vector's digest; digests that many rows share are dealt to many tasks. The error of the whitened vectors' own
covariance is measured in the same way, over all of them.

Defined cases: null vectors, vectors with a null, infinite or not-a-number entry, those without entries, those of another
length than the most common one (of two as common, the longer) and those with an x beyond 2**53 are left out; rows that
share an identifier are rows of their own, a null identifier stays; directions without variance (at most ``FLAT`` of the
whole) give no components, so one row, or rows that are all equal, give no rows; a deviation beyond 64 bits is null;
further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Tables, join_dealt

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
FLAT = 1e-12  # share of the whole variance below which a direction has none
ENTRY = "i int, j int, v double"


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x) of the rows whose vector takes part."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    places = F.transform("v", lambda c: F.lit(float(scale)) * c)
    good = F.forall("p", lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float(1 << 53)))
    rows = rows.select("id", places.alias("p")).where(F.col("p").isNotNull() & (F.size("p") > 0) & good)
    return rows.select("id", F.transform("p", lambda p: F.floor(p).cast("long") + F.lit(shift)).alias("x"))


def matrix(column: pa.Array, dimension: int, kind=np.int64) -> np.ndarray:
    return np.asarray(column.flatten()).astype(kind).reshape(-1, dimension)


def sums(distinct: DataFrame, dimension: int) -> list[int]:
    """Exact weighted sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dimension
        for batch in batches:
            x, w = matrix(batch.column("x"), dimension), np.asarray(batch.column("w"))
            low, high = (x & 0xFFFFF) * w[:, None], (x >> 20) * w[:, None]  # no product or sum leaves 64 bits
            total = [t + int(a) + (int(b) << 20) for t, a, b in zip(total, low.sum(0), high.sum(0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dimension), pa.int32()), "low": [t & 0xFFFFF for t in total], "high": [t >> 20 for t in total]})

    parts = distinct.select("x", "w").mapInArrow(add, "i int, low long, high long").groupBy("i").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return [r.low + (r.high << 20) for r in parts.orderBy("i").collect()]  # one row a dimension


def products(rows: DataFrame, column: str, dimension: int, centre: np.ndarray) -> np.ndarray:
    """Weighted sum of the outer products of what ``column`` holds, less ``centre``."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dimension, dimension))
        for batch in batches:
            y = matrix(batch.column(column), dimension, np.float64) - centre
            total += (y * np.asarray(batch.column("w"))[:, None]).T @ y
        i, j = np.triu_indices(dimension)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]})

    out = np.zeros((dimension, dimension))
    # one row an entry of the matrix
    for r in rows.select(column, "w").mapInArrow(multiply, ENTRY).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.v
    return out


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Sum over the dimensions of (n * x - total) ** 2, exact; null beyond 64 bits."""
    about = np.abs(x * float(n) - total.astype(np.float64)).max(1, initial=0.0)
    if about.max(initial=0.0) ** 2 * x.shape[1] < 2.0**62:
        return ((n * x - total) ** 2).sum(1).tolist()
    exact = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total)) for row in x]
    return [e if e < 1 << 63 else None for e in exact]


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = COMPONENTS,
    scale: float = SCALE,
    shift: int = SHIFT,
    weights: str = "counts",
) -> DataFrame:
    """One row a vector and component: n, deviation, whitened, explained, identity_error. ``weights``: "counts" or "one"."""
    if weights not in ("counts", "one"):
        raise ValueError("weights: counts or one")
    spark = vectors.sparkSession
    tables = Tables(spark, "whitening")
    x = integers(vectors, id_col, vector_col, scale, shift)
    sizes = x.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    out = "key binary, size long, n long, deviation long, whitened array<double>"
    schema = f"{id_col} long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not sizes:
        return spark.createDataFrame([], schema)
    dimension = sizes[0].d
    x = x.where(F.size("x") == dimension)
    key = F.unhex(F.sha2(F.array_join("x", ",").cast("binary"), 256)).alias("key")
    weight = F.col("size") if weights == "counts" else F.lit(1).cast("long")
    grouped = x.groupBy("x").agg(F.count("*").alias("size")).select(key, "x", "size", weight.alias("w"))
    distinct = tables.stored(grouped, "distinct")
    n = distinct.agg(F.sum("w")).first()[0]
    total = sums(distinct, dimension)
    mean = np.array([s / n for s in total])  # correctly rounded: Python divides whole numbers exactly
    covariance = products(distinct, "x", dimension, mean) / n
    values, axes = np.linalg.eigh(covariance)
    kept = [i for i in np.argsort(-values, kind="stable")[:components] if values[i] > FLAT * max(np.trace(covariance), 0)]
    axes, values, whole = axes[:, kept], values[kept], float(np.trace(covariance))
    if not kept:
        return tables.result(spark.createDataFrame([], schema))
    exact_total = np.array(total, dtype=object if max(map(abs, total)) >= 1 << 62 else np.int64)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column("x"), dimension)
            white = (rows - mean) @ axes / np.sqrt(values)
            lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(kept), white.ravel())
            deviation = pa.array(deviations(rows, n, exact_total), pa.int64())
            columns = [batch.column("key"), batch.column("size"), pa.array(np.full(len(rows), n)), deviation, lists]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "size", "n", "deviation", "whitened"])

    white = tables.stored(distinct.select("key", "size", "x").mapInArrow(project, out), "white")
    weighted = white.withColumn("w", F.col("size") if weights == "counts" else F.lit(1).cast("long"))
    centre = weighted.select(*[(F.sum(F.col("w") * F.col("whitened")[i]) / n).alias(f"m{i}") for i in range(len(kept))]).first()
    error = products(weighted, "whitened", len(kept), np.array(list(centre))) / n - np.eye(len(kept))
    shares = F.array(*[F.lit(float(v) / whole) for v in values])
    met = join_dealt(x.select("id", key), white, ["key"], "size", sizes[0].n, ["id"])
    long = met.select(F.col("id").alias(id_col), "n", "deviation", F.posexplode(F.arrays_zip("whitened", shares.alias("explained"))).alias("at", "e"))
    return tables.result(
        long.select(
            id_col,
            (F.col("at") + 1).cast("int").alias("component"),
            "n",
            "deviation",
            F.col("e.whitened").alias("whitened"),
            F.col("e.explained").alias("explained"),
            F.lit(float(np.abs(error).max())).alias("identity_error"),
        )
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
