"""Nearest neighbours by collision-counting hashing (one projection a hash function, windows around the query).

The largest inner product is turned into the least distance: vectors are divided by the largest norm and get one more
coordinate that brings them to length one, queries are brought to length one. Vectors are dealt into blocks of bounded
size. A block keeps one sorted array for each projection; the projections are the rows of random rotations. Around a
query's place in every array a window grows by a constant factor (virtual rehashing: a wider window is a coarser
bucket, nothing is hashed again). A vector in enough of the windows is verified: its inner product is computed in
double precision. The windows stop growing when a vector as far as the k-th best found so far would collide often
enough with a probability of ``confidence`` (a normal bound), so there is no limit on candidates, and a cluster of
thousands of copies does not stop the search early. Each block gives its k best, a window function the k best of all.

How much the windows leave out depends on the data: clusters are told apart by a few entries, while vectors spread
evenly over 64 dimensions are all about as far from a query as its nearest ones, and most entries are touched. A
block meets every query, so the work is queries times vectors at worst, in blocks.

Defined cases: rows that share an identifier are vectors of their own, which a query of that identifier never finds, and
a result that repeats identifier and score is given once; null, zero, non-finite vectors, vectors with a null inside and those of another length than the most
common one take no part; equal scores go to the smaller identifier; a query never finds its own row; fewer than k
others give fewer rows; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class CollisionIndex:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, largest: float, rotations: int, share: float, growth: float, confidence: float, seed: int = 5) -> None:
        self.ids, self.vectors, self.largest = ids, vectors, largest
        self.touched = self.verified = 0  # entries of the arrays, and vectors, that searches have looked at
        unit = vectors / largest
        rest = np.sqrt(np.maximum(0, 1 - (unit**2).sum(1)))
        points = np.column_stack([unit, rest])
        dim = points.shape[1]
        rng = np.random.default_rng(seed)
        self.axes = np.column_stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0] * math.sqrt(dim) for _ in range(rotations)])
        self.m = self.axes.shape[1]
        self.least = math.ceil(share * self.m)
        places = (points @ self.axes).T
        self.order = np.argsort(places, axis=1, kind="stable")
        self.sorted = np.take_along_axis(places, self.order, axis=1)
        self.widths = 0.05 * growth ** np.arange(math.ceil(math.log(4 * math.sqrt(dim) / 0.05, growth)) + 1)
        # per width: the largest distance at which a vector still reaches `least` collisions with this confidence
        grid = np.linspace(0.05, 12, 600)  # width in units of the distance
        p = 2 * np.array([NormalDist().cdf(x) for x in grid]) - 1
        z = NormalDist().inv_cdf(confidence)
        enough = self.m * p - z * np.sqrt(self.m * p * (1 - p)) >= self.least
        self.reach = self.widths / grid[enough.argmax()]

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.ids)
        length = math.sqrt((query**2).sum())
        at = np.append(query / length, 0.0) @ self.axes
        levels = len(self.widths)
        low, high = np.empty((self.m, levels), np.int64), np.empty((self.m, levels), np.int64)
        for j in range(self.m):
            low[j] = np.searchsorted(self.sorted[j], at[j] - self.widths, "left")
            high[j] = np.searchsorted(self.sorted[j], at[j] + self.widths, "right")
        # the first width at which k vectors can have enough collisions at all
        level = min(int(np.searchsorted((high - low).sum(0), k * self.least)), levels - 1)
        counts = np.bincount(np.concatenate([self.order[j, low[j, level] : high[j, level]] for j in range(self.m)]), minlength=n)
        checked, first = np.zeros(n, bool), level
        found, scores = np.zeros(0, np.int64), np.zeros(0)
        while True:
            new = np.flatnonzero((counts >= self.least) & ~checked)
            checked[new] = True
            new = new[self.ids[new] != own]
            found = np.concatenate([found, new])
            scores = np.concatenate([scores, (self.vectors[new] * query).sum(1)])
            if len(found) > k:
                best = np.lexsort((self.ids[found], -scores))[:k]
                found, scores = found[best], scores[best]
            if level == levels - 1:
                break
            if len(found) == k:
                far = math.sqrt(max(0.0, 2 - 2 * scores.min() / (length * self.largest)))
                if far <= self.reach[level]:
                    break
            level += 1
            parts = [self.order[j, a:b] for j in range(self.m) for a, b in ((low[j, level], low[j, level - 1]), (high[j, level - 1], high[j, level])) if b > a]
            if parts:
                counts += np.bincount(np.concatenate(parts), minlength=n)
        self.touched += int((high - low)[:, max(first, level)].sum())
        self.verified += int(checked.sum())
        return found, scores


def matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~bad & F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["size"] if sizes else 0))


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = 16_384,
    query_block: int = 8_192,
    rotations: int = 1,
    share: float = 0.85,
    growth: float = 1.15,
    confidence: float = 0.5,
) -> DataFrame:
    """The k nearest of every query: query_id, rank, vec_id, score. Both tables have id_col and vector_col."""
    spark = vectors.sparkSession
    rows, asked = usable(vectors, id_col, vector_col), usable(queries, id_col, vector_col)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    total = rows.agg(F.count("*").alias("n"), F.max(norm).alias("largest")).first()
    n_queries, largest = asked.count(), (total.largest or 1.0) * (1 + 1e-12)
    blocks = max(math.ceil(total.n / block), min(8, spark.sparkContext.defaultParallelism))
    query_blocks = max(1, math.ceil(n_queries / query_block))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # a vector goes to each block of queries, a query to each block of vectors
    dealt = rows.select("id", "v", F.lit(False).alias("asks"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("vb"), all_of(query_blocks).alias("qb"))
    dealt = dealt.unionByName(asked.select("id", "v", F.lit(True).alias("asks"), all_of(blocks).alias("vb"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)).alias("qb")))

    def search(table: pa.Table) -> pa.Table:
        asks = table["asks"].to_numpy()
        ids, points = table["id"].to_numpy(), matrix(table["v"], table.num_rows)
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if not asks.all() and asks.any():
            index = CollisionIndex(ids[~asks], points[~asks], largest, rotations, share, growth, confidence)
            for own, query in zip(ids[asks], points[asks], strict=True):
                found, scores = index.search(query, own, k)
                for part, values in zip(out, (np.full(len(found), own), index.ids[found], scores), strict=True):
                    part.append(values)
        return pa.Table.from_arrays([pa.array(np.concatenate(part)) for part in out], schema=FOUND)

    local = dealt.groupBy("vb", "qb").applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.distinct().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
