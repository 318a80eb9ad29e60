"""Vectors of texts and exact nearest neighbours by blocks."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def norm(column: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.transform(column, lambda x: x.cast("double")), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(column: Column | str) -> Column:
    """A zero vector stays as it is. The length is a variable of the outer step, so it is taken once, not once an entry."""
    scaled = lambda n: F.transform(column, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))
    return F.transform(F.array(norm(column)), scaled)[0]


def hash_embed(docs: DataFrame, dim: int = 128, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Signed word counts in buckets by SHA-256, brought to length one.

    A batch's different words are hashed once and its texts counted together; rows that share an id share their counts.
    """
    words = docs.select(F.col(id_col).alias("id"), F.split(F.trim(F.lower(text_col)), r"\s+").alias("words"))

    def count(batches):
        for batch in batches:
            lists = batch.column("words")
            flat = lists.flatten().dictionary_encode()
            digests = [hashlib.sha256(w.encode()).digest() for w in flat.dictionary.to_pylist()]
            bucket = np.array([int.from_bytes(d[:4], "little") % dim for d in digests], np.int64)
            sign = np.array([1 - 2 * (d[4] % 2) for d in digests], np.int64)
            sign[np.array([w == "" for w in flat.dictionary.to_pylist()], bool)] = 0
            codes = flat.indices.to_numpy()
            owner = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).fill_null(0).to_numpy())
            sums = np.bincount(owner * dim + bucket[codes], sign[codes], len(lists) * dim)
            offsets = pa.array(np.arange(len(lists) + 1, dtype=np.int32) * dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(offsets, pa.array(sums))], ["id", "counts"])

    zero = F.array_repeat(F.lit(0.0), dim)
    made = words.mapInArrow(count, T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("counts", T.ArrayType(T.DoubleType()))]))
    held = made.groupBy("id").agg(F.collect_list("counts").alias("rows"))
    total = F.when(F.size("rows") == 1, F.col("rows")[0]).otherwise(F.aggregate("rows", zero, lambda s, x: F.zip_with(s, x, lambda a, b: a + b)))
    vec = l2_normalize(F.when(F.col("id").isNull(), zero).otherwise(total))
    out = held.select("id", vec.alias("vec"), F.size("rows").alias("n"))
    return out.select(F.col("id").alias(id_col), "vec", F.explode(F.array_repeat(F.lit(0), F.col("n")))).select(id_col, "vec")


def embed(docs: DataFrame, encode: Callable[[list[str]], np.ndarray], dim: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Vectors by any encoder of lists of texts; wrong shapes and non-finite values fail the job."""

    @F.pandas_udf("array<float>")
    def vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            made = np.asarray(encode(part.fillna("").tolist()), np.float32)
            if made.shape != (len(part), dim) or not np.isfinite(made).all():
                raise ValueError(f"encoder gave {made.shape}, wanted {(len(part), dim)} of finite numbers")
            yield pd.Series(list(made))

    return docs.select(id_col, vectors(text_col).alias("vec"))


def validate_vectors(vectors: DataFrame, id_col: str, vec_col: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: vectors, repeated ids, non-finite ones, lengths other than one, different dimensions."""
    twice = vectors.groupBy(id_col).agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_ids"))
    odd = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    facts = vectors.agg(
        F.count("*").alias("vectors"), F.count_if(odd).alias("non_finite"), F.count_if(F.abs(norm(vec_col) - 1) > tolerance).alias("not_unit"), F.count_distinct(F.size(vec_col)).alias("dimensions")
    )
    return facts.crossJoin(twice).withColumn("ok", (F.col("repeated_ids") + F.col("non_finite") + F.col("not_unit") == 0) & (F.col("dimensions") <= 1))  # one row each


def cosine_topk(vectors: DataFrame, queries: DataFrame, k: int, seen: DataFrame | None = None, block: int = 16_384, query_block: int = 4_096) -> DataFrame:
    """vectors (id, vec), queries (query_id, vec) -> (query_id, id, score, rank): exact cosine, ties by id.

    Blocks of vectors meet blocks of queries, each pair of blocks one group of bounded size; a block gives its k best
    that are not in ``seen`` (query_id, id). Zero queries find nothing.
    """
    spark = vectors.sparkSession
    blocks = max(math.ceil(vectors.count() / block), min(8, spark.sparkContext.defaultParallelism))
    query_blocks = max(1, math.ceil(queries.count() / query_block))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    base = vectors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(False).alias("asks"), F.array().cast("array<bigint>").alias("seen"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("vb"), each(query_blocks).alias("qb"))
    asked = queries.select(F.col("query_id").alias("id"), "vec")
    if seen is None:
        asked = asked.withColumn("seen", F.array().cast("array<bigint>"))
    else:
        lists = seen.groupBy(F.col("query_id").alias("id")).agg(F.collect_set("id").alias("seen"))
        asked = asked.join(lists, "id", "left").withColumn("seen", F.coalesce("seen", F.array().cast("array<bigint>")))
    asked = asked.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"), F.lit(True).alias("asks"), "seen", each(blocks).alias("vb"), F.pmod(F.xxhash64(F.lit(1), "id"), F.lit(query_blocks)).alias("qb"))
    schema = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])

    def search(table: pa.Table) -> pa.Table:
        asks, ids = table["asks"].to_numpy(), table["id"].to_numpy()
        points = np.array(table["vec"].to_pylist(), np.float64)
        sizes = np.linalg.norm(points, axis=1)
        x, y = points[~asks], points[asks]
        out = []
        if len(x) and len(y):
            x = x / np.where(sizes[~asks] == 0, 1, sizes[~asks])[:, None]
            mine = ids[~asks]
            hidden = table.filter(table["asks"])["seen"].to_pylist()
            y = y / np.where(sizes[asks] == 0, 1, sizes[asks])[:, None]
            for start in range(0, len(y), 256):
                rough = y[start : start + 256] @ x.T  # one product for a batch of queries
                for q, scores in enumerate(rough, start):
                    if sizes[asks][q] == 0:
                        continue
                    some = np.flatnonzero(~np.isin(mine, hidden[q])) if hidden[q] else np.arange(len(mine))
                    if len(some) > k:  # all that may be among the k best once scores are exact
                        some = some[scores[some] >= np.partition(scores[some], -k)[-k] - 1e-6]
                    exact = np.round((x[some] * y[q]).sum(1), 9)
                    best = np.lexsort((mine[some], -exact))[:k]
                    out.append((np.full(len(best), ids[asks][q]), mine[some[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.Table.from_arrays([pa.array(c) for c in columns], schema=schema)

    local = base.unionByName(asked).groupBy("vb", "qb").applyInArrow(search, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build_embeddings(items: DataFrame, existing: DataFrame | None, encode: Callable[[DataFrame], DataFrame], id_col: str = "item_id") -> DataFrame:
    """Vectors of the items that have none yet; append the result to the stored ones."""
    new = items if existing is None else items.join(existing.select(id_col), id_col, "left_anti")
    return encode(new)


def balanced_sample(df: DataFrame, n: int, group: str, key: str, seed: int = 0) -> DataFrame:
    """n rows with equal quotas by group, the rest dealt round: by a hash of the key, so alike on every run."""
    order = Window.partitionBy(group).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), key)
    ranked = df.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n)
    return ranked.orderBy("_r", group).limit(n).drop("_r")
