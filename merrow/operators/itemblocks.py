"""Item-item counts as products of sparse blocks of the user-item matrix.

Items are dealt into blocks of bounded size. A user's history goes, block by block, to the pairs of blocks that it touches,
so a user of n items never makes n * n / 2 rows: within a pair of blocks its items meet as numbers in a table of counts,
which is as large as the two blocks whatever the users. Users are dealt into slices where a block has more rows than one
task should see; the slices' counts are then added.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BLOCK, ROWS, AT_ONCE = 2048, 2_000_000, 4_000_000
MARGIN = 1e-8  # similarities further apart than this differ at nine digits


def product(ua: np.ndarray, ia: np.ndarray, ub: np.ndarray, ib: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """How many users have item i of the first and item j of the second block; users in ascending order in both."""
    counts = np.zeros(shape[0] * shape[1], np.int64 if len(ua) > 2**31 else np.int32)
    low, high = np.searchsorted(ub, ua, "left"), np.searchsorted(ub, ua, "right")
    ends = np.cumsum(high - low)
    start = 0
    while start < len(ua):  # rows whose items meet some million others at a time
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
        n = high[start:stop] - low[start:stop]
        met = np.repeat(low[start:stop] - np.cumsum(n) + n, n) + np.arange(n.sum())
        np.add.at(counts, np.repeat(ia[start:stop] * shape[1], n) + ib[met], 1)
        start = stop
    return counts.reshape(shape)


def among_best(counts: np.ndarray, n_rows: np.ndarray, n_columns: np.ndarray, k: int) -> np.ndarray:
    """Which entries may be among the k most similar of their row, ties to the smaller column.

    What rounding could bring level with the k-th stays, from above and from below. Entries that are as similar as the
    k-th to the last bit are cut by column; only what stays above them once rounded takes room from them.
    """
    there = counts > 0
    if counts.shape[1] <= k:
        return there
    sim = np.where(there, counts / (np.sqrt(n_rows)[:, None] * np.sqrt(n_columns)), -1.0)
    kth = np.partition(sim, -k, axis=1)[:, -k][:, None]
    level = sim == kth
    room = k - (sim > kth + MARGIN).sum(1, keepdims=True)
    return there & (~level & (sim >= kth - MARGIN) | level & (np.cumsum(level, axis=1, dtype=np.int32) <= room))


def block_counts(pairs: DataFrame, keep: int | None = None, block: int = BLOCK, rows: int = ROWS) -> DataFrame:
    """pairs (user_id, item), distinct -> (item, neighbor, co, n_i, n_j) in both directions, without the diagonal.

    ``keep``: only what may be among so many most similar neighbours of its item by cosine, where blocks can tell; a superset.
    """
    sized = pairs.where(F.col("user_id").isNotNull() & F.col("item").isNotNull())
    counts = sized.groupBy("item").agg(F.count("*").alias("n"))
    blocks = max(1, math.ceil(counts.count() / block))
    placed = counts.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
    slices = max(1, math.ceil((placed.groupBy("block").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0) / rows))
    held = sized.join(placed, "item").select("user_id", "item", "n", "block")
    touched = held.select("user_id", F.col("block").alias("other")).distinct()
    met = held.join(touched, "user_id").select(
        F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), F.pmod(F.xxhash64("user_id"), F.lit(slices)).alias("slice"),
        "user_id", "item", "n", "block",
    )
    kind = pairs.schema["item"].dataType
    schema = T.StructType([T.StructField("item", kind), T.StructField("neighbor", kind), *[T.StructField(c, T.LongType()) for c in ("co", "n_i", "n_j")]])
    arrow, k = to_arrow_schema(schema), keep if slices == 1 else None

    def count(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        users = table["user_id"].combine_chunks().dictionary_encode().indices.to_numpy()
        sides = []
        for number in dict.fromkeys((low, high)):
            own = np.flatnonzero(table["block"].to_numpy() == number)
            own = own[np.argsort(users[own], kind="stable")]
            part = table.take(pa.array(own))
            items = part["item"].combine_chunks().dictionary_encode()
            order = pc.sort_indices(items.dictionary).to_numpy()  # rows and columns are in the order of items
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            codes = rank[items.indices.to_numpy()]
            n = np.zeros(len(order), np.int64)
            n[codes] = part["n"].to_numpy()
            sides.append((users[own], codes, items.dictionary.take(pa.array(order)), n))
        (ua, ia, names_a, n_a), (ub, ib, names_b, n_b) = sides[0], sides[-1]
        if not len(ua) or not len(ub):
            return arrow.empty_table()
        counts = product(ua, ia, ub, ib, (len(names_a), len(names_b)))
        if low == high:
            np.fill_diagonal(counts, 0)
        out = []
        ways = [(counts, names_a, names_b, n_a, n_b), (counts.T, names_b, names_a, n_b, n_a)][: 1 + (low != high)]
        for table_of, rows_of, columns_of, n_i, n_j in ways:
            x, y = np.nonzero(among_best(table_of, n_i, n_j, k) if k else table_of)
            columns = [rows_of.take(pa.array(x)), columns_of.take(pa.array(y)), pa.array(table_of[x, y]), pa.array(n_i[x]), pa.array(n_j[y])]
            out.append(pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow))
        return pa.concat_tables(out)

    found = met.groupBy("low", "high", "slice").applyInArrow(count, schema)
    if slices > 1:
        found = found.groupBy("item", "neighbor").agg(F.sum("co").alias("co"), F.max("n_i").alias("n_i"), F.max("n_j").alias("n_j"))
    return found
