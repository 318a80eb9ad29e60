"""The nearest items from packed histories against plain counting, at any number of ranges and slices."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from merrow.operators import nearest

from .test_itemblocks import plain


def wanted(pairs, k):
    n, near = {}, {}
    for _, i in pairs:
        n[i] = n.get(i, 0) + 1
    for (i, j), c in plain(pairs).items():
        near.setdefault(i, []).append((-round(c / (math.sqrt(n[i]) * math.sqrt(n[j])), 9), j))
    return {(i, r, j, -s) for i, found in near.items() for r, (s, j) in enumerate(sorted(found)[:k], 1)}


def rows(df):
    return {(r.item, r["rank"], r.neighbor, r.sim) for r in df.collect()}


def test_ranges_and_slices_give_the_same_lists(spark):
    rng = random.Random(3)
    # far apart and negative numbers, one item that everybody has
    pairs = sorted({(f"u{u}", i) for u in range(60) for i in [7, *(int(50 * rng.random() ** 2) * 10**12 - 5 for _ in range(rng.randint(0, 9)))]})
    df = spark.createDataFrame(pairs, "user_id string, item long")
    for held in (10**6, 60, 9):
        assert rows(nearest.nearest(df, 4, held)) == wanted(pairs, 4)
    assert nearest.nearest(df.where("false"), 4).count() == 0


def test_kinds_of_items(spark):
    pairs = [(1, "b"), (1, "a"), (2, "a"), (2, "b"), (2, "c"), (None, "a"), (3, None)]
    got = rows(nearest.nearest(spark.createDataFrame(pairs, "user_id int, item string"), 1))
    assert got == {("a", 1, "b", 1.0), ("b", 1, "a", 1.0), ("c", 1, "a", 0.707106781)}
    ints = nearest.nearest(spark.createDataFrame([(1, 2), (1, 3)], "user_id int, item int"), 1)
    assert dict(ints.dtypes)["item"] == "int" and rows(ints) == {(2, 1, 3, 1.0), (3, 1, 2, 1.0)}


def test_histories_are_sent_packed_and_once_a_range(spark):
    """Users of 40 items in groups that share no item: before, each item went to every block that its user touched."""
    pairs = spark.range(200 * 40).select((F.col("id") / 40).cast("long").alias("user_id"), (F.floor(F.col("id") / 400) * 100 + (F.col("id") * 7) % 100).alias("item")).distinct()
    counts = pairs.groupBy("item").agg(F.count("*").alias("n"))
    folded, n = nearest.histories(pairs, counts), pairs.count()
    weights = [(r.item, r.n) for r in counts.orderBy("item").collect()]
    many, few = nearest.loads(folded, [nearest.cut(weights, 20), nearest.cut(weights, 4)])
    assert sum(many.values()) <= 2.1 * n and sum(few.values()) <= 1.3 * n
    size = sum(len(r.items) + len(r.n) + len(r.sizes) for r in folded.collect())
    assert size < 3 * n, (size, n)


def test_best_and_rounding():
    at, rank = nearest.best_of(np.array([3, 3, 3, 5, 5]), np.array([1, 9, 9, 0, 4]), 2)
    assert at.tolist() == [1, 2, 4, 3] and rank.tolist() == [1, 2, 1, 2]
    at, _ = nearest.best_of(np.array([1, 1, 1]), np.array([5, 5, 6]), 2)
    assert at.tolist() == [2, 0]
    assert nearest.rounded(np.array([0.1234567885, 0.1234567895, 1.0, 0.3])).tolist() == [123456789, 123456790, 10**9, 3 * 10**8]


def test_a_written_table_leaves_no_shuffle_behind(spark):
    from merrow.functions.storage import stored

    left = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    before = left()
    made = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "test")
    assert left() == before and made.count() == 7
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
