"""Item-item counts in blocks against plain counting; one user with very many items."""

import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from merrow.operators import cf
from merrow.operators.itemblocks import among_best, block_counts


def plain(pairs):
    of = {}
    for u, i in pairs:
        of.setdefault(u, set()).add(i)
    return Counter(p for items in of.values() for p in permutations(sorted(items), 2))


def test_counts_and_neighbours_at_any_block_size(spark):
    rng = random.Random(1)
    pairs = sorted({(f"u{rng.randrange(40)}", int(60 * rng.random() ** 2)) for _ in range(500)})
    df, want = spark.createDataFrame(pairs, "user_id string, item long"), plain(pairs)
    n = Counter(i for _, i in pairs)
    for block, rows in ((2048, 10**6), (7, 10**6), (10, 40), (1, 10)):
        got = {(r.item, r.neighbor): (r.co, r.n_i, r.n_j) for r in block_counts(df, None, block, rows).collect()}
        assert got == {(i, j): (c, n[i], n[j]) for (i, j), c in want.items()}
        kept = {(r.item, r.neighbor) for r in block_counts(df, 3, block, rows).collect()}
        near = {}
        for (i, j), c in want.items():
            near.setdefault(i, []).append((-round(c / (math.sqrt(n[i]) * math.sqrt(n[j])), 9), j))
        assert all((i, j) in kept for i, found in near.items() for _, j in sorted(found)[:3])
    assert block_counts(df.where("false")).count() == 0
    best = {(r.item, r["rank"]): r.neighbor for r in cf.nearest_items(df, 3).collect()}
    assert best == {(i, r): j for i, found in near.items() for r, (_, j) in enumerate(sorted(found)[:3], 1)}


def test_other_kinds_of_keys_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (None, "a"), (3, None)], "user_id int, item string")
    assert sorted(map(tuple, block_counts(df, block=1).collect())) == [("a", "b", 2, 2, 2), ("b", "a", 2, 2, 2)]


def test_one_user_of_twenty_thousand_items(spark):
    light = spark.range(200).select((F.col("id") + 1).alias("user_id"), F.explode(F.array(F.col("id"), F.col("id") + 1)).alias("item"))
    pairs = spark.range(20_000).select(F.lit(0).cast("long").alias("user_id"), F.col("id").alias("item")).unionByName(light)
    best = {r.item: (r.neighbor, r.sim) for r in cf.nearest_items(pairs, 1).collect()}
    assert len(best) == 20_000
    assert best[0][0] == 1 and best[300] == (201, 1.0) and best[201] == (202, 1.0)  # ties go to the smaller item


def test_left_out_histories_count_in_norms(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "user_id long, item long")
    sim = {(r.item, r.neighbor): r.sim for r in cf.item_cosine(df, max_history=2).collect()}
    assert sim == {(1, 2): 0.5, (2, 1): 0.5}


def test_ties_that_only_rounding_makes_go_to_the_smaller_item(spark):
    """2 / sqrt(22 * 16) and 3 / sqrt(22 * 36) are equal, but differ in the last bit as doubles."""
    counts, n = np.array([[2, 2, 3, 1]]), np.array([16, 16, 36, 30])
    assert among_best(counts, np.array([22]), n, 2).tolist() == [[True, True, True, False]]
    holders = {0: range(22), 1: [0, 1, *range(100, 114)], 2: [2, 3, *range(200, 214)], 3: [4, 5, 6, *range(300, 333)]}
    pairs = spark.createDataFrame([(u, i) for i, users in holders.items() for u in users], "user_id long, item long")
    for k, want in ((1, [1]), (2, [1, 2]), (3, [1, 2, 3])):
        best = cf.nearest_items(pairs, k).where("item = 0").orderBy("rank").collect()
        assert [r.neighbor for r in best] == want and {r.sim for r in best} == {0.106600358}
