"""Plain versions of ranks, draws, factors, mappings, arms and claims on small inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from merrow.functions.draws import draw
from merrow.operators import cf, compare, factors, grounding, ids, quantiles, stats
from merrow.operators.split import temporal_cutoffs


def test_percentiles_and_running_sums_over_many_partitions(spark):
    rng = random.Random(3)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 9])) for _ in range(400)] + [("one", 4.0)]
    df = spark.createDataFrame(data, "g string, x double").repartition(7)
    got = {r.g: r.p for r in quantiles.percentiles(df, "x", [0.0, 0.37, 0.5, 0.95, 1.0], ["g"]).collect()}
    for g in ("a", "b", None, "one"):
        want = np.percentile([x for k, x in data if k == g and x is not None], [0, 37, 50, 95, 100])
        assert np.allclose(got[g], want)
    counts = df.where("x IS NOT NULL").groupBy("x").agg(F.count("*").alias("t"))
    upto = {r.x: r.upto for r in quantiles.cumulative(counts, "x").collect()}
    assert upto == {x: sum(y is not None and y <= x for _, y in data) for x in {x for _, x in data if x is not None}}
    ranks = {r.x: r["rank"] for r in stats.average_ranks(df.where("x IS NOT NULL"), "x").collect()}
    assert ranks[1.0] == (1 + upto[1.0]) / 2 if min(upto) == 1.0 else ranks[1.0] > 1


def test_cutoffs_within_a_second(spark):
    times = sorted(random.Random(5).choices(range(10**12, 10**12 + 2500), k=60) + [10**12 + 86_400_000 * i for i in range(5)])
    df = spark.createDataFrame([(t,) for t in times], "ts long").repartition(3)
    assert temporal_cutoffs(df) == (times[int(65 * 0.8) - 1], times[int(65 * 0.9) - 1])


def test_mappings_are_checked_when_read(spark, tmp_path):
    keys = spark.createDataFrame([("b",), ("a",), ("b",)], "k string")
    ids.save_ids(ids.build_sorted_ids(keys, "k"), f"{tmp_path}/m")
    assert sorted(map(tuple, ids.load_ids(spark, f"{tmp_path}/m", "k").collect())) == [("a", 0), ("b", 1)]
    for i, rows in enumerate([[("a", 0), ("b", 2)], [("a", 0), ("a", 1)], [("a", 0), (None, 1)], [("a", 1)]]):
        ids.save_ids(spark.createDataFrame(rows, "k string, idx long"), f"{tmp_path}/bad{i}")
        with pytest.raises(ValueError):
            ids.load_ids(spark, f"{tmp_path}/bad{i}", "k")
    with pytest.raises(ValueError):
        ids.load_ids(spark, f"{tmp_path}/m", "other")


def test_random_lists_are_full(spark):
    users = spark.createDataFrame([(f"u{i}",) for i in range(40)], "user_id string")
    for n in (1, 2, 9, 10, 25):
        items = spark.range(n).select((F.col("id") + 100).alias("item"), F.col("id").alias("idx"))
        lists = {}
        for r in cf.random_topk(users, items, 10).collect():
            lists.setdefault(r.user_id, []).append((r["rank"], r.item))
        assert len(lists) == 40 and all([k for k, _ in sorted(x)] == list(range(1, min(10, n) + 1)) and len({i for _, i in x}) == min(10, n) for x in lists.values())
    assert len({tuple(sorted(x)) for x in lists.values()}) > 20


def test_draws_are_even(spark):
    low = spark.range(8000).select(draw(F.col("id"), F.lit("x")).alias("d")).agg(F.avg((F.col("d") < 2**39).cast("int")), F.max("d")).first()
    assert abs(low[0] - 0.5) < 0.03 and low[1] < 2**40
    assert stats.poisson_steps()[0] == round(math.exp(-1) * 2**40) and stats.poisson_steps()[-1] >= 2**40 - 1


def test_factors_against_plain_loops(spark):
    rng = random.Random(2)
    pairs = spark.createDataFrame(sorted({(f"u{rng.randrange(6)}", rng.randrange(9)) for _ in range(30)}), "user_id string, item int")
    dim, rate, reg, epochs = 3, 0.05, 0.01, 2
    users = {r.user_id: np.array(r.f) for r in factors.start(pairs.select("user_id").distinct(), "user_id", dim, 0).collect()}
    items = {r.item: [np.array(r.f), r.bias] for r in factors.start(pairs.select("item").distinct(), "item", dim, 1).collect()}
    for epoch in range(epochs):
        du, di = {}, {}
        for t in factors.sample_triples(pairs, epoch, 0).collect():
            u, (p, bp), (q, bq) = users[t.user_id], items[t.item], items[t.negative]
            g = 1 / (1 + math.exp(u @ p - u @ q + bp - bq))
            du[t.user_id] = du.get(t.user_id, 0) + g * (p - q)
            for key, sign in ((t.item, 1), (t.negative, -1)):
                d, b = di.get(key, (0, 0))
                di[key] = d + sign * g * u, b + sign * g
        users = {k: f + rate * (du[k] - reg * f) if k in du else f for k, f in users.items()}
        items = {k: [f + rate * (di[k][0] - reg * f), b + rate * (di[k][1] - reg * b)] if k in di else [f, b] for k, (f, b) in items.items()}
    made_users, made_items, _ = factors.bpr_fit(pairs, dim, rate, reg, epochs)
    assert all(np.allclose(r.f, users[r.user_id]) for r in made_users.collect())
    assert all(np.allclose(r.f, items[r.item][0]) and abs(r.bias - items[r.item][1]) < 1e-9 for r in made_items.collect())
    top = {}
    for r in factors.factor_topk(made_users, made_items, pairs, 3, block=4).collect():
        top.setdefault(r.user_id, []).append((r["rank"], r.item))
    seen = {(r.user_id, r.item) for r in pairs.collect()}
    for u, f in users.items():
        order = sorted((-round(float(f @ p + b), 9), i) for i, (p, b) in items.items() if (u, i) not in seen)
        assert [i for _, i in sorted(top.get(u, []))] == [i for _, i in order[:3]]


def test_arms_are_disjoint(spark):
    cohort = spark.createDataFrame([(f"u{i}", "warm" if i % 3 else "cold") for i in range(20)] + [("x", "sparse")], "user_id string, segment string")
    arms = compare.tuning_arms(cohort, 4).collect()
    assert len({r.user_id for r in arms}) == len(arms)
    assert {(s, a): sum(r.segment == s and r.arm == a for r in arms) for s in ("warm", "cold", "sparse") for a in ("tuning", "confirmation")} == {
        ("warm", "tuning"): 4, ("warm", "confirmation"): 4, ("cold", "tuning"): 3, ("cold", "confirmation"): 3, ("sparse", "tuning"): 0, ("sparse", "confirmation"): 0
    }


def test_claims_and_grounding_by_hand(spark):
    items = spark.createDataFrame([("D::A1", "D", "red wool scarf 40 cm", 12.5, 4.0, 10.0, "Shop", "Clothes"), ("D::A2", "D", "blue cap", None, 3.0, None, None, "Clothes")],
        "item_id string, domain string, title string, price double, average_rating double, rating_number double, store string, main_category string")
    text = "Here are some things. D::A1 costs $12.50. This red scarf is sold by Shop. It has great colors. The blue cap has 10 reviews. D::A9 is rated 4/5. Code B0ABCDEFGH costs $40."
    answers = spark.createDataFrame([(1, text, ["D::A1", "D::A2"], "up to 20")], "answer_id int, text string, item_ids array<string>, request_text string")
    got = [(r.no, r.item_id, r.claim, r.verdict) for r in grounding.claims(answers, items).orderBy("no").collect()]
    assert got == [(1, "D::A1", "price", "supported"), (2, "D::A1", "store", "supported"), (3, None, "other", "unknown_item"), (4, "D::A2", "reviews", "unsupported"), (5, "D::A9", "rating", "unknown_item"), (6, None, "price", "unknown_item")]
    r = grounding.check_grounding(answers, items).first()
    assert (r.foreign_ids, r.bare_codes, r.wrong_prices, r.wrong_ratings, r.grounded) == (1, 1, 0, 0, False)
