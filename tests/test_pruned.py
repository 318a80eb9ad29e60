"""Pruned search against the search that scores every match."""

import random

from pyspark.sql import functions as F

from merrow.functions.storage import Scratch
from merrow.operators import pruned, text


def zipf_docs(n, seed, words=400):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    return [(i, " ".join(f"w{x}" for x in rng.choices(range(words), weights, k=rng.choice([3, 10, 40, 160])))) for i in range(n)]


def asked(spark, rng, n, words=400):
    rows = [(q, f"w{min(int(rng.paretovariate(0.4)), words + 5)}") for q in range(n) for _ in range(rng.randint(1, 12))]
    return spark.createDataFrame(rows, "query_id long, token string")


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_same_lists_as_scoring_every_match(spark):
    docs = zipf_docs(1200, 3)
    docs += [(5000 + i, docs[i][1]) for i in range(40)]  # copies: ties
    postings = text.build_postings(spark.createDataFrame(docs, "id long, text string"), "id", "text").cache()
    queries = asked(spark, random.Random(4), 12)
    shape = "query_id", "rank", "id", "score"
    for limit, block, seeds in [(5, 16, 2), (300, 64, 1), (5000, 64, 8)]:
        want = text.bm25_search(postings, queries, limit)
        assert rows(pruned.search(postings, queries, limit, block=block, seeds=seeds), *shape) == rows(want, *shape)
    visible = spark.range(0, 6000, 3).toDF("id")
    assert rows(pruned.search(postings, queries, 10, visible, 16), *shape) == rows(text.bm25_search(postings, queries, 10, visible), *shape)


def test_most_postings_are_left_out(spark):
    postings = text.build_postings(spark.createDataFrame(zipf_docs(3000, 9), "id long, text string"), "id", "text").cache()
    # each query has a rare word, which decides, and frequent ones
    queries = spark.createDataFrame([(q, f"w{x}") for q in range(10) for x in (150 + 20 * q, 4, 6, 9, 12)], "query_id long, token string")
    job = Scratch(spark, "test")
    index = pruned.block_index(job, postings, tokens=queries, block=16)
    met = pruned.asked_bounds(job, index, queries)
    split = pruned.needed_tokens(met, pruned.kth_of_best_blocks(index, met, 5)).cache()
    hits = lambda df: index.rows.join(df.select("query_id", "token", "block"), ["token", "block"]).count()
    share = hits(split.where("needed")) / hits(met)
    assert share < 0.25, share
    assert met.count() < 0.6 * hits(met)  # bounds are fewer than postings
    largest = index.rows.join(postings.select("id", "dl").distinct(), "id").groupBy("block").agg(F.countDistinct("id").alias("n"), F.min("dl").alias("a"), F.max("dl").alias("b"))
    assert all(r.n <= 48 and r.b <= 1.5 * r.a + 1 for r in largest.collect())
    job.drop()


def test_ranks_of_targets(spark):
    docs = zipf_docs(600, 5)
    docs += [(1000 + i, docs[i][1]) for i in range(100)]
    postings = text.build_postings(spark.createDataFrame(docs, "id long, text string"), "id", "text").cache()
    queries, rng = asked(spark, random.Random(6), 10), random.Random(7)
    targets = spark.createDataFrame([(q, rng.choice(docs)[0]) for q in range(12) for _ in range(6)] + [(3, 77777)], "query_id long, id long").distinct()
    got = rows(pruned.rank_of(postings, queries, targets).fillna({"rank": -1}), "query_id", "id", "rank", "place")
    assert got == rows(text.bm25_rank_of(postings, queries, targets).fillna({"rank": -1}), "query_id", "id", "rank", "place")
    assert {"no_match", "inside", "outside"} == {r[3] for r in got}


def test_empty_and_null(spark):
    postings = text.build_postings(spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (None, "a"), (4, "a")], "id long, text string"), "id", "text")
    queries = spark.createDataFrame([(1, "a"), (1, "a"), (2, "zz"), (None, "a"), (3, None)], "query_id long, token string")
    # a word of all documents weighs next to nothing: equal after rounding, so by identifier
    assert rows(pruned.search(postings, queries, 3), "query_id", "id", "rank") == [(1, 1, 1), (1, 4, 2)]
    assert pruned.search(postings.where("false"), queries, 3).count() == 0
    assert pruned.search(postings, queries.where("false"), 3).count() == 0
    assert rows(pruned.rank_of(postings, queries, spark.createDataFrame([(1, 4), (2, 4)], "query_id long, id long")), "query_id", "id", "place") == [(1, 4, "inside"), (2, 4, "no_match")]


def test_identifiers_as_text(spark):
    docs = [(f"D::{i}", t) for i, t in zipf_docs(200, 8)]
    postings = text.build_postings(spark.createDataFrame(docs, "id string, text string"), "id", "text")
    queries = asked(spark, random.Random(1), 4)
    assert rows(pruned.search(postings, queries, 7, block=8), "query_id", "rank", "id") == rows(text.bm25_search(postings, queries, 7), "query_id", "rank", "id")
