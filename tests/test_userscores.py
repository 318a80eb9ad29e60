"""Work on users' scores where they are summed, against the plain joins and windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from merrow.operators import cf, metrics, userscores


def world(spark):
    rng = random.Random(9)
    pairs = sorted({(f"u{u}", int(40 * rng.random() ** 2) * 10**9) for u in range(70) for _ in range(rng.randint(1, 9))})
    history = spark.createDataFrame([*pairs, ("lonely", 77), ("all", 0), *(("all", i * 10**9) for i in range(1, 40))], "user_id string, item long")
    sim = cf.top_neighbors(cf.item_cosine(spark.createDataFrame(pairs, "user_id string, item long")), 6).cache()
    return history.cache(), sim, cf.knn_scores(history, sim).cache()


def rows(df, *columns):
    return sorted(tuple("" if r[c] is None else r[c] for c in columns) for r in df.collect())


def test_scores_lists_and_lookups(spark):
    history, sim, scores = world(spark)
    for slice_of, at_once in ((250_000, 10**6), (25, 30)):
        own = lambda work, schema, asked=None: userscores.per_user(history, sim, work, schema, asked, None, slice_of, at_once).cache()  # noqa: B023, E731
        assert rows(own(userscores.every, "item long, score double"), "user_id", "item", "score") == rows(scores, "user_id", "item", "score")
        lists, want = own(userscores.top(3), "item long, score double, rank int"), cf.topk(scores, history, 3)
        assert rows(lists.where("rank IS NOT NULL"), "user_id", "item", "score", "rank") == rows(want, "user_id", "item", "score", "rank")
        best = scores.groupBy("user_id").agg(F.max("score").alias("score"))
        assert rows(lists.where("rank IS NULL"), "user_id", "score") == rows(best, "user_id", "score")
        for asked in (history.select("user_id", ((F.col("item") + 10**9) % (40 * 10**9)).alias("item")).distinct(), lambda items: F.array_distinct(F.transform(items, lambda x: (x + 10**9) % (40 * 10**9)))):
            found = own(userscores.looked_up(3), "item long, score double, best double, seen boolean, rank int", asked)
            pairs = history.select("user_id", ((F.col("item") + 10**9) % (40 * 10**9)).alias("item")).distinct()
            ranks = cf.topk(scores, history, 3).select("user_id", "item", "rank")
            plain = pairs.join(scores, ["user_id", "item"]).join(best.withColumnRenamed("score", "best"), "user_id").join(history.withColumn("seen", F.lit(True)), ["user_id", "item"], "left").join(ranks, ["user_id", "item"], "left").na.fill(False, ["seen"])
            assert rows(found, "user_id", "item", "score", "best", "seen", "rank") == rows(plain, "user_id", "item", "score", "best", "seen", "rank")


def test_ties_and_outcomes(spark):
    history, sim, scores = world(spark)
    asked = lambda items: F.array_union(items, F.array_distinct(F.transform(items, lambda x: x + 3)))
    shown = lambda x: (x / 10**9).cast("long") % 5 != 0
    every = scores.select("user_id", "item").union(history).union(history.select("user_id", F.col("item") + 3)).distinct()
    every = every.withColumn("pos", F.row_number().over(Window.partitionBy("user_id").orderBy("item")))
    status = cf.rank_candidates(every, scores, every.select("item").distinct().where(shown(F.col("item"))).withColumn("domain", F.lit("D")), history, 4).cache()
    names = "candidates seen unscored hidden returned kept tie_pairs boundary".split()
    for slice_of, at_once in ((250_000, 10**6), (25, 30)):
        ties = userscores.per_user(history, sim, userscores.tied(4), "tie_pairs long, boundary_tie boolean", None, None, slice_of, at_once)
        assert rows(ties, "user_id", "tie_pairs", "boundary_tie") == rows(metrics.score_ties(cf.topk(scores, history, 1 << 30), 4), "user_id", "tie_pairs", "boundary_tie")
        made = userscores.per_user(history, sim, userscores.outcomes(4), ", ".join(f"{n} long" for n in names), asked, shown, slice_of, at_once).cache()
        notes = made.select("user_id", F.col("returned").alias("ranked"), "seen", "hidden", "unscored").withColumn("note", cf.empty_note())
        assert rows(notes, *notes.columns) == rows(cf.empty_reason(status), *notes.columns)
        tag = lambda df: df.withColumn("merge", F.lit("m")).withColumn("scorer", F.lit("s")).withColumn("segment", F.substring("user_id", 1, 2))
        targets = history.where("item % 3 = 0")
        got, want = metrics.summary_of(tag(made), targets, history), metrics.ranking_summary(tag(status), targets, history, 4)
        assert rows(got, *want.columns) == rows(want, *want.columns)


def test_scores_are_not_shuffled(spark):
    """Before, each score of each pair of an item and a neighbour was a row between the join and the sum."""
    history, sim, _ = world(spark)
    plan = userscores.per_user(history, sim, userscores.top(3), "item long, score double, rank int")._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan.splitlines()[0] and "Aggregate" not in plan.splitlines()[1]


def test_no_neighbours_and_no_users(spark):
    history, sim, _ = world(spark)
    lists = lambda h, s: userscores.per_user(h, s, userscores.top(3), "item long, score double, rank int").count()
    assert lists(history, sim.where("false")) == 0 and lists(history.where("false"), sim) == 0
    made = userscores.per_user(history, sim.where("false"), userscores.outcomes(3), "candidates long, seen long, unscored long, hidden long, returned long, kept long, tie_pairs long, boundary long")
    assert made.count() == history.select("user_id").distinct().count()
