"""Ranking and retrieval metrics. recs (user_id, item, rank), targets (user_id, item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ideal_dcg(k: int, n_rel: str):
    """Sum of 1 / log2(rank + 1) over the first min(n_rel, k) ranks."""
    gains = F.transform(F.sequence(F.lit(1), F.least(F.lit(k), F.col(n_rel).cast("int"))), lambda r: 1.0 / F.log2(r + 1.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def ranking_metrics(recs: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """By user with targets: precision (over k), recall, hit rate, NDCG, MRR and MAP at k; a short list just hits less."""
    wanted = targets.select("user_id", "item").distinct()
    n_rel = wanted.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    hits = recs.where(F.col("rank") <= k).join(wanted, ["user_id", "item"], "left_semi")
    upto = Window.partitionBy("user_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = hits.withColumn("so_far", F.count("*").over(upto))
    by_user = hits.groupBy("user_id").agg(
        F.count("*").alias("hits"), F.sum(1.0 / F.log2(F.col("rank") + 1.0)).alias("dcg"), F.min("rank").alias("first"), F.sum(F.col("so_far") / F.col("rank")).alias("ap")
    )
    rows = n_rel.join(by_user, "user_id", "left")
    r = lambda c, name: F.round(F.coalesce(c, F.lit(0.0)), 6).alias(name)
    n = F.coalesce("hits", F.lit(0))
    return rows.select(
        "user_id", "n_rel", r(n / k, "precision"), r(n / F.col("n_rel"), "recall"), F.when(n > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        r(F.col("dcg") / ideal_dcg(k, "n_rel"), "ndcg"), r(1.0 / F.col("first"), "mrr"), r(F.col("ap") / F.least(F.col("n_rel"), F.lit(k)), "map"),
    )


METRICS = ("precision", "recall", "hit_rate", "ndcg", "mrr", "map")


def evaluate(recs: DataFrame, targets: DataFrame, cohort: DataFrame, k: int) -> DataFrame:
    """Macro means over users with targets, over all ('all') and by segment."""
    rows = ranking_metrics(recs, targets, k).join(cohort.select("user_id", "segment"), "user_id")
    levels = rows.withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    return levels.groupBy("segment").agg(F.count("*").alias("users"), *[F.round(F.avg(m), 6).alias(m) for m in METRICS])


def catalog_coverage(recs: DataFrame, items: DataFrame, targets: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """One row: share of the catalog shown at k, and share of targets that are in the user's history."""
    shown = recs.where(F.col("rank") <= k).select("item").distinct().agg(F.count("*").alias("shown"))
    size = items.select("item").distinct().agg(F.count("*").alias("items"))
    seen = targets.select("user_id", "item").distinct().join(history.select("user_id", "item").distinct().withColumn("s", F.lit(1)), ["user_id", "item"], "left")
    ratio = seen.agg(F.round(F.avg(F.coalesce("s", F.lit(0))), 6).alias("target_seen_ratio"))
    return shown.crossJoin(size).crossJoin(ratio).select(F.round(F.col("shown") / F.col("items"), 6).alias("coverage"), "target_seen_ratio")  # one row each


def retrieval_metrics(candidates: DataFrame, targets: DataFrame, n_items: int, by: Sequence[str] = ()) -> DataFrame:
    """candidates (user_id, item[, by]): macro recall, share of all targets found, hit rate, mean size, catalog share."""
    wanted = targets.select("user_id", "item").distinct()
    n_rel = wanted.groupBy("user_id").agg(F.count("*").alias("n_rel"))
    lists = candidates.select(*by, "user_id", "item").distinct()
    groups = lists.select(*by).distinct() if by else None
    base = n_rel.crossJoin(groups) if by else n_rel  # a few values of the grouping columns
    size = lists.groupBy(*by, "user_id").agg(F.count("*").alias("size"))
    found = lists.join(wanted, ["user_id", "item"], "left_semi").groupBy(*by, "user_id").agg(F.count("*").alias("hits"))
    rows = base.join(size, [*by, "user_id"], "left").join(found, [*by, "user_id"], "left").na.fill(0, ["size", "hits"])
    out = rows.groupBy(*by).agg(
        F.count("*").alias("users"), F.round(F.avg(F.col("hits") / F.col("n_rel")), 6).alias("macro_recall"), F.round(F.sum("hits") / F.sum("n_rel"), 6).alias("target_coverage"),
        F.round(F.avg(F.when(F.col("hits") > 0, 1.0).otherwise(0.0)), 6).alias("hit_rate"), F.round(F.avg("size"), 6).alias("mean_size"),
    )
    shown = lists.join(n_rel, "user_id", "left_semi").groupBy(*by).agg(F.round(F.count_distinct("item") / n_items, 6).alias("catalog_share"))
    return out.join(shown, list(by), "left") if by else out.crossJoin(shown)  # one row each


def familiarity_metrics(candidates: DataFrame, targets: DataFrame, warm_items: DataFrame) -> DataFrame:
    """Recall of targets on warm and on cold items, by users with such targets."""
    warm = warm_items.select("item").distinct().withColumn("w", F.lit(True))
    wanted = targets.select("user_id", "item").distinct().join(warm, "item", "left").withColumn("familiarity", F.when(F.col("w"), "warm").otherwise("cold")).drop("w")
    hit = candidates.select("user_id", "item").distinct().withColumn("h", F.lit(1))
    rows = wanted.join(hit, ["user_id", "item"], "left").groupBy("familiarity", "user_id").agg(F.count("*").alias("n"), F.count("h").alias("hits"))
    return rows.groupBy("familiarity").agg(
        F.count("*").alias("users"), F.sum("n").alias("targets"), F.round(F.avg(F.col("hits") / F.col("n")), 6).alias("macro_recall"), F.round(F.sum("hits") / F.sum("n"), 6).alias("target_coverage")
    )


def recall_sweep(lists: DataFrame, targets: DataFrame, cohort: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """lists (user_id, source, rank, item): macro recall by budget, source and segment ('all' too)."""
    wanted = targets.select("user_id", "item").distinct().join(cohort.select("user_id", "segment"), "user_id")
    n_rel = wanted.groupBy("user_id", "segment").agg(F.count("*").alias("n_rel"))
    hit = lists.join(wanted, ["user_id", "item"]).groupBy("source", "user_id", "item").agg(F.min("rank").alias("rank"))
    spread = hit.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where(F.col("rank") <= F.col("budget"))
    found = spread.groupBy("budget", "source", "user_id").agg(F.count("*").alias("hits"))
    grid = lists.select("source").distinct().withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    rows = n_rel.crossJoin(grid).join(found, ["budget", "source", "user_id"], "left").na.fill(0, ["hits"])  # a few grid rows
    levels = rows.withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    return levels.groupBy("budget", "source", "segment").agg(F.count("*").alias("users"), F.round(F.avg(F.col("hits") / F.col("n_rel")), 6).alias("macro_recall"))


def loss_decomposition(pool: DataFrame, recs: DataFrame, targets: DataFrame, k: int = 10) -> DataFrame:
    """Mean over users of what retrieval, the list's length and ranking lose, and what is left: they add up to one."""
    wanted = targets.select("user_id", "item").distinct()
    n = wanted.groupBy("user_id").agg(F.count("*").alias("n"))
    got = pool.select("user_id", "item").distinct().join(wanted, ["user_id", "item"], "left_semi").groupBy("user_id").agg(F.count("*").alias("got"))
    hit = recs.where(F.col("rank") <= k).join(wanted, ["user_id", "item"], "left_semi").groupBy("user_id").agg(F.count("*").alias("hit"))
    rows = n.join(got, "user_id", "left").join(hit, "user_id", "left").na.fill(0, ["got", "hit"])
    cap = F.least(F.lit(k), F.col("got"))
    m = lambda c, name: F.round(F.avg(c / F.col("n")), 6).alias(name)
    return rows.agg(F.count("*").alias("users"), m(F.col("n") - F.col("got"), "retrieval_loss"), m(F.col("got") - cap, "capacity_loss"), m(cap - F.col("hit"), "ranking_loss"), m(F.col("hit"), "recall"))


def retrieval_losses(targets: DataFrame, catalog: DataFrame, returned: DataFrame, kept: DataFrame, merged: DataFrame) -> DataFrame:
    """targets (user_id, item, domain): where each got lost, over all ('*') and by domain."""
    flag = lambda df, keys, name: (df.select(*keys).distinct().withColumn(name, F.lit(True)), keys)
    rows = targets.select("user_id", "item", "domain").distinct()
    for df, keys in (flag(catalog, ["item"], "in_catalog"), flag(returned, ["user_id", "item"], "returned"), flag(kept, ["user_id", "item"], "kept"), flag(merged, ["user_id", "item"], "merged")):
        rows = rows.join(df, keys, "left")
    stage = F.when(F.col("in_catalog").isNull(), "not_in_catalog").when(F.col("returned").isNull(), "not_returned").when(F.col("kept").isNull(), "filtered").when(F.col("merged").isNull(), "budget").otherwise("found")
    levels = rows.withColumn("loss", stage).withColumn("domain", F.explode(F.array("domain", F.lit("*"))))
    return levels.groupBy("domain", "loss").agg(F.count("*").alias("targets"))


def hit_losses(a: DataFrame, b: DataFrame, pool_b: DataFrame, kept_b: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """Hits of ranking a that b misses: outside b's pool, filtered in b, or demoted; and b's gains."""
    wanted = targets.select("user_id", "item").distinct()
    top = lambda df, name: df.where(F.col("rank") <= k).join(wanted, ["user_id", "item"], "left_semi").select("user_id", "item", F.lit(True).alias(name))
    rows = top(a, "in_a").join(top(b, "in_b"), ["user_id", "item"], "full")
    rows = rows.join(pool_b.select("user_id", "item").distinct().withColumn("pooled", F.lit(True)), ["user_id", "item"], "left")
    rows = rows.join(kept_b.select("user_id", "item").distinct().withColumn("kept", F.lit(True)), ["user_id", "item"], "left")
    kind = F.when(F.col("in_a") & F.col("in_b"), "both").when(F.col("in_b"), "gained").when(F.col("pooled").isNull(), "outside_pool").when(F.col("kept").isNull(), "filtered").otherwise("demoted")
    return rows.groupBy(kind.alias("kind")).agg(F.count("*").alias("hits"))


def cf_links(pairs: DataFrame, sim: DataFrame, kept: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """pairs (item, neighbor): no co-occurrence, in the kept neighbours, tied with the last kept one, or below it."""
    cut = kept.groupBy("item").agg(F.min("sim").alias("cut"))
    rows = pairs.join(sim, ["item", "neighbor"], "left").join(kept.select("item", "neighbor", F.lit(True).alias("in_cache")), ["item", "neighbor"], "left").join(cut, "item", "left")
    kind = F.when(F.col("sim").isNull(), "no_cooccurrence").when(F.col("in_cache"), "in_cache").when(F.abs(F.col("sim") - F.col("cut")) <= tolerance, "tied_cutoff").otherwise("below_cutoff")
    return rows.groupBy(kind.alias("link")).agg(F.count("*").alias("pairs"))


def support_buckets(train: DataFrame, targets: DataFrame, retrieved: DataFrame, top: DataFrame) -> DataFrame:
    """Target pairs by the number of train users of the item: how many are retrieved, and in the top list."""
    support = train.groupBy("item").agg(F.count_distinct("user_id").alias("n"))
    rows = targets.select("user_id", "item").distinct().join(support, "item", "left")
    for df, name in ((retrieved, "retrieved"), (top, "top")):
        rows = rows.join(df.select("user_id", "item").distinct().withColumn(name, F.lit(1)), ["user_id", "item"], "left")
    n = F.coalesce("n", F.lit(0))
    bucket = F.when(n == 0, "0").when(n < 5, "1-4").when(n < 20, "5-19").otherwise("20+")
    return rows.groupBy(bucket.alias("support")).agg(F.count("*").alias("pairs"), F.count("retrieved").alias("retrieved"), F.count("top").alias("top"))


def sample_users(cohort: DataFrame, n: int, seed: int = 0, exclude: DataFrame | None = None) -> DataFrame:
    """n users of each segment by a hash, without those of earlier cohorts."""
    rows = cohort if exclude is None else cohort.join(exclude.select("user_id"), "user_id", "left_anti")
    order = Window.partitionBy("segment").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "user_id")), "user_id")
    return rows.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def first_users(cohort: DataFrame, n: int, index: str) -> DataFrame:
    order = Window.partitionBy("segment").orderBy(index)
    return cohort.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")


def score_ties(scores: DataFrame, k: int) -> DataFrame:
    """By user: pairs of equal scores, and whether the score at rank k goes on beyond it."""
    groups = scores.groupBy("user_id", "score").agg(F.count("*").alias("n"), F.min("rank").alias("low"), F.max("rank").alias("high"))
    return groups.groupBy("user_id").agg(
        F.sum(F.floor(F.col("n") * (F.col("n") - 1) / 2)).alias("tie_pairs"), F.coalesce(F.max((F.col("low") <= k) & (F.col("high") > k)), F.lit(False)).alias("boundary_tie")
    )


def ranking_summary(ranked: DataFrame, targets: DataFrame, history: DataFrame, k: int) -> DataFrame:
    """By merge, scorer and segment: targets seen before, what filtering takes away, and ties.

    ranked (merge, scorer, segment, user_id, item, score, status): status is ranked or beyond_k for what was scored and
    kept, else why it was not. Targets that the user has in the history are repeats; rates of ties are means over users.
    """
    keys = ["merge", "scorer", "segment"]
    kept = F.col("status").isin("ranked", "beyond_k")
    users = ranked.groupBy(*keys, "user_id").agg(
        F.count("*").alias("candidates"), F.count_if(F.col("status") == "seen").alias("seen"), F.count_if(F.col("status") == "unscored").alias("unscored"),
        F.count_if(F.col("status") == "hidden").alias("hidden"), F.count_if(F.col("status") == "ranked").alias("returned"), F.count_if(kept).alias("kept"),
    )
    runs = ranked.where(kept).groupBy(*keys, "user_id", "score").agg(F.count("*").alias("n"))
    above = F.sum("n").over(Window.partitionBy(*keys, "user_id").orderBy(F.desc("score")))
    runs = runs.withColumn("upto", above).groupBy(*keys, "user_id").agg(
        F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("tie_pairs"), F.max(((F.col("upto") > k) & (F.col("upto") - F.col("n") < k)).cast("int")).alias("boundary")
    )
    return summary_of(users.join(runs, [*keys, "user_id"], "left").na.fill(0, ["tie_pairs", "boundary"]), targets, history)


def summary_of(users: DataFrame, targets: DataFrame, history: DataFrame) -> DataFrame:
    """As ``ranking_summary``, from counts by user: candidates, seen, unscored, hidden, returned, kept, tie_pairs, boundary."""
    keys = ["merge", "scorer", "segment"]
    seen = targets.select("user_id", "item").distinct().join(history.select("user_id", "item", F.lit(1).alias("s")).distinct(), ["user_id", "item"], "left")
    per_target = seen.groupBy("user_id").agg(F.count("*").alias("targets"), F.count("s").alias("repeats"))
    rows = users.join(per_target, "user_id", "left").na.fill(0, ["targets", "repeats"])
    pairs = F.col("kept") * (F.col("kept") - 1) / 2
    rate = lambda a, b: F.round(F.sum(a) / F.greatest(F.sum(b), F.lit(1)), 6)
    lost = F.col("seen") + F.col("unscored") + F.col("hidden")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("users"), F.count_if(F.col("targets") > F.col("repeats")).alias("users_with_unseen_targets"), F.sum("repeats").alias("repeat_pairs"),
        F.round(F.avg(F.col("repeats") / F.greatest("targets", F.lit(1))), 6).alias("repeat_fraction"), F.sum("candidates").alias("candidates"), F.sum("returned").alias("returned"),
        rate(F.col("seen"), F.col("candidates")).alias("seen_loss_rate"), rate(F.col("unscored"), F.col("candidates")).alias("unscored_loss_rate"), rate(lost, F.col("candidates")).alias("total_loss_rate"),
        F.round(F.avg(F.when(pairs > 0, F.col("tie_pairs") / pairs).otherwise(0.0)), 6).alias("tie_pair_rate"), F.round(F.avg("boundary"), 6).alias("boundary_tie_rate"),
    )
