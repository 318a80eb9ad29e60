"""Collaborative filtering: popularity, item-item similarity, scores, top-k lists with fillers, hybrids.

Pairs are (user_id, item) with item a dense index; scores are (user_id, item, score); lists add rank from 1.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.draws import draw

from .itemblocks import block_counts
from .nearest import nearest

DIGITS, SHORT = 9, 20_000


def pairs_of(df: DataFrame, user: str = "user_id", item: str = "item") -> DataFrame:
    return df.select(F.col(user).alias("user_id"), F.col(item).alias("item")).distinct()


def matrix_shape(df: DataFrame) -> DataFrame:
    return df.agg((F.max("user_idx") + 1).alias("n_users"), (F.max("item_idx") + 1).alias("n_items"))


def popularity(df: DataFrame, mode: str = "events") -> DataFrame:
    """(item, pop, place): events, or distinct users; places from 0 by pop down, index up.

    The place is a range-partitioned sort with offsets, not a window over all items in one task.
    """
    from .ids import dense_rank_ids

    if mode not in ("events", "users"):
        raise ValueError("mode is 'events' or 'users'")
    counts = df.groupBy("item").agg((F.count("*") if mode == "events" else F.count_distinct("user_id")).alias("pop"))
    places = dense_rank_ids(counts, "item", F.struct(-F.col("pop"), F.col("item")))
    return counts.join(places.withColumnRenamed("idx", "place"), "item")


def cooccurrence(pairs: DataFrame, max_history: int | None = None) -> DataFrame:
    """(item, neighbor, co) without the diagonal, counted in blocks of items.

    ``max_history`` leaves out users with longer histories, for callers that want it.
    """
    return block_counts(_light(pairs, max_history)).select("item", "neighbor", "co")


def _light(pairs: DataFrame, max_history: int | None) -> DataFrame:
    if max_history is None:
        return pairs
    light = pairs.groupBy("user_id").agg(F.count("*").alias("n")).where(F.col("n") <= max_history).select("user_id")
    return pairs.join(light, "user_id", "left_semi")


def item_cosine(pairs: DataFrame, max_history: int | None = None, keep: int | None = None) -> DataFrame:
    """(item, neighbor, sim): co / (sqrt(n_i) * sqrt(n_j)); ``keep``: what may be among so many best of an item, at least.

    With ``max_history`` the users that are left out count in n_i and n_j all the same.
    """
    if max_history is None:
        co = block_counts(pairs, keep)
    else:
        counts = pairs.groupBy("item").agg(F.count("*").alias("n"))
        co = cooccurrence(pairs, max_history).join(counts.withColumnRenamed("n", "n_i"), "item")
        co = co.join(counts.select(F.col("item").alias("neighbor"), F.col("n").alias("n_j")), "neighbor")
    return co.select("item", "neighbor", F.round(F.col("co") / (F.sqrt("n_i") * F.sqrt("n_j")), DIGITS).alias("sim"))


def nearest_items(pairs: DataFrame, k: int = 20) -> DataFrame:
    """(item, neighbor, sim, rank): the k most similar neighbours of each item, ties to the smaller one."""
    return nearest(pairs, k)


def top_neighbors(sim: DataFrame, k: int = 20) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("sim"), "neighbor")
    return sim.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exact_sum(sim: str = "sim") -> Column:
    """A sum of similarities at six digits, by way of integers: the same in whatever order it is taken."""
    return F.expr(f"(sum(cast(round({sim} * 1e9) as bigint)) + 500) div 1000") / 1e6


def knn_scores(history: DataFrame, sim: DataFrame, orientation: str = "runtime") -> DataFrame:
    """runtime: i among the neighbours of the history's items; matrix: the history's items among the neighbours of i."""
    at, to = ("item", "neighbor") if orientation == "runtime" else ("neighbor", "item")
    rows = sim.select(F.col(at).alias("_j"), F.col(to).alias("_i"), "sim")
    found = history.join(rows, history.item == rows["_j"])
    return found.groupBy("user_id", F.col("_i").alias("item")).agg(exact_sum().alias("score"))


def similar_items(sim: DataFrame, seeds: DataFrame, k: int, domains: DataFrame | None = None) -> DataFrame:
    """seeds (request_id, item): summed rows of the seeds, without them, restricted by domains (request_id, item) before the cut."""
    rows = seeds.join(sim, "item").groupBy("request_id", F.col("neighbor").alias("item")).agg(exact_sum().alias("score"))
    rows = rows.join(seeds, ["request_id", "item"], "left_anti")
    if domains is not None:
        rows = rows.join(domains, ["request_id", "item"], "left_semi")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def unknown_seeds(sim: DataFrame, seeds: DataFrame) -> DataFrame:
    return seeds.join(sim.select("item").distinct(), "item", "left_anti")


def ranked(scores: DataFrame, k: int, by: str = "user_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "item")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def topk(scores: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """The k best unseen items of each user, ties to the smaller index."""
    return ranked(scores.join(seen, ["user_id", "item"], "left_anti"), k)


def filled(lists: DataFrame, users: DataFrame, seen: DataFrame, order: DataFrame, k: int) -> DataFrame:
    """lists (user_id, item, rank) filled up to k from order (kind, place, item); users (user_id, kind).

    A user needs at most k plus the number of seen and listed items of its order, so only those places are looked at.
    All users look at the first places: up to ``SHORT`` of them are broadcast, more are joined by shuffle, where
    adaptive execution splits a place that many users share.
    """
    n_seen = seen.groupBy("user_id").agg(F.count("*").alias("n_seen"))
    n_have = lists.groupBy("user_id").agg(F.count("*").alias("n_have"))
    need = users.join(n_seen, "user_id", "left").join(n_have, "user_id", "left").na.fill(0, ["n_seen", "n_have"])
    places = need.where(F.col("n_have") < k).select("user_id", "kind", "n_have", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_seen") + F.col("n_have") + k - 1)).alias("place"))
    most = need.agg(F.max(F.col("n_seen") + F.col("n_have"))).first()[0] or 0
    order = order.where(F.col("place") < most + k)
    order = F.broadcast(order) if most + k <= SHORT else order
    spare = places.join(order, ["kind", "place"]).join(seen, ["user_id", "item"], "left_anti").join(lists.select("user_id", "item"), ["user_id", "item"], "left_anti")
    by_place = Window.partitionBy("user_id").orderBy("place")
    more = spare.withColumn("rank", F.row_number().over(by_place) + F.col("n_have")).where(F.col("rank") <= k)
    return lists.select("user_id", "item", "rank").unionByName(more.select("user_id", "item", F.col("rank").cast("int").alias("rank")))


def orders(pop: DataFrame) -> DataFrame:
    """(kind, place, item): the two orders that fill lists, by popularity and by index."""
    from .ids import build_sorted_ids

    index = build_sorted_ids(pop, "item").select(F.lit("index").alias("kind"), F.col("idx").alias("place"), "item")
    return pop.select(F.lit("popular").alias("kind"), "place", "item").unionByName(index)


def fill_topk(scores: DataFrame, users: DataFrame, seen: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Positive unseen scores first; then the lowest indices for users with any signal, popularity for the others."""
    return fill_lists(topk(scores.where("score > 0"), seen, k), scores, users, seen, pop, k)


def fill_lists(lists: DataFrame, scores: DataFrame, users: DataFrame, seen: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """As ``fill_topk``, from lists of positive unseen scores; ``scores`` (user_id, score): the best of each user will do."""
    signal = scores.where("score > 0").select("user_id").distinct().withColumn("kind", F.lit("index"))
    kinds = users.join(signal, "user_id", "left").na.fill("popular", ["kind"])
    return filled(lists, kinds, seen, orders(pop), k)


def fill_popular(scores: DataFrame, users: DataFrame, seen: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    """Positive unseen scores first, popularity for every slot that is left."""
    return fill_lists_popular(topk(scores.where("score > 0"), seen, k), users, seen, pop, k)


def fill_lists_popular(lists: DataFrame, users: DataFrame, seen: DataFrame, pop: DataFrame, k: int) -> DataFrame:
    order = pop.select(F.lit("popular").alias("kind"), "place", "item")
    return filled(lists, users.withColumn("kind", F.lit("popular")), seen, order, k)


def zero_signal_users(scores: DataFrame, users: DataFrame, seen: DataFrame) -> DataFrame:
    """Users none of whose unseen items scores above zero."""
    some = scores.where("score > 0").join(seen, ["user_id", "item"], "left_anti").select("user_id").distinct()
    return users.join(some, "user_id", "left_anti")


def with_fallback(primary: DataFrame, fallback: DataFrame, history: DataFrame) -> DataFrame:
    """The fallback's list for users without history, the primary one for the others."""
    known = history.select("user_id").distinct()
    return primary.join(known, "user_id", "left_semi").unionByName(fallback.join(known, "user_id", "left_anti"))


def hybrid_scores(scores: DataFrame, users: DataFrame, seen: DataFrame, pop: DataFrame, weight: float, k: int) -> DataFrame:
    """CF over its maximum (taken before exclusion) plus weight * popularity over its maximum, unseen items only.

    An item without CF score beats none of the k most popular unseen ones, so the candidates are the CF items and
    those: exact, and never user times catalog.
    """
    top = pop.agg(F.max("pop").alias("most"))
    scaled = pop.crossJoin(top).select("item", "place", (F.col("pop") / F.col("most")).alias("p"))  # one row
    best = scores.groupBy("user_id").agg(F.max("score").alias("best"))
    cf = scores.join(best, "user_id").select("user_id", "item", F.when(F.col("best") > 0, F.col("score") / F.col("best")).otherwise(0.0).alias("cf"))
    empty = cf.select("user_id", "item", F.lit(0).alias("rank")).limit(0)
    popular = filled(empty, users.withColumn("kind", F.lit("popular")), seen, pop.select(F.lit("popular").alias("kind"), "place", "item"), k)
    items = cf.select("user_id", "item").unionByName(popular.select("user_id", "item")).distinct().join(seen, ["user_id", "item"], "left_anti")
    joined = items.join(cf, ["user_id", "item"], "left").join(scaled, "item", "left")
    score = F.coalesce("cf", F.lit(0.0)) + weight * F.coalesce("p", F.lit(0.0))
    return joined.select("user_id", "item", F.round(score, 6).alias("score"))


def score_candidates(candidates: DataFrame, scores: DataFrame, pop: DataFrame, mode: str = "baseline", weight: float = 4.0, best: DataFrame | None = None) -> DataFrame:
    """candidates (user_id, item): baseline is CF + 1e-6 * popularity share, hybrid is CF over its maximum + weight * share.

    ``scores`` may be those of candidates only, if ``best`` (user_id, best) gives the maxima of the users who have some.
    """
    top = pop.agg(F.max("pop").alias("most"))
    share = pop.crossJoin(top).select("item", (F.col("pop") / F.col("most")).alias("p"))  # one row
    rows = candidates.join(scores, ["user_id", "item"], "left").join(share, "item", "left")
    p, cf = F.coalesce("p", F.lit(0.0)), F.coalesce("score", F.lit(0.0))
    if mode == "baseline":
        return rows.select("user_id", "item", F.round(F.when(F.col("p").isNull(), 0.0).otherwise(cf + 1e-6 * p), 9).alias("score"))
    best = scores.groupBy("user_id").agg(F.max("score").alias("best")) if best is None else best
    rows = rows.join(best, "user_id", "left")
    part = F.when(F.coalesce("best", F.lit(0.0)) > 0, cf / F.col("best")).otherwise(0.0)
    return rows.select("user_id", "item", F.round(part + weight * p, 6).alias("score"))


def signal_flags(users: DataFrame, history: DataFrame, scores: DataFrame) -> DataFrame:
    known = history.groupBy("user_id").agg(F.count("*").alias("seen_items"))
    personal = scores.where("score > 0").select("user_id").distinct().withColumn("has_signal", F.lit(True))
    rows = users.join(known, "user_id", "left").join(personal, "user_id", "left")
    return rows.select("user_id", F.col("seen_items").isNotNull().alias("known"), F.coalesce("has_signal", F.lit(False)).alias("has_signal"), F.coalesce("seen_items", F.lit(0)).alias("seen_items"))


def rank_candidates(candidates: DataFrame, scores: DataFrame, visible: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """candidates (user_id, item, pos): what becomes of each one, and its rank; equal scores keep the input order.

    status: hidden (not in the visible catalog), seen, unscored, ranked, or beyond_k.
    """
    rows = candidates.join(visible.select("item", "domain"), "item", "left").join(seen.withColumn("_seen", F.lit(True)), ["user_id", "item"], "left").join(scores, ["user_id", "item"], "left")
    state = F.when(F.col("domain").isNull(), "hidden").when(F.col("_seen"), "seen").when(F.col("score").isNull(), "unscored")
    rows = rows.withColumn("_state", state)
    order = Window.partitionBy("user_id", F.col("_state").isNull()).orderBy(F.desc("score"), "pos")
    rank = F.when(F.col("_state").isNull(), F.row_number().over(order))
    out = rows.withColumn("rank", rank)
    status: Column = F.when(F.col("_state").isNotNull(), F.col("_state")).when(F.col("rank") <= k, "ranked").otherwise("beyond_k")
    return out.select("user_id", "item", "pos", "domain", "score", status.alias("status"), F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))


def empty_reason(ranked_rows: DataFrame) -> DataFrame:
    """By user: how many are ranked, and why none is."""
    n = lambda s: F.count_if(F.col("status") == s)
    out = ranked_rows.groupBy("user_id").agg(n("ranked").alias("ranked"), n("seen").alias("seen"), n("hidden").alias("hidden"), n("unscored").alias("unscored"))
    return out.withColumn("note", empty_note())


def empty_note() -> Column:
    """From the numbers of ranked, seen, hidden and unscored candidates: why none is ranked."""
    return F.when(F.col("ranked") > 0, F.lit(None)).when((F.col("seen") > 0) & (F.col("hidden") + F.col("unscored") == 0), "all_seen").when((F.col("hidden") > 0) & (F.col("seen") + F.col("unscored") == 0), "all_hidden").otherwise("none_left")


def prime_from(n: int) -> int:
    while n < 2 or any(n % d == 0 for d in range(2, math.isqrt(n) + 1)):
        n += 1
    return n


def random_topk(users: DataFrame, items: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """items (item, idx) with n rows: each user walks through places by a drawn start and a drawn step, modulo a prime.

    The places of a walk differ, so everybody gets k items (all, if there are fewer); places beyond the last are passed.
    """
    n = items.count()
    prime = prime_from(n)
    at = draw(F.col("user_id"), F.lit("start"), F.lit(seed)) % prime
    step = draw(F.col("user_id"), F.lit("step"), F.lit(seed)) % max(prime - 1, 1) + 1
    walk = users.select("user_id", at.alias("at"), step.alias("step"), F.explode(F.sequence(F.lit(0), F.lit(min(k + prime - n, prime) - 1))).alias("i"))
    walk = walk.select("user_id", "i", ((F.col("at") + F.col("i") * F.col("step")) % prime).alias("idx")).join(items, "idx")
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("i"))
    return walk.withColumn("rank", rank).where(F.col("rank") <= k).select("user_id", "item", "rank")
