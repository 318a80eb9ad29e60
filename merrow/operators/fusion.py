"""Merging ranked lists: unions, fusion, priority orders. Lists are (user_id, source, rank, item)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def source_no(sources: Sequence[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, sources)), F.col("source")).cast("int")


def _first(lists: DataFrame, key: Column, n: int | None) -> DataFrame:
    """Each item once, at its least key; ranked by it and cut."""
    best = lists.groupBy("user_id", "item").agg(F.min(key).alias("_key"))
    out = best.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("_key", "item")))
    return (out if n is None else out.where(F.col("rank") <= n)).select("user_id", "item", "rank")


def recent_items(df: DataFrame, n: int, order: Sequence[str] = ("ts",)) -> DataFrame:
    """The n latest distinct items of each user; the latest place in the order decides."""
    last = df.groupBy("user_id", "item").agg(F.max(F.struct(*order)).alias("last"))
    return last.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("last")))).where(F.col("rank") <= n).select("user_id", "item", "rank")


def drop_seen(lists: DataFrame, seen: DataFrame, n: int) -> DataFrame:
    """By user and source: unseen items, each once, ranked anew and cut."""
    rows = lists.join(seen, ["user_id", "item"], "left_anti").groupBy("user_id", "source", "item").agg(F.min("rank").alias("at"))
    order = Window.partitionBy("user_id", "source").orderBy("at", "item")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("user_id", "source", "item", "rank")


def round_robin(lists: DataFrame, sources: Sequence[str], n: int) -> DataFrame:
    return _first(lists, F.struct(F.col("rank"), source_no(sources).alias("s")), n)


def union_all(lists: DataFrame, sources: Sequence[str], n: int | None = None) -> DataFrame:
    return _first(lists, F.struct(source_no(sources).alias("s"), F.col("rank")), n)


def rrf(lists: DataFrame, n: int | None = None, constant: int = 60, pool: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion; ties by item, or by the position in a pool (user_id, item, pos)."""
    score = F.round(F.sum(1.0 / (constant + F.col("rank"))), 9)
    fused = lists.groupBy("user_id", "item").agg(score.alias("score"))
    tie = "item"
    if pool is not None:
        fused, tie = fused.join(pool, ["user_id", "item"]), "pos"
    out = fused.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("score"), tie)))
    return (out if n is None else out.where(F.col("rank") <= n)).select("user_id", "item", "score", "rank")


POLICIES = {"popularity_first": ("popular", "cf", "semantic"), "cf_first": ("cf", "popular", "semantic"), "semantic_first": ("semantic", "cf", "popular")}


def policy_order(pool: DataFrame, lists: DataFrame, policy: str) -> DataFrame:
    """A fixed pool (user_id, item, pos) in the order of a policy; items that no source ranks come last, by position."""
    if policy == "rrf_60":
        scores = lists.groupBy("user_id", "item").agg(F.round(F.sum(1.0 / (60 + F.col("rank"))), 9).alias("s"))
        key = F.struct(-F.coalesce("s", F.lit(0.0)), F.col("pos"))
        rows = pool.join(scores, ["user_id", "item"], "left").withColumn("_key", key)
    else:
        sources = POLICIES[policy]
        best = lists.groupBy("user_id", "item").agg(F.min(F.struct(source_no(sources).alias("s"), F.col("rank"))).alias("b"))
        rows = pool.join(best, ["user_id", "item"], "left").withColumn("_key", F.struct(F.coalesce("b.s", F.lit(99)), F.coalesce("b.rank", F.lit(0)), F.col("pos")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("_key"))).select("user_id", "item", "rank")


def guard_order(baseline: DataFrame, fused: DataFrame, guard: int = 5) -> DataFrame:
    """The first ``guard`` of the baseline keep their places, then the fused order, then the rest of the baseline."""
    b = baseline.select("user_id", "item", F.col("rank").alias("b"))
    rows = b.join(fused.select("user_id", "item", F.col("rank").alias("f")), ["user_id", "item"], "full")
    key = F.when(F.col("b") <= guard, F.struct(F.lit(0).alias("g"), F.col("b").alias("r"))).when(F.col("f").isNotNull(), F.struct(F.lit(1).alias("g"), F.col("f").alias("r"))).otherwise(F.struct(F.lit(2).alias("g"), F.col("b").alias("r")))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(key, "item"))).select("user_id", "item", "rank")


def quota_merge(lists: DataFrame, quotas: dict[str, int], budget: int) -> DataFrame:
    """Up to each source's quota in source order, without repeats; more than the budget is an error."""
    if sum(quotas.values()) > budget:
        raise ValueError("quotas exceed the budget")
    allowed = F.lit(False)
    for name, n in quotas.items():
        allowed = allowed | ((F.col("source") == name) & (F.col("rank") <= n))
    return union_all(lists.where(allowed), list(quotas), budget)


def source_support(lists: DataFrame, targets: DataFrame) -> DataFrame:
    """How many retrieved targets each combination of sources supports."""
    hit = lists.join(targets.select("user_id", "item").distinct(), ["user_id", "item"], "left_semi")
    sources = hit.groupBy("user_id", "item").agg(F.array_join(F.array_sort(F.collect_set("source")), "+").alias("sources"))
    return sources.groupBy("sources").agg(F.count("*").alias("targets"))
