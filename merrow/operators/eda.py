"""Descriptive statistics of events, metadata, splits and latencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def _per_user(df: DataFrame, *more) -> DataFrame:
    return df.groupBy("user_id").agg(F.count("*").alias("n"), *more)


def interaction_stats(df: DataFrame) -> DataFrame:
    """One row: users, items, events, sparsity, events a user, range of times."""
    users = _per_user(df, F.min("ts").alias("low"), F.max("ts").alias("high")).agg(
        F.count("*").alias("users"), F.sum("n").alias("events"), F.avg("n").alias("mean"), F.percentile("n", [0.5, 0.9]).alias("p"), F.min("low").alias("min_ts"), F.max("high").alias("max_ts")
    )
    items = df.agg(F.count_distinct("parent_asin").alias("items"))
    return users.crossJoin(items).select(  # one row each
        "users", "items", "events", F.round(1 - F.col("events") / (F.col("users") * F.col("items")), 6).alias("sparsity"), F.round("mean", 6).alias("mean_per_user"),
        F.col("p")[0].alias("median_per_user"), F.round(F.col("p")[1], 6).alias("p90_per_user"), "min_ts", "max_ts",
    )


def stats_report(df: DataFrame) -> DataFrame:
    users = _per_user(df, F.sum("rating").alias("ratings"), F.count("rating").alias("rated"))
    return users.agg(
        F.round(F.sum("ratings") / F.sum("rated"), 6).alias("avg_rating"), F.round(F.percentile("n", 0.99), 6).alias("p99_per_user"), F.max("n").alias("max_per_user"),
        F.count_if(F.col("n") == 1).alias("users_one"), F.count_if(F.col("n") >= 5).alias("users_five"), F.count_if(F.col("n") >= 10).alias("users_ten"),
    )


def with_categories(items: DataFrame) -> DataFrame:
    return items.withColumn("categories", F.array("cat1", "cat2"))


def metadata_stats(items: DataFrame) -> DataFrame:
    """One row: completeness, distinct stores and categories, means (rating numbers over all items)."""
    one = items.agg(
        F.count("*").alias("items"), *[F.count(c).alias(f"with_{c}") for c in ("store", "price", "rating_number")],
        F.round(F.sum(F.coalesce("rating_number", F.lit(0.0))) / F.count("*"), 6).alias("mean_rating_number"),
        F.round(F.avg("average_rating"), 6).alias("mean_average_rating"), F.count_distinct("store").alias("stores"),
    )
    categories = items.select(F.explode("categories").alias("c")).agg(F.count_distinct("c").alias("categories"))
    return one.crossJoin(categories)  # one row each


def top_categories(items: DataFrame, limit: int) -> DataFrame:
    counts = items.select(F.explode("categories").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "category").limit(limit)


def segment_users(df: DataFrame, cutoff: int, sparse_max: int = 3) -> DataFrame:
    """Users with events up to the cutoff; users without any are absent."""
    past = df.where(F.col("ts") <= cutoff).groupBy("user_id").agg(F.count("*").alias("events"))
    return past.withColumn("segment", F.when(F.col("events") <= sparse_max, "sparse_history").otherwise("warm"))


def diagnose_splits(df: DataFrame, domain: str) -> DataFrame:
    """By split: rows, users, items, times, the share of one domain, users with several domains."""
    rows = df.groupBy("split").agg(
        F.count("*").alias("rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("parent_asin").alias("items"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.round(F.avg(F.when(F.col("domain") == domain, 1.0).otherwise(0.0)), 6).alias("largest_domain_share"),
    )
    users = df.groupBy("split", "user_id").agg(F.count_distinct("domain").alias("d"))
    several = users.groupBy("split").agg(F.round(100 * F.avg(F.when(F.col("d") > 1, 1.0).otherwise(0.0)), 6).alias("multi_domain_pct"))
    return rows.join(several, "split")


def target_coverage(fit: DataFrame, target: DataFrame, k: int = 10) -> DataFrame:
    """Over all ('*') and by domain: how much of the targets a recommender could reach at all."""
    pairs = fit.select("user_id", "parent_asin").distinct()
    items = pairs.select("parent_asin").distinct().withColumn("warm", F.lit(True))
    history = pairs.groupBy("user_id").agg(F.count("*").alias("hist"))
    rows = target.select("user_id", "parent_asin", "domain").distinct()
    rows = rows.join(items, "parent_asin", "left").join(pairs.withColumn("rep", F.lit(True)), ["user_id", "parent_asin"], "left").join(history, "user_id", "left")
    warm, repeat = F.coalesce("warm", F.lit(False)), F.coalesce("rep", F.lit(False))
    levels = rows.select("user_id", warm.alias("warm"), repeat.alias("rep"), F.coalesce("hist", F.lit(0)).alias("hist"), F.explode(F.array("domain", F.lit("*"))).alias("domain"))
    users = levels.groupBy("domain", "user_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("warm") & ~F.col("rep")).alias("e"), F.max("hist").alias("hist"), F.count_if("warm").alias("w"), F.count_if("rep").alias("r")
    )
    share = lambda c: F.round(100.0 * F.sum(c) / F.sum("n"), 6)
    return users.groupBy("domain").agg(
        F.sum("n").alias("target_pairs"), share("w").alias("item_warm_pct"), share("r").alias("repeat_pct"), share("e").alias("novel_warm_pct"),
        F.round(100.0 * F.avg(F.when(F.col("hist") == 0, 1.0).otherwise(0.0)), 6).alias("cold_user_pct"), F.min("hist").alias("min_history"),
        F.percentile("hist", 0.5).alias("median_history"), F.round(F.percentile("hist", 0.9), 6).alias("p90_history"),
        F.round(F.avg(F.least(F.lit(k), "e") / F.col("n")), 6).alias("recall_ceiling"),
    )


def latency_summary(df: DataFrame, by: Sequence[str], column: str = "latency_seconds") -> DataFrame:
    """Calls, total, mean, p50 and p95; a negative or non-finite latency fails the job."""
    value = F.col(column)
    bad = (value < 0) | F.isnan(value) | (value == float("inf"))
    checked = df.withColumn("_v", F.when(bad, F.raise_error(F.lit("bad latency")).cast("double")).otherwise(value))
    out = checked.groupBy(*by).agg(F.count("*").alias("calls"), F.round(F.sum("_v"), 6).alias("total"), F.round(F.avg("_v"), 6).alias("mean"))
    out = out.join(percentiles(checked, "_v", [0.5, 0.95], by), list(by))
    return out.select(*by, "calls", "total", "mean", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p95"))
