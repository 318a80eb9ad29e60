"""Leak and integrity checks: each gives a report DataFrame; ``require`` turns a failed one into an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(report: DataFrame, flag: str = "ok") -> DataFrame:
    row = report.first()
    if row is None or not row[flag]:
        raise ValueError(f"check failed: {row.asDict() if row else 'empty'}")
    return report


def by_split(df: DataFrame, ts: str = "ts") -> DataFrame:
    """One row: first and last time of each split."""
    parts = [f(F.when(F.col("split") == s, F.col(ts))).alias(f"{s}_{n}") for s in ("train", "validation", "test") for n, f in (("min", F.min), ("max", F.max))]
    return df.agg(*parts)


def check_order(df: DataFrame, strict: bool = False) -> DataFrame:
    """No split starts before the one before it ends; an empty split fails."""
    before = (lambda a, b: F.col(a) < F.col(b)) if strict else (lambda a, b: F.col(a) <= F.col(b))
    fine = before("train_max", "validation_min") & before("validation_max", "test_min")
    return by_split(df).withColumn("ok", F.coalesce(fine, F.lit(False)))


def check_overlap(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that are in two splits, by pair of splits, from one aggregate."""
    has = lambda s: F.max(F.when(F.col("split") == s, 1).otherwise(0)).alias(s)
    there = df.groupBy(*keys).agg(has("train"), has("validation"), has("test"))
    both = lambda a, b: F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}")
    out = there.agg(both("train", "validation"), both("train", "test"), both("validation", "test"))
    return out.withColumn("ok", (F.col("train_validation") + F.col("train_test") + F.col("validation_test")) == 0)


def check_asof(df: DataFrame, cutoff: int, ts: str = "ts") -> DataFrame:
    late = F.col(ts) > cutoff
    return df.agg(F.count_if(late).alias("late_rows"), F.max(ts).alias("max_ts")).withColumn("ok", F.col("late_rows") == 0)


def check_subset(train: DataFrame, core: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows of the core beyond those of train, counted with multiplicity."""
    have = train.groupBy(*columns).agg(F.count("*").alias("have"))
    want = core.groupBy(*columns).agg(F.count("*").alias("want"))
    extra = F.greatest(F.col("want") - F.coalesce("have", F.lit(0)), F.lit(0))
    return want.join(have, list(columns), "left").agg(F.coalesce(F.sum(extra), F.lit(0)).alias("extra_rows")).withColumn("ok", F.col("extra_rows") == 0)


def check_protocol(fit: DataFrame, target: DataFrame, policy_ts: int | None = None, ts: str = "ts") -> DataFrame:
    """The last fit event is strictly before the first target; times are positive; the policy cutoff is the first target."""
    a = fit.agg(F.max(ts).alias("fit_max"), F.min(ts).alias("fit_min"))
    b = target.agg(F.min(ts).alias("target_min"))
    fine = (F.col("fit_max") < F.col("target_min")) & (F.col("fit_min") > 0)
    if policy_ts is not None:
        fine = fine & (F.col("target_min") == policy_ts)
    return a.crossJoin(b).select("fit_max", "target_min", F.coalesce(fine, F.lit(False)).alias("ok"))  # one row each


def audit_splits(df: DataFrame, n_users: int, n_items: int) -> DataFrame:
    """By split: rows, first and last time, index bounds, rows out of the mapping."""
    out = ~F.col("user_idx").between(0, n_users - 1) | ~F.col("item_idx").between(0, n_items - 1)
    return df.groupBy("split").agg(
        F.count("*").alias("rows"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.max("user_idx").alias("max_user"),
        F.max("item_idx").alias("max_item"), F.count_if(out).alias("out_of_range"),
    )


def preflight(df: DataFrame, items: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: events, unique pairs, catalog ids without mapping, mapped ids without catalog row."""
    pairs = df.agg(F.count("*").alias("events"), F.count_distinct("user_id", "parent_asin").alias("pairs"))
    a = items.join(mapping, items.item_id == mapping.parent_asin, "left_anti").agg(F.count("*").alias("unmapped_items"))
    b = mapping.join(items, items.item_id == mapping.parent_asin, "left_anti").agg(F.count("*").alias("uncatalogued_ids"))
    return pairs.crossJoin(a).crossJoin(b)  # one row each


def leak_probe(events: DataFrame, shown: DataFrame, cutoff: int) -> DataFrame:
    """By user: items shown that are touched by the user only after the cutoff. shown: (user_id, items array)."""
    first = events.groupBy("user_id", "parent_asin").agg(F.min("ts").alias("first_ts"))
    future = first.where(F.col("first_ts") > cutoff).groupBy("user_id").agg(F.collect_set("parent_asin").alias("future"))
    joined = shown.join(future, "user_id")
    leaked = F.array_intersect("items", "future")
    return joined.select("user_id", F.size(leaked).alias("leaked_items"), F.arrays_overlap("items", "future").alias("leak"))
