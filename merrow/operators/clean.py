"""Cleaning of events: validity, duplicates by source order, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("user_id", "parent_asin", "rating", "ts")
TS_MIN, TS_MAX = 631_152_000_000, 4_102_444_800_000
KEY = ("user_id", "parent_asin", "ts")


def is_missing(required: Sequence[str] = REQUIRED) -> Column:
    out = F.lit(False)
    for name in required:
        out = out | F.col(name).isNull()
    return out


def valid_ts(ts: str = "ts", low: int = TS_MIN, high: int = TS_MAX) -> Column:
    """Numeric, whole, low <= ts < high; null is not valid."""
    value = F.col(ts).try_cast("double")
    return F.coalesce((value == F.floor(value)) & (value >= low) & (value < high), F.lit(False))


def valid_rating(rating: str = "rating") -> Column:
    value = F.col(rating).try_cast("double")
    return F.coalesce(~F.isnan(value) & value.between(1, 5), F.lit(False))


def drop_missing(df: DataFrame) -> DataFrame:
    return df.where(~is_missing())


def reason() -> Column:
    """The first rule that drops a row, in the order of the report; null for rows that stay."""
    return F.when(is_missing(), "missing").when(~valid_ts(), "timestamp").when(~valid_rating(), "rating")


def dedupe(df: DataFrame, keys: Sequence[str] = KEY, keep: str = "last", seq: Sequence[str] = ("source_seq",)) -> DataFrame:
    """One row a key, the first or last in source order: an aggregate, so partial results shrink before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    pick = F.max_by if keep == "last" else F.min_by
    best = df.groupBy(*keys).agg(pick(F.struct(*others), F.struct(*seq)).alias("_row"))
    return best.select(*[F.col(k) for k in keys], "_row.*").select(*df.columns)


def clean(df: DataFrame, seq: Sequence[str]) -> DataFrame:
    return dedupe(df.where(reason().isNull()), seq=seq)


def clean_report(df: DataFrame) -> DataFrame:
    """One row: input, dropped by reason, duplicates, output, distinct users and items."""
    kept = F.col("reason").isNull()
    rows = df.withColumn("reason", reason())
    by_key = rows.where(kept).groupBy(*KEY).agg(F.count("*").alias("n"))
    out = by_key.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("dropped_duplicates"),
        F.count("*").alias("output_rows"),
        F.count_distinct("user_id").alias("users"),
        F.count_distinct("parent_asin").alias("items"),
    )
    first = rows.agg(F.count("*").alias("input_rows"), *[F.count_if(F.col("reason") == r).alias(f"dropped_{r}") for r in ("missing", "timestamp", "rating")])
    return first.crossJoin(out)  # one row each


def assert_rate(df: DataFrame, most: float = 0.01) -> float:
    """The share of rows with an invalid time among those with all fields; ValueError above ``most``."""
    row = df.where(~is_missing()).agg(F.avg(F.when(valid_ts(), 0.0).otherwise(1.0)).alias("rate")).first()
    rate = row.rate or 0.0
    if rate > most:
        raise ValueError(f"invalid timestamps: {rate:.4f} > {most}")
    return rate


def multi_item_groups(df: DataFrame) -> DataFrame:
    """Groups of one user and time with several items, and their events."""
    groups = df.groupBy("user_id", "ts").agg(F.count_distinct("parent_asin").alias("items"), F.count("*").alias("events")).where("items > 1")
    return groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum("events"), F.lit(0)).alias("events"))


def consecutive_repeats(df: DataFrame, seq: Sequence[str], slice_of: str) -> DataFrame:
    """Rows equal in user and item to the row before in source order; nulls never match.

    ``slice_of`` is a column that cuts the source into ordered slices (file, block): rows are compared within a slice,
    and a slice's first row with the last row of the slice before.
    """
    order = Window.partitionBy(slice_of).orderBy(*seq)
    same = (F.col("user_id") == F.lag("user_id").over(order)) & (F.col("parent_asin") == F.lag("parent_asin").over(order))
    inside = df.select(F.coalesce(same, F.lit(False)).alias("same")).agg(F.count_if("same").alias("n"))
    at = F.struct(*seq)
    edges = df.groupBy(slice_of).agg(
        F.min_by(F.struct("user_id", "parent_asin"), at).alias("head"), F.max_by(F.struct("user_id", "parent_asin"), at).alias("tail")
    )
    before = Window.orderBy(slice_of)  # a row for each slice
    joined = edges.select("head", F.lag("tail").over(before).alias("tail"))
    meet = (F.col("head.user_id") == F.col("tail.user_id")) & (F.col("head.parent_asin") == F.col("tail.parent_asin"))
    across = joined.agg(F.count_if(F.coalesce(meet, F.lit(False))).alias("n"))
    return inside.unionByName(across).agg(F.sum("n").alias("repeats"))
