"""Temporal split, cohorts and their reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.storage import stored


def temporal_cutoffs(df: DataFrame, ratios: tuple[float, float] = (0.8, 0.1), ts: str = "ts") -> tuple[int, int]:
    """Times at the ranks int(n * r) - 1 of the sorted times, without interpolation.

    Events are counted by time and the counts are written, one row a time. Running sums then go over days, over the
    seconds of the day that holds the rank and over the milliseconds of that second, so no window has more rows
    than there are days, or 86,400.
    """
    times = stored(df.groupBy(F.col(ts).cast("long").alias("t")).agg(F.count("*").alias("n")), "times")
    total = times.agg(F.sum("n").alias("n")).first().n or 0
    if not total:
        raise ValueError("no events to split")
    out = []
    for share in (ratios[0], ratios[0] + ratios[1]):
        rank, inside, at = min(max(int(total * share) - 1, 0), total - 1), times, None
        for unit in (86_400_000, 1000, 1):
            steps = inside.groupBy(F.floor(F.col("t") / unit).cast("long").alias("step")).agg(F.sum("n").alias("n"))
            upto = steps.select("step", "n", F.sum("n").over(Window.orderBy("step")).alias("upto"))
            at = upto.where(F.col("upto") > rank).orderBy("step").first()
            rank -= at.upto - at.n
            inside = inside.where((F.col("t") >= at.step * unit) & (F.col("t") < (at.step + 1) * unit))
        out.append(at.step)
    return out[0], out[1]


def split_of(first: int, second: int, ts: str = "ts") -> Column:
    """Ties go to the earlier split."""
    return F.when(F.col(ts) <= first, "train").when(F.col(ts) <= second, "validation").otherwise("test")


def temporal_split(df: DataFrame, ratios: tuple[float, float] = (0.8, 0.1), ts: str = "ts") -> DataFrame:
    return df.withColumn("split", split_of(*temporal_cutoffs(df, ratios, ts), ts))


def require_splits(df: DataFrame) -> DataFrame:
    """``df`` if no split is empty, else ValueError."""
    there = {r.split for r in df.select("split").distinct().collect()}  # three names at most
    if missing := {"train", "validation", "test"} - there:
        raise ValueError(f"empty splits: {sorted(missing)}")
    return df


def select_fit_target(df: DataFrame, eval_on: str) -> tuple[DataFrame, DataFrame]:
    """validation: fit on train; test: fit on train and validation."""
    fits = {"validation": ["train"], "test": ["train", "validation"]}
    if eval_on not in fits:
        raise ValueError("eval_on is 'validation' or 'test'")
    return df.where(F.col("split").isin(fits[eval_on])), df.where(F.col("split") == eval_on)


def segment(history: Column, sparse_max: int = 4) -> Column:
    return F.when(history == 0, "cold").when(history <= sparse_max, "sparse").otherwise("warm")


def cohort(fit: DataFrame, target: DataFrame, sparse_max: int = 4, user: str = "user_id", item: str = "parent_asin") -> DataFrame:
    """Users with targets: number of distinct items in the fit events, and their segment."""
    history = fit.groupBy(user).agg(F.count_distinct(item).alias("history_size"))
    users = target.select(user).distinct().join(history, user, "left")
    size = F.coalesce("history_size", F.lit(0))
    return users.select(user, size.alias("history_size"), segment(size, sparse_max).alias("segment"))


def train_core_report(core: DataFrame, df: DataFrame) -> DataFrame:
    """By domain and target split: events, users without history, cold items, share of events on cold items."""
    users = core.select("user_id").distinct().withColumn("known_user", F.lit(True))
    items = core.select("parent_asin").distinct().withColumn("known_item", F.lit(True))
    rows = df.where("split <> 'train'").join(users, "user_id", "left").join(items, "parent_asin", "left")
    return rows.groupBy("domain", "split").agg(
        F.count("*").alias("events"),
        F.count_distinct(F.when(F.col("known_user").isNull(), F.col("user_id"))).alias("users_without_history"),
        F.count_distinct(F.when(F.col("known_item").isNull(), F.col("parent_asin"))).alias("cold_items"),
        F.round(F.avg(F.when(F.col("known_item").isNull(), 1.0).otherwise(0.0)), 6).alias("cold_event_rate"),
    )
