"""Dense ids without a one-task window, and their application."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from merrow.functions.storage import stored


def dense_rank_ids(keys: DataFrame, key: str, order: Column | str) -> DataFrame:
    """(key, idx): 0, 1, ... in the order given, for distinct keys.

    Sorted by range into partitions, written, numbered within each partition; the partitions' sizes, one row each,
    give the offsets.
    """
    numbered = keys.select(F.col(key), F.col(order).alias("_o") if isinstance(order, str) else order.alias("_o"))
    numbered = numbered.repartitionByRange("_o").sortWithinPartitions("_o").select(key, F.monotonically_increasing_id().alias("_at"))
    numbered = stored(numbered, "ids").select(key, F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return numbered.join(offsets, "_part").select(key, (F.col("_before") + F.col("_row")).cast("long").alias("idx"))


def build_ids(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Ids by first occurrence in the order of the columns given."""
    return dense_rank_ids(df.groupBy(key).agg(F.min(F.struct(*order)).alias("first")), key, "first")


def build_sorted_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids by the sorted key."""
    return dense_rank_ids(df.select(key).distinct(), key, key)


def save_ids(ids: DataFrame, path: str) -> None:
    """A mapping (key, idx) as a table; an existing one is an error."""
    ids.write.mode("errorifexists").parquet(path)


def load_ids(spark: SparkSession, path: str, key: str) -> DataFrame:
    """The mapping in ``path``, if its keys are there and unique and its ids are 0, 1, ... without gap; else ValueError."""
    ids = spark.read.parquet(path)
    if missing := {key, "idx"} - set(ids.columns):
        raise ValueError(f"no mapping of {key}: missing {sorted(missing)}")
    n = ids.agg(F.count("*").alias("n"), F.count(key).alias("keys"), F.count_distinct(key).alias("different"), F.count_distinct("idx").alias("ids"), F.min("idx").alias("low"), F.max("idx").alias("high")).first()
    if n.n and (n.keys != n.n or n.different != n.n or n.ids != n.n or (n.low, n.high) != (0, n.n - 1)):
        raise ValueError(f"the mapping in {path} is not one of {key} to 0, 1, ...")
    return ids.select(key, "idx")


def apply_ids(df: DataFrame, users: DataFrame, items: DataFrame, user: str = "user_id", item: str = "parent_asin") -> DataFrame:
    """Adds user_idx and item_idx; a user or item without id fails the job instead of dropping rows."""
    mapped = df.join(users.select(user, F.col("idx").alias("user_idx")), user, "left").join(items.select(item, F.col("idx").alias("item_idx")), item, "left")
    for name in ("user_idx", "item_idx"):
        mapped = mapped.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"no {name}"))).otherwise(F.col(name)).cast("long"))
    return mapped


def translate_ids(pairs: DataFrame, local: DataFrame, everywhere: DataFrame, key: str, column: str) -> DataFrame:
    """Replaces ids of one mapping by those of another, by way of the key."""
    way = local.select(key, F.col("idx").alias("_from")).join(everywhere.select(key, F.col("idx").alias("_to")), key)
    return pairs.join(way, pairs[column] == way["_from"]).withColumn(column, F.col("_to")).drop(key, "_from", "_to")
