"""Scans and sinks of review events, item metadata and splits; domain tags."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from merrow.functions.storage import require_columns

REVIEW = T.StructType(
    [
        T.StructField("user_id", T.StringType()),
        T.StructField("parent_asin", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("helpful_vote", T.LongType()),
        T.StructField("verified_purchase", T.BooleanType()),
    ]
)
METADATA = T.StructType(
    [
        T.StructField("parent_asin", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("store", T.StringType()),
        T.StructField("price", T.StringType()),
        T.StructField("average_rating", T.StringType()),
        T.StructField("rating_number", T.StringType()),
        T.StructField("main_category", T.StringType()),
        T.StructField("categories", T.ArrayType(T.StringType())),
    ]
)


def read_reviews(spark: SparkSession, path: str | Sequence[str], columns: Sequence[str] = ("user_id", "parent_asin", "rating", "timestamp")) -> DataFrame:
    """JSON lines, plain or gzip, with a fixed schema; adds source_seq, the order of the source.

    The sequence is (file, place in it) and taken before any shuffle; a gzip file is one task's to read, so repartition
    after it where the next step is heavy.
    """
    rows = spark.read.schema(REVIEW).json(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("row"))
    return rows.select(*columns, place.alias("source_seq"))


def read_metadata(spark: SparkSession, files: Mapping[str, str], keep: DataFrame | None = None) -> DataFrame:
    """Item metadata of several domains, tagged; ``keep`` (parent_asin, domain) restricts it to known items."""
    parts = [spark.read.schema(METADATA).json(path).withColumn("domain", F.lit(domain)) for domain, path in files.items()]
    rows = reduce(DataFrame.unionByName, parts)
    return rows if keep is None else rows.join(keep.select("parent_asin", "domain").distinct(), ["parent_asin", "domain"], "left_semi")


def tag_domain(df: DataFrame, domain: str | None = None) -> DataFrame:
    """Keeps the bare id as original_item_id and makes parent_asin ``Domain::id``; domain: a name, or the column."""
    require_columns(df, "parent_asin", *([] if domain else ["domain"]))
    tagged = df.withColumn("original_item_id", F.col("parent_asin"))
    if domain:
        tagged = tagged.withColumn("domain", F.lit(domain))
    return tagged.withColumn("parent_asin", F.concat_ws("::", "domain", "original_item_id"))


def merge_domains(parts: Sequence[DataFrame]) -> DataFrame:
    """Union of tagged parts; duplicates stay."""
    return reduce(DataFrame.unionByName, [require_columns(p, "domain") for p in parts])


def save_splits(df: DataFrame, path: str, force: bool = False) -> None:
    """One folder for each split; an existing target is an error unless forced."""
    require_columns(df, "split").write.partitionBy("split").mode("overwrite" if force else "errorifexists").parquet(path)


def load_splits(spark: SparkSession, path: str, columns: Sequence[str] | None = None, splits: Sequence[str] | None = None) -> DataFrame:
    """Only the columns asked for that are there, and only the splits asked for (other folders are not read)."""
    rows = spark.read.parquet(path)
    if splits is not None:
        rows = rows.where(F.col("split").isin(*splits))
    return rows if columns is None else rows.select(*[c for c in columns if c in rows.columns], *(["split"] if "split" not in columns else []))


def domain_breakdown(df: DataFrame) -> DataFrame:
    return df.groupBy("domain").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"), F.count_distinct("parent_asin").alias("items"))


def first_seen(df: DataFrame, item: str = "parent_asin", ts: str = "ts") -> DataFrame:
    return df.groupBy(item).agg(F.min(ts).alias("first_seen_ts"))
