"""Content fingerprints that do not depend on row order, and stage manifests that verify as a chain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fingerprint(df: DataFrame) -> DataFrame:
    """One row: rows, sum and xor of 60 bits of each row's MD5, by columns in name order with their lengths."""
    parts = [F.coalesce(F.concat_ws(":", F.char_length(F.col(c).cast("string")).cast("string"), F.col(c).cast("string")), F.lit("")) for c in sorted(df.columns)]
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 15), 16, 10).cast("long")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash_sum"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("hash_xor"))


def manifest(stage: str, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of a stage: fingerprints of what went in and what came out."""
    key = lambda df, name: fingerprint(df).select(F.concat_ws(":", F.col("rows").cast("string"), "hash_sum", F.col("hash_xor").cast("string")).alias(name), F.col("rows").alias(f"{name}_rows"))
    return key(before, "input").crossJoin(key(after, "output")).select(F.lit(stage).alias("stage"), "input", "output", "input_rows", "output_rows")  # one row each


def verify_chain(manifests: Sequence[DataFrame]) -> DataFrame:
    """The manifests in order; linked is whether a stage read what the one before wrote."""
    rows = reduce(DataFrame.unionByName, [m.withColumn("position", F.lit(i)) for i, m in enumerate(manifests)])
    before = F.lag("output").over(Window.orderBy("position"))  # a row for each stage
    return rows.withColumn("linked", F.coalesce(F.col("input") == before, F.col("position") == 0)).select("position", "stage", "input_rows", "output_rows", "linked")


def save_model(model: DataFrame, path: str, settings: dict[str, str]) -> None:
    """A model table and, beside it, one row with its settings, row count and fingerprint."""
    model.write.mode("errorifexists").parquet(f"{path}/rows")
    facts = fingerprint(model.sparkSession.read.parquet(f"{path}/rows"))
    facts.withColumn("settings", F.create_map(*[F.lit(x) for pair in sorted(settings.items()) for x in pair])).write.parquet(f"{path}/facts")


def load_model(spark, path: str, settings: dict[str, str]) -> DataFrame:
    """The table, if settings, row count and fingerprint are what was saved; else ValueError."""
    model, facts = spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/facts").first()
    now = fingerprint(model).first()
    if facts.settings != settings or (facts.rows, facts.hash_sum, facts.hash_xor) != (now.rows, now.hash_sum, now.hash_xor):
        raise ValueError(f"the model in {path} is not the one asked for")
    return model


def write_report(report: DataFrame, path: str, kinds: Sequence[str] = ("csv", "json")) -> None:
    """A report of bounded size in one file of each kind; failures are just a filtered report."""
    for kind in kinds:
        writer = report.coalesce(1).write.mode("errorifexists")
        (writer.option("header", True).csv if kind == "csv" else writer.json)(f"{path}/{kind}")
