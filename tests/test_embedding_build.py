"""A build that is killed within a range goes on behind the ranges that have records, and notices changes."""

import pytest
from pyspark.sql import functions as F

from merrow.operators import vectors
from merrow.operators.embedding_build import EmbeddingBuild


def encode(df):
    return vectors.hash_embed(df, 8, "id", "text")


def items_of(spark, n=60):
    return spark.range(n).select(F.format_string("i%03d", "id").alias("id"), F.concat(F.lit("word w"), F.col("id") % 7).alias("text")).repartition(3)


def test_killed_range_resumes_without_repeating_others(spark, tmp_path):
    items, asked = items_of(spark), []

    def watched(fail_from=None):
        def run(df):
            asked.append([r.id for r in df.select("id").collect()])
            fail = F.raise_error(F.lit("killed")).cast("string")
            broken = df if fail_from is None else df.withColumn("text", F.when(F.col("id").between(fail_from, "i999"), fail).otherwise(F.col("text")))
            return encode(broken)

        return run

    build = EmbeddingBuild(spark, f"{tmp_path}/b", watched("i025"), 8, {"v": 1})
    build.start(items, rows_a_range=10)
    with pytest.raises(Exception, match="killed"):
        build.run(items, ranges_a_wave=1)
    assert sorted(r.range for r in build.commits().collect()) == [0, 1]
    with pytest.raises(ValueError, match="not complete"):
        build.vectors()
    asked.clear()
    again = EmbeddingBuild(spark, f"{tmp_path}/b", watched(), 8, {"v": 1})
    assert again.run(items, ranges_a_wave=3, waves=1) == 1
    assert again.run(items, ranges_a_wave=3) == 0
    done = [i for part in asked for i in part if i != "probe"]
    assert sorted(done) == [f"i{i:03d}" for i in range(20, 60)]
    rows = lambda df: sorted((r.id, [round(x, 5) for x in r.vec]) for r in df.collect())
    assert rows(again.vectors()) == rows(encode(items))
    assert again.run(items) == 0


def test_changes_and_faults_are_errors(spark, tmp_path):
    items, path = items_of(spark, 12), f"{tmp_path}/b"
    build = EmbeddingBuild(spark, path, encode, 8, {"v": 1})
    with pytest.raises(FileNotFoundError):
        build.run(items)
    build.start(items, 5)
    with pytest.raises(FileExistsError):
        build.start(items, 5)
    build.run(items, 1, waves=1)
    for other, what in (
        (EmbeddingBuild(spark, path, encode, 8, {"v": 2}), "configuration"),
        (EmbeddingBuild(spark, path, lambda df: vectors.hash_embed(df.withColumn("text", F.upper(F.reverse("text"))), 8, "id", "text"), 8, {"v": 1}), "encoder"),
    ):
        with pytest.raises(ValueError, match=what):
            other.run(items)
    with pytest.raises(ValueError, match="source"):
        build.run(items.withColumn("text", F.concat("text", F.lit("!"))))
    short = EmbeddingBuild(spark, path, lambda df: encode(df).where("id NOT LIKE '%7'"), 8, {"v": 1})
    with pytest.raises(ValueError, match="left out rows"):
        short.run(items, 5)
    assert build.run(items) == 0 and build.vectors().count() == 12
    for bad in (items.unionByName(items), items.withColumn("id", F.lit(None).cast("string")), items.withColumn("id", F.lit("")), items.where("false")):
        with pytest.raises(ValueError):
            EmbeddingBuild(spark, f"{tmp_path}/c", encode, 8).start(bad)
