"""Streaming queries give what a batch over the whole table gives, whatever slice comes first."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from merrow.plans import stream_queries

DIR = "/root/testdata/sf0.001"


@pytest.fixture(params=[1, -1], ids=["oldest first", "newest first"])
def in_order(request, monkeypatch):
    """Gives the slices modification times in or against the order of time."""
    made, scratch, events_stream = [], stream_queries.scratch, stream_queries.events_stream

    def noted(v):
        made.append(scratch(v))
        return made[-1]

    def dated(v):
        at = len(made)
        stream = events_stream(v)
        files = sorted(Path(made[at].removeprefix("file://")).glob("part-*.parquet"))
        assert len(files) == 4
        for i, file in enumerate(files):
            os.utime(file, (1_700_000_000 + 60 * request.param * i,) * 2)
        return stream

    monkeypatch.setattr(stream_queries, "scratch", noted)
    monkeypatch.setattr(stream_queries, "events_stream", dated)


def test_sessions_equal_batch(spark, in_order):
    got = __spark_entry__.queries()["s04_stream_sessions"](spark, DIR)
    events = spark.read.parquet(f"{DIR}/events.parquet").withColumn("t", F.col("ts").cast("timestamp"))
    batch = events.groupBy(F.session_window("t", "2 hours").alias("s"), "user_id").agg(F.count("*").alias("events"))
    rows = lambda df: sorted((r.user_id, r.session_start, r.session_end, r.events) for r in df.collect())
    found = rows(got)
    assert sum(r[3] for r in found) == events.count() and found == rows(batch.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events"))


def test_clean_keeps_every_key(spark, in_order):
    got = __spark_entry__.queries()["s01_stream_clean"](spark, DIR).select("user_id", "parent_asin", "ts")
    events = spark.read.parquet(f"{DIR}/events.parquet").where("event_id % 7 < 5")
    keys = events.select(F.concat(F.lit("U"), F.col("user_id").cast("string")), "event_type", 1_704_067_200_000 + F.col("event_id") % 5000).distinct()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, keys.collect()))
