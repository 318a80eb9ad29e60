"""Tables in runs: upserts and counters of a stream, retries, cut-off merges, the volume written; sketches of latencies."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from merrow.operators import clean, eda
from merrow.streaming import jobs
from merrow.streaming.runs import Run, Runs, by_key

SHAPE = "user_id string, parent_asin string, ts long, rating int, seq long"


def events(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        ts = rng.choice([0, 1_700_000_000_000, 1_700_000_000_001, 1_700_000_000_002])
        rows.append((rng.choice(["u1", "u2", "u3", None]), rng.choice(["a", "b"]), ts, rng.choice([1, 3, 5, 9, None]), i))
    return rows


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_in_any_order_equals_batch_job(spark, tmp_path):
    data = events(400)
    parts = [data[i::13] for i in range(13)]
    random.Random(2).shuffle(parts)
    table = jobs.upsert_last(spark, f"{tmp_path}/t", ["seq"], fan=3)
    for epoch, part in enumerate(parts):
        table.add(spark.createDataFrame(part, SHAPE).coalesce(1), epoch)
    whole = clean.clean(spark.createDataFrame(data, SHAPE), ["seq"])
    assert rows_of(table.current()) == rows_of(whole)
    # 13 = 9 + 3 + 1 batches
    assert Runs.live(table.runs()) == [Run(0, 12, 12), Run(1, 9, 11), Run(2, 0, 8)]


def test_retries_and_cut_off_merges_change_nothing(spark, tmp_path):
    table = Runs(spark, f"{tmp_path}/t", by_key(["key"], n=F.sum("n")), fan=2)
    batch = lambda i: spark.createDataFrame([("a", 1), (f"k{i}", 1), (None, 2)], "key string, n long").coalesce(1)
    with pytest.raises(ValueError):
        table.current()
    for epoch in range(4):
        table.add(batch(epoch), epoch)
        table.add(batch(epoch), epoch)  # as after a failure behind the write
    want = [("a", 4), ("k0", 1), ("k1", 1), ("k2", 1), ("k3", 1), (None, 8)]
    assert rows_of(table.current()) == sorted(want, key=str)
    # a merge that was cut off has no mark of success
    for epoch in (4, 5):
        table.add(batch(epoch), epoch)
    (tmp_path / "t" / Run(1, 4, 5).name / "_SUCCESS").unlink()
    assert Run(0, 4, 4) in Runs.live(table.runs())
    assert dict(table.current().collect())["a"] == 6
    table.add(batch(5), 5)  # the batch comes again, and its merge
    assert Run(1, 4, 5) in Runs.live(table.runs()) and dict(table.current().collect())["a"] == 6


def test_a_batch_writes_in_proportion_to_itself(spark, tmp_path, monkeypatch):
    written, write = [], Runs.write

    def counted(self, rows, run):
        write(self, rows, run)
        written.append((run, self.read([run]).count()))

    monkeypatch.setattr(Runs, "write", counted)
    table = Runs(spark, f"{tmp_path}/t", by_key(["key"], n=F.sum("n")), fan=4)
    table.add(spark.range(20_000).select(F.col("id").cast("string").alias("key"), F.lit(1).cast("long").alias("n")), 0)
    for epoch in range(1, 16):
        table.add(spark.range(10).select(F.concat(F.lit(f"{epoch}-"), "id").alias("key"), F.lit(1).cast("long").alias("n")).coalesce(1), epoch)
    small = [n for run, n in written if run.tier == 0 and run.first > 0]
    assert small == [10] * 15
    # each row once a tier: three tiers for sixteen batches
    assert sum(n for _, n in written) == 3 * (20_000 + 150)
    assert table.current().count() == 20_150


def test_stream_restarts_where_it_was(spark, tmp_path):
    data, source = events(300, 3), tmp_path / "in"
    source.mkdir()

    def put(i, part):
        spark.createDataFrame(part, SHAPE).coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        (file,) = (tmp_path / f"made{i}").glob("part-*.parquet")
        shutil.copy(file, source / f"{i}.parquet")

    def run():
        stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(source))
        return jobs.upsert_clean(stream, f"{tmp_path}/out", ["seq"], f"{tmp_path}/progress", fan=2)

    for i in range(3):
        put(i, data[i * 60 : i * 60 + 60])
    run()
    for i in range(3, 5):
        put(i, data[i * 60 : i * 60 + 60])
    rows, report = run()
    whole = spark.createDataFrame(data, SHAPE)
    assert rows_of(rows.current()) == rows_of(clean.clean(whole, ["seq"]))
    assert jobs.upserted_report(rows, report).first().asDict() == clean.clean_report(whole).first().asDict()


def test_running_statistics_equal_batch(spark, tmp_path):
    data = [r for r in events(500, 5) if r[0]] + [("hot", "a", 7, 5, i) for i in range(300)] + [("new", "c", 9, None, 0)]
    spark.createDataFrame(data, SHAPE).repartition(5).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    got = jobs.running_report(jobs.running_stats(stream, f"{tmp_path}/out", f"{tmp_path}/progress", fan=2)).first().asDict()
    whole = spark.createDataFrame(data, SHAPE)
    assert {**eda.interaction_stats(whole).first().asDict(), **eda.stats_report(whole).drop("users_ten").first().asDict()} == got


def test_sketch_errors_stay_in_their_bound(spark):
    n, k = 200_000, 400
    rows = spark.range(n).select(
        (F.col("id") * 48271 % n).cast("double").alias("latency_seconds"), F.lit("t").alias("tool"), (F.col("id") % 10 != 0).alias("ok"),
        F.timestamp_seconds(F.col("id") % 7200).alias("event_time"),
    )
    panes = jobs.stream_tool_log(rows, "10 minutes", k=k)
    assert panes.count() == 12
    assert panes.agg(F.max(F.length("sketch"))).first()[0] < 50 * k
    last = jobs.rolling_tool_log(panes, "10 minutes", 12, k, (0.5, 0.95)).where(F.col("calls") == n).first()
    assert abs(last.p50 - 0.5 * n) < 4 * n / k**0.9 and abs(last.p95 - 0.95 * n) < 4 * n / k**0.9
    assert last.error_share == 0.1
    empty = jobs.rolling_tool_log(jobs.stream_tool_log(rows.withColumn("latency_seconds", F.lit(None).cast("double")), k=k), count=1).first()
    assert empty.p50 is None and empty.calls > 0
