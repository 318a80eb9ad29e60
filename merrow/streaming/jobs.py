"""Structured Streaming forms of the incremental jobs. Each takes a streaming (or plain) DataFrame and gives one."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from merrow.operators import clean

from .runs import Runs, by_key


def stream_clean(events: DataFrame, time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """Valid events, the first of each key within the watermark.

    Events later than the watermark are dropped: that is new against the batch job, whose last-wins rule is
    ``upsert_clean``.
    """
    valid = events.where(clean.reason().isNull())
    return valid.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(clean.KEY))


def upsert_last(spark: SparkSession, target: str, seq: Sequence[str], keys: Sequence[str] = clean.KEY, fan: int = 8) -> Runs:
    """The last valid event of each key as a table in runs; ``add`` it in foreachBatch. ``seq`` orders the source."""
    return Runs(spark, target, lambda rows: clean.dedupe(rows.where(clean.reason().isNull()), keys, "last", seq), fan)


def upsert_report(spark: SparkSession, target: str, fan: int = 8) -> Runs:
    """Rows by what drops them (null: nothing does), summed over the batches."""
    return Runs(spark, target, by_key(["reason"], n=F.sum("n")), fan)


def upsert_clean(stream: DataFrame, target: str, seq: Sequence[str], progress: str, fan: int = 8) -> tuple[Runs, Runs]:
    """Runs the stream to the end of what is there: the last valid event of each key, whatever batch it comes in, and the counts.

    The report of a batch is written before its rows; both repeat as they were when a batch is run again.
    """
    spark = stream.sparkSession
    rows, report = upsert_last(spark, f"{target}/rows", seq, fan=fan), upsert_report(spark, f"{target}/report", fan)

    def add(batch: DataFrame, epoch: int) -> None:
        report.add(batch.select(clean.reason().alias("reason"), F.lit(1).cast("long").alias("n")), epoch)
        rows.add(batch, epoch)

    stream.writeStream.option("checkpointLocation", progress).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    return rows, report


def upserted_report(rows: Runs, report: Runs) -> DataFrame:
    """One row, as of the last batch: input, dropped by reason, duplicates, output, distinct users and items."""
    kept = rows.current().agg(F.count("*").alias("output_rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("parent_asin").alias("items"))
    counts = report.current()
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0))
    valid = n(F.col("reason").isNull())
    dropped = [n(F.col("reason") == r).alias(f"dropped_{r}") for r in ("missing", "timestamp", "rating")]
    first = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("input_rows"), *dropped, valid.alias("_valid"))
    # one row each
    return first.crossJoin(kept).withColumn("dropped_duplicates", F.col("_valid") - F.col("output_rows")).drop("_valid")


def running_stats(stream: DataFrame, target: str, progress: str, fan: int = 8) -> Runs:
    """Exact running statistics of events (user_id, parent_asin, ts, rating): one counter a user, one an item.

    A batch's counts by key are added before they are shuffled, so a key with a third of all events is one row a task, and
    written as one run; ``running_report`` has what a batch job over all events would say.
    """
    spark, number = stream.sparkSession, lambda c: F.col(c).cast("double")
    counters = Runs(
        spark,
        target,
        by_key(["kind", "key"], n=F.sum("n"), min_ts=F.min("min_ts"), max_ts=F.max("max_ts"), ratings=F.sum("ratings"), rated=F.sum("rated")),
        fan,
    )

    def add(batch: DataFrame, epoch: int) -> None:
        one = batch.select(
            F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("key")) for c in ("user_id", "parent_asin")])).alias("k"),
            F.lit(1).cast("long").alias("n"),
            F.col("ts").alias("min_ts"),
            F.col("ts").alias("max_ts"),
            F.coalesce(number("rating"), F.lit(0.0)).alias("ratings"),
            F.col("rating").isNotNull().cast("long").alias("rated"),
        )
        counters.add(one.select("k.*", "n", "min_ts", "max_ts", "ratings", "rated"), epoch)

    stream.writeStream.option("checkpointLocation", progress).foreachBatch(add).trigger(availableNow=True).start().awaitTermination()
    return counters


def running_report(counters: Runs) -> DataFrame:
    """One row: users, items, events, sparsity, history lengths, times, mean rating, from the counters' histogram of lengths."""
    rows = counters.current()
    histogram = rows.where("kind = 'user_id'").groupBy("n").agg(
        F.count("*").alias("users"), F.min("min_ts").alias("low"), F.max("max_ts").alias("high"), F.sum("ratings").alias("ratings"), F.sum("rated").alias("rated")
    )
    lengths = F.percentile("n", [0.5, 0.9, 0.99], F.col("users"))  # of the distinct lengths, each as often as it occurs
    users = histogram.agg(
        F.sum("users").alias("users"),
        F.sum(F.col("n") * F.col("users")).alias("events"),
        lengths.alias("p"),
        F.max("n").alias("max_per_user"),
        F.min("low").alias("min_ts"),
        F.max("high").alias("max_ts"),
        (F.sum("ratings") / F.sum("rated")).alias("rating"),
        *[F.coalesce(F.sum(F.when(when, F.col("users"))), F.lit(0)).alias(c) for c, when in (("users_one", F.col("n") == 1), ("users_five", F.col("n") >= 5))],
    )
    items = rows.where("kind = 'parent_asin' AND key IS NOT NULL").agg(F.count("*").alias("items"))
    return users.crossJoin(items).select(  # one row each
        "users", "items", "events", F.round(1 - F.col("events") / (F.col("users") * F.col("items")), 6).alias("sparsity"),
        F.round(F.col("events") / F.col("users"), 6).alias("mean_per_user"), F.col("p")[0].alias("median_per_user"),
        F.round(F.col("p")[1], 6).alias("p90_per_user"), F.round(F.col("p")[2], 6).alias("p99_per_user"), "max_per_user",
        F.round("rating", 6).alias("avg_rating"), "users_one", "users_five", "min_ts", "max_ts",
    )


def stream_stats(events: DataFrame, window: str = "1 day", slide: str | None = None, time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """Events, value sum and users (approximate) by window; tumbling, or sliding with ``slide``."""
    at = F.window(time, window, slide) if slide else F.window(time, window)
    out = events.withWatermark(time, delay).groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("value"), F.approx_count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "events", "value", "users")


def stream_first_seen(events: DataFrame, item: str = "parent_asin", ts: str = "ts") -> DataFrame:
    return events.groupBy(item).agg(F.min(ts).alias("first_seen_ts"))


def stream_sessions(events: DataFrame, gap: str = "30 minutes", time: str = "event_time", delay: str = "1 day") -> DataFrame:
    """Sessions of a user: events until a gap."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("s"), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "events")


def stream_recent(events: DataFrame, ring: int = 50) -> DataFrame:
    """The latest ``ring`` events (by ts_us, event_id) of each user as keyed state, given at each trigger.

    The state is the ring and the number of events seen: bounded for each user, and in whatever order slices come, it ends
    alike.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, seen = state.get if state.exists else ([], [], 0)
        held = list(zip(times, ids, strict=True))
        for part in parts:
            seen += len(part)
            held = sorted(held + list(zip(part["ts_us"].tolist(), part["event_id"].tolist(), strict=True)))[-ring:]
        state.update(([t for t, _ in held], [i for _, i in held], seen))
        yield pd.DataFrame({"user_id": [key[0]], "held": [len(held)], "latest": [held[-1][1]], "seen": [seen]})

    shape = "user_id long, held int, latest long, seen long"
    kept = "times array<long>, ids array<long>, seen long"
    return events.groupBy("user_id").applyInPandasWithState(update, shape, kept, "append", GroupStateTimeout.NoTimeout)


def stream_tool_log(steps: DataFrame, pane: str = "1 hour", time: str = "event_time", delay: str = "1 day", k: int = 4096) -> DataFrame:
    """Calls, errors and a mergeable quantile sketch of the latencies by pane of time and tool.

    The sketch is the stream's state: partial sketches are merged in the shuffle, and its size is bounded by ``k`` whatever
    the number of calls. Up to ``k`` calls it holds them all; beyond, the rank error is about 1 / k ** 0.9 of the calls.
    """
    failed = F.count_if(~F.col("ok")).alias("errors")
    groups = steps.withWatermark(time, delay).groupBy(F.window(time, pane).alias("w"), "tool")
    out = groups.agg(F.count("*").alias("calls"), failed, F.kll_sketch_agg_double(F.col("latency_seconds").cast("double"), k).alias("sketch"))
    return out.select(F.col("w.start").alias("pane_start"), "tool", "calls", "errors", "sketch")


def rolling_tool_log(panes: DataFrame, pane: str = "1 hour", count: int = 24, k: int = 4096, places: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Windows of ``count`` panes that end with each pane's end: sketches are merged, events are not read again.

    p50 and p95 are latencies that occurred: the smallest one with at least that share of calls up to it. They are null
    where no call has a latency.
    """
    shifted = F.explode(F.transform(F.sequence(F.lit(1), F.lit(count)), lambda i: F.col("pane_start") + i * F.expr(f"INTERVAL {pane}"))).alias("window_end")
    merged = panes.select("tool", "calls", "errors", "sketch", shifted).groupBy("window_end", "tool").agg(
        F.sum("calls").alias("calls"), (F.sum("errors") / F.sum("calls")).alias("error_share"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    held = F.kll_sketch_get_n_double("sketch") > 0
    points = [F.when(held, F.kll_sketch_get_quantile_double("sketch", F.lit(p))).alias(f"p{round(100 * p)}") for p in places]
    return merged.select("window_end", "tool", "calls", "error_share", *points)


def run_once(stream: DataFrame, mode: str, shared: str) -> DataFrame:
    """All that is there now, through the stream's own engine, into a written table.

    Complete and update results are taken from the last batch that has each key, so the table is what a sink that
    overwrites by key holds.
    """
    spark = stream.sparkSession

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{shared}/out/{epoch:06d}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{shared}/progress").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{shared}/out/*")
    if mode == "complete":
        last = rows.agg(F.max("_epoch").alias("_last"))
        rows = rows.join(last, rows["_epoch"] == last["_last"]).drop("_last")  # one row
    return rows.drop("_epoch")
