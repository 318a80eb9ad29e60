"""Queries of factor models and of the streaming jobs, which read the tables as streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merrow.functions.draws import draw_sql
from merrow.functions.storage import shared_folder
from merrow.operators import factors
from merrow.streaming import jobs

from .prepare import CLEAN_SQL, REPORT_SQL, SEQ
from .recommend_queries import BASE, World
from .registry import query
from .views import Views, duck


def events_stream(v: Views):
    """The events table as a stream: slices by time, of which each trigger reads one file.

    Triggers take files by modification time and, where those are equal, in no order of ours; ``delay_of`` is a
    watermark delay that makes the order irrelevant.
    """
    source = scratch(v)
    v.events.repartitionByRange(4, "ts").write.parquet(source)
    stream = v.spark.readStream.schema(v.events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.withColumn("event_time", F.to_utc_timestamp(F.col("ts").cast("string"), "UTC"))


def delay_of(v: Views) -> str:
    """A watermark delay over the measured span of the events: no row is late, whatever slice comes first."""
    first, last = v.events.agg(F.min("ts"), F.max("ts")).first()
    return f"{(last - first).days + 2 if first else 1} days"


def scratch(v: Views) -> str:
    return f"{shared_folder(v.spark)}/merrow-stream-{uuid.uuid4().hex}"


TRIPLES = f""", ix AS (SELECT item, row_number() OVER (ORDER BY item) - 1 AS idx FROM (SELECT DISTINCT item FROM pr)), nn AS (SELECT count(*) AS n FROM ix),
dr AS (SELECT user_id, item, t, {draw_sql('user_id', 'item', 't', '0', '0')} % n AS idx FROM pr CROSS JOIN nn CROSS JOIN range(0, 8) r(t)),
fr AS (SELECT dr.user_id, dr.item, arg_min(ix.item, t) AS negative FROM dr JOIN ix USING (idx) WHERE (dr.user_id, ix.item) NOT IN (SELECT user_id, item FROM pr) GROUP BY 1, 2),
lo AS (SELECT user_id, min(ix.item) AS lowest FROM (SELECT DISTINCT user_id FROM pr) u CROSS JOIN ix WHERE (user_id, ix.item) NOT IN (SELECT user_id, item FROM pr) GROUP BY 1)"""


@query(BASE + TRIPLES + " SELECT pr.user_id, pr.item, coalesce(negative, lowest) AS negative FROM pr LEFT JOIN fr USING (user_id, item) JOIN lo ON lo.user_id = pr.user_id")
def h21_bpr_triples(v):
    return factors.sample_triples(World(v).pairs, 0)


@query()
def h22_bpr_fit(v):
    _, items, losses = factors.bpr_fit(World(v).pairs, epochs=3)
    return items.select("item", F.round("bias", 6).alias("bias"), F.lit(losses[-1] < losses[0]).alias("loss_fell"))


@query()
def h23_factor_topk(v):
    w = World(v)
    users, items, _ = factors.bpr_fit(w.pairs, epochs=2)
    return factors.factor_topk(users.join(w.users, "user_id", "left_semi"), items, w.history, 10)


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, round(sum(value), 2) AS value FROM events GROUP BY 1, 2")
def s02_stream_stats(v):
    out = jobs.run_once(jobs.stream_stats(events_stream(v)), "complete", scratch(v))
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("day"), "event_type", "events", F.round("value", 2).alias("value"))


@query("SELECT user_id, min(event_id) AS first_seen_ts FROM events GROUP BY 1")
def s03_stream_first_seen(v):
    return jobs.run_once(jobs.stream_first_seen(events_stream(v), "user_id", "event_id"), "complete", scratch(v))


@query("""WITH e AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w > INTERVAL 2 HOURS, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM e)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 2 HOURS AS session_end, count(*) AS events FROM s GROUP BY user_id, no""")
def s04_stream_sessions(v):
    out = jobs.run_once(jobs.stream_sessions(events_stream(v), "2 hours", delay=delay_of(v)), "complete", scratch(v))
    return out.select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "events")


@query("SELECT user_id, least(50, count(*)) AS held, arg_max(event_id, (ts, event_id)) AS latest, count(*) AS seen FROM events GROUP BY 1")
def s04_stream_recent(v):
    """The ring of each user after the last slice."""
    rows = events_stream(v).select(F.col("user_id").cast("long").alias("user_id"), F.unix_micros("event_time").alias("ts_us"), F.col("event_id").cast("long").alias("event_id"))
    out = jobs.run_once(jobs.stream_recent(rows), "append", scratch(v))
    last = out.groupBy("user_id").agg(F.max_by(F.struct("held", "latest", "seen"), "seen").alias("r"))
    return last.select("user_id", F.col("r.held").cast("long").alias("held"), "r.latest", "r.seen")


def tool_panes(v: Views):
    """Panes of a day of the tool log, after the last slice."""
    latency = F.when(F.col("event_id") % 11 != 0, F.col("value") / 1000)
    steps = events_stream(v).withColumn("tool", F.col("event_type")).withColumn("ok", F.col("event_type") != "error").withColumn("latency_seconds", latency)
    return jobs.run_once(jobs.stream_tool_log(steps, pane="1 day", delay=delay_of(v)), "complete", scratch(v))


TOOL_LOG = """
WITH e AS (
  SELECT date_trunc('day', ts) AS day, event_type AS tool, event_type = 'error' AS failed, CASE WHEN event_id % 11 <> 0 THEN value / 1000 END AS s FROM events),
w AS (SELECT e.*, day + to_days(CAST(i AS INT)) AS window_end FROM e CROSS JOIN range(1, {panes} + 1) r(i))
SELECT window_end, tool, count(*) AS calls, round(avg(CASE WHEN failed THEN 1.0 ELSE 0.0 END), 6) AS error_share,
  round(quantile_disc(s, 0.5), 6) AS p50, round(quantile_disc(s, 0.95), 6) AS p95 FROM w GROUP BY 1, 2"""


def rounded(rolled):
    at = F.col("window_end").cast("timestamp_ntz").alias("window_end")
    return rolled.select(at, "tool", "calls", *[F.round(c, 6).alias(c) for c in ("error_share", "p50", "p95")])


@query(TOOL_LOG.replace("{panes}", "1"))
def s05_stream_tool_log(v):
    return rounded(jobs.rolling_tool_log(tool_panes(v), "1 day", 1))


@query(TOOL_LOG.replace("{panes}", "3"))
def s05_stream_tool_rolling(v):
    """Windows of three days that move by one day."""
    return rounded(jobs.rolling_tool_log(tool_panes(v), "1 day", 3))


def raw_stream(v: Views, slices: int = 12):
    """Raw events as a stream of slices, by their place in the source."""
    source = scratch(v)
    v.v_raw.repartitionByRange(slices, *SEQ).write.parquet(source)
    return v.spark.readStream.schema(v.v_raw.schema).option("maxFilesPerTrigger", 1).parquet(source)


@query(f"{duck('v_raw')}, {CLEAN_SQL} SELECT user_id, parent_asin, ts, rating FROM v_clean")
def s01_stream_upsert(v):
    """The last valid event of each key after all slices."""
    place = scratch(v)
    rows, _ = jobs.upsert_clean(raw_stream(v), place, SEQ, f"{place}/progress", fan=4)
    return rows.current().select("user_id", "parent_asin", "ts", "rating")


@query(REPORT_SQL)
def s01_stream_upsert_report(v):
    place = scratch(v)
    return jobs.upserted_report(*jobs.upsert_clean(raw_stream(v), place, SEQ, f"{place}/progress", fan=4))


@query(
    f"""{duck('v_interactions')}, p AS (SELECT user_id, count(*) AS n FROM v_interactions GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS users, count(DISTINCT parent_asin) AS items, count(*) AS events,
  round(1 - count(*) * 1.0 / ((SELECT count(*) FROM p) * count(DISTINCT parent_asin)), 6) AS sparsity,
  round((SELECT avg(n) FROM p), 6) AS mean_per_user, (SELECT quantile_cont(n, 0.5) FROM p) AS median_per_user,
  round((SELECT quantile_cont(n, 0.9) FROM p), 6) AS p90_per_user, round((SELECT quantile_cont(n, 0.99) FROM p), 6) AS p99_per_user,
  (SELECT max(n) FROM p) AS max_per_user, round(avg(rating), 6) AS avg_rating, (SELECT count(*) FROM p WHERE n = 1) AS users_one,
  (SELECT count(*) FROM p WHERE n >= 5) AS users_five, min(ts) AS min_ts, max(ts) AS max_ts FROM v_interactions"""
)
def s02_stream_running_stats(v):
    """The statistics of all events after the last slice, from counters by user and item."""
    source, place = scratch(v), scratch(v)
    v.v_interactions.repartition(6, "l_orderkey").write.parquet(source)
    stream = v.spark.readStream.schema(v.v_interactions.schema).option("maxFilesPerTrigger", 1).parquet(source)
    return jobs.running_report(jobs.running_stats(stream, f"{place}/counters", f"{place}/progress", fan=3))


@query("""WITH r AS (SELECT concat('U', CAST(user_id AS VARCHAR)) AS user_id, event_type AS parent_asin, 1704067200000 + event_id % 5000 AS ts, CAST(1 + (event_id % 5000) % 7 AS INT) AS rating FROM events)
SELECT DISTINCT user_id, parent_asin, ts, rating FROM r WHERE rating <= 5""")
def s01_stream_clean(v):
    rows = events_stream(v).select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user_id"), F.col("event_type").alias("parent_asin"), (1 + F.col("event_id") % 5000 % 7).cast("int").alias("rating"), (1_704_067_200_000 + F.col("event_id") % 5000).alias("ts"), "event_time")
    return jobs.run_once(jobs.stream_clean(rows, delay=delay_of(v)), "append", scratch(v)).select("user_id", "parent_asin", "ts", "rating")
