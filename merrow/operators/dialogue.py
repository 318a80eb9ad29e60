"""Multi-turn conversations: turn scores, retention, session state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bare_id(item):
    return F.element_at(F.split(item, "::"), -1)


def score_turns(turns: DataFrame) -> DataFrame:
    """turns (conversation_id, position, items, expected, excluded): item match on bare ids, exclusion compliance."""
    shown = F.array_distinct(F.transform("items", bare_id))
    wanted = F.array_distinct(F.transform("expected", bare_id))
    return turns.select(
        "conversation_id", "position", F.size(shown).cast("long").alias("shown"),
        F.when(F.size(wanted) > 0, F.round(F.size(F.array_intersect(shown, wanted)) / F.size(wanted), 6)).alias("item_match"),
        (F.size(F.array_intersect(shown, F.transform("excluded", bare_id))) == 0).alias("exclusions_kept"),
    )


def score_conversations(turns: DataFrame) -> DataFrame:
    """Turns, distinct items, and whether every later turn still shows all earlier items (null for one turn).

    All earlier items are still shown at each turn just when each turn's items contain those of the turn before.
    """
    order = Window.partitionBy("conversation_id").orderBy("position")
    rows = turns.withColumn("before", F.lag("items").over(order))
    kept = F.when(F.col("before").isNotNull(), F.size(F.array_except("before", "items")) == 0)
    out = rows.select("conversation_id", "items", kept.alias("kept")).groupBy("conversation_id").agg(
        F.count("*").alias("turns"), F.bool_and("kept").alias("retention"), F.size(F.array_distinct(F.flatten(F.collect_list("items")))).cast("long").alias("distinct_items")
    )
    return out


def session_state(turns: DataFrame, last: int = 3, ring: int = 50) -> DataFrame:
    """At each turn: the positions of the last turns, and how many of the ring of latest shown items there are."""
    recent = Window.partitionBy("conversation_id").orderBy("position").rowsBetween(-(last - 1), 0)
    upto = Window.partitionBy("conversation_id").orderBy("position").rowsBetween(-(ring - 1), 0)
    shown = F.flatten(F.collect_list("items").over(upto))
    return turns.select(
        "conversation_id", "position", F.array_join(F.collect_list(F.col("position").cast("string")).over(recent), ",").alias("recent_turns"),
        F.size(F.slice(F.reverse(F.array_distinct(F.reverse(shown))), -F.least(F.lit(ring), F.greatest(F.lit(1), F.size(F.array_distinct(shown)))), F.lit(ring))).cast("long").alias("ring_size"),
    )


def summarize_conversations(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("conversations"), F.round(F.avg("turns"), 6).alias("mean_turns"), F.round(F.stddev_pop("turns"), 6).alias("std_turns"),
        F.round(F.avg(F.col("retention").cast("double")), 6).alias("retention_rate"), F.round(F.avg("distinct_items"), 6).alias("mean_items"),
    )
