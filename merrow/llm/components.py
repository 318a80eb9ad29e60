"""Connected components of a links table, by smallest labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """links (a, b) -> (id, component): the smallest identifier reachable, for every identifier of a link.

    Rounds are a logarithm of the longest path. A hub's links only meet in partial minima and in joins that adaptive
    execution may split.
    """
    both = tables.stored(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct(), "links")
    labels = tables.stored(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("src"), F.min("dst")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.src == labels.id).groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("id").alias("via"), F.col("component").alias("further"))
        moved = tables.stored(lower.join(jump, "via", "left").select("id", "old", F.least("via", "further").alias("component")), "labels")
        labels = moved.select("id", "component")
        if moved.where(F.col("old") != F.col("component")).isEmpty():
            return labels
