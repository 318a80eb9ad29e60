"""Running counts and exact percentiles over values of any number, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.storage import stored


def cumulative(counts: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """counts (by..., value, t), one row a value -> also upto, the running sum of t in the order of a group's values.

    Values are sorted by range into partitions and written; the partitions' sums, one row each and group, give the
    offsets.
    """
    keys = [*by, value]
    ranged = stored(counts.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranks")
    sums = ranged.groupBy(*by, "_part").agg(F.sum("t").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    offsets = sums.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], F.col("_part") == F.col("_of"))
    within = Window.partitionBy(*by, "_part").orderBy(value)
    return ranged.join(offsets, same).withColumn("upto", F.sum("t").over(within) + F.col("_before")).select(*counts.columns, "upto")


#: Different values of a group that one task may hold.
HELD = 200_000


def percentiles(rows: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = (), held: int = HELD) -> DataFrame:
    """(by..., p): the exact percentiles of a group's values, with linear interpolation, as an array; nulls take no part.

    Groups of few different values are left to the built-in aggregate; where one has more than ``held``, all are ranked by
    ranges, so no task sees a whole group. Both ways give the same.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("t"))
    most = counts.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if most <= held:
        return counts.groupBy(*by).agg(F.percentile("_v", list(shares), F.col("t")).alias("p"))
    running = cumulative(counts, "_v", by)
    if by:
        totals = counts.groupBy(*by).agg(F.sum("t").alias("_n")).select(*[F.col(c).alias(f"_{c}") for c in by], "_n")
        running = running.join(totals, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]))
    else:
        running = running.crossJoin(counts.agg(F.sum("t").alias("_n")))  # one row
    places = [(F.col("_n") - 1) * share for share in shares]
    value_at = lambda place: F.min(F.when(F.col("upto") > place, F.col("_v")))
    lows = [value_at(F.floor(at)).alias(f"_low{i}") for i, at in enumerate(places)]
    highs = [value_at(F.ceil(at)).alias(f"_high{i}") for i, at in enumerate(places)]
    found = running.groupBy(*by).agg(F.first("_n").alias("_n"), *lows, *highs)

    def between(i: int, share: float):
        at = (F.col("_n") - 1) * share
        part = at - F.floor(at)
        return F.when(part == 0, F.col(f"_low{i}")).otherwise(F.col(f"_low{i}") * (F.ceil(at) - at) + F.col(f"_high{i}") * part)

    return found.select(*by, F.array(*[between(i, share) for i, share in enumerate(shares)]).alias("p"))
