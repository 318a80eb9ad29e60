"""Statistics of scored rows: bootstrap, paired tests, benchmark tables, gates and regressions."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.draws import BITS, draw

from .quantiles import cumulative, percentiles


def poisson_steps() -> list[int]:
    """Of 2 ** 40 draws, how many are at most 0, 1, ... by Poisson(1); the last step has less than one draw above it."""
    steps, total, p, n = [], 0.0, math.exp(-1), 0
    while not steps or steps[-1] < 2**BITS - 1:
        total += p
        steps.append(min(round(total * 2**BITS), 2**BITS))
        n += 1
        p /= n
    return steps


def poisson_one(drawn: Column) -> Column:
    """A Poisson(1) number from a draw."""
    out = F.lit(0)
    for n, step in enumerate(poisson_steps()):
        out = F.when(drawn >= step, n + 1).otherwise(out)
    return out


def replicated(rows: DataFrame, replicates: int, seed: int) -> DataFrame:
    """rows (k, x): every row once for each replicate, with its weight w there."""
    drawn = rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("drawn", draw(F.col("k"), F.col("rep"), F.lit(seed)))
    return drawn.withColumn("w", poisson_one(F.col("drawn")))


def bootstrap_ci(df: DataFrame, column: str, key: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """One row: mean and percentile interval. A replicate weighs every row by its own Poisson draw: no resampling, only sums."""
    rows = df.where(F.col(column).isNotNull()).select(F.col(key).alias("k"), F.col(column).cast("double").alias("x"))
    means = replicated(rows, replicates, seed).groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    bounds = means.agg(F.percentile("m", [alpha / 2, 1 - alpha / 2]).alias("p"))
    mean = rows.agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    return mean.crossJoin(bounds).select("n", F.round("mean", 6).alias("mean"), F.round(F.col("p")[0], 6).alias("low"), F.round(F.col("p")[1], 6).alias("high"))  # one row each


def paired_bootstrap(pairs: DataFrame, a: str, b: str, key: str, replicates: int = 200, seed: int = 0, planned: int = 1) -> DataFrame:
    """Interval of the mean difference b - a at alpha / planned, a one-sided sign share, and improved / worse / unchanged."""
    rows = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("d", F.col(b).cast("double") - F.col(a).cast("double"))
    drawn = replicated(rows.select(F.col(key).alias("k"), F.col("d").alias("x")), replicates, seed)
    means = drawn.groupBy("rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    sign = means.agg(F.round(F.avg(F.when(F.col("m") <= 0, 1.0).otherwise(0.0)), 6).alias("p_value"))
    counts = rows.agg(F.count_if(F.col("d") > 0).alias("improved"), F.count_if(F.col("d") < 0).alias("worse"), F.count_if(F.col("d") == 0).alias("unchanged"))
    return bootstrap_ci(rows, "d", key, replicates, seed, 0.05 / planned).crossJoin(sign).crossJoin(counts)  # one row each


def mcnemar(pairs: DataFrame, a: str, b: str, least: int = 10) -> DataFrame:
    """Discordant pairs, the statistic with continuity correction, and the level reached (1 if none, null below ``least``)."""
    counts = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).agg(F.count_if(F.col(a) & ~F.col(b)).alias("b"), F.count_if(~F.col(a) & F.col(b)).alias("c"))
    n, d = F.col("b") + F.col("c"), F.greatest(F.abs(F.col("b") - F.col("c")) - 1, F.lit(0))
    chi = F.when(n >= least, F.round(d * d / n, 6))
    # fixed values: chi-square with one degree of freedom at .001, .01 and .05
    level = F.when(chi >= 10.828, 0.001).when(chi >= 6.635, 0.01).when(chi >= 3.841, 0.05).when(chi.isNotNull(), 1.0)
    return counts.select("b", "c", chi.alias("chi2"), level.alias("p"))


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Ranks from 1, ties share their mean: counts by value, a running sum over distinct values."""
    counts = df.groupBy(value).agg(F.count("*").alias("t"))
    return cumulative(counts, value).withColumn("rank", F.col("upto") - (F.col("t") - 1) / 2)


def wilcoxon(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Signed ranks of the non-zero differences, tie-corrected normal z."""
    rows = pairs.select(F.round(F.col(b).cast("double") - F.col(a).cast("double"), 9).alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    ranks = average_ranks(rows, "size")
    plus = rows.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("up")).join(ranks, "size")
    total = plus.agg(F.sum("t").alias("n"), F.sum(F.col("up") * F.col("rank")).alias("w"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n = F.col("n")
    sigma = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48)
    return total.select("n", F.col("w").alias("w_plus"), F.round((F.col("w") - n * (n + 1) / 4) / sigma, 6).alias("z"))


def mann_whitney(rows: DataFrame, value: str, group: str) -> DataFrame:
    """group is true or false; U of the true group and its tie-corrected normal z."""
    ranks = average_ranks(rows.where(F.col(value).isNotNull()), value)
    part = rows.groupBy(value).agg(F.count_if(group).alias("g")).join(ranks, value)
    total = part.agg(F.sum("t").alias("n"), F.sum("g").alias("n1"), F.sum(F.col("g") * F.col("rank")).alias("r"), F.sum(F.pow("t", F.lit(3)) - F.col("t")).alias("ties"))
    n, n1 = F.col("n"), F.col("n1")
    n2, u = n - n1, F.col("r") - n1 * (n1 + 1) / 2
    sigma = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    return total.select("n1", n2.alias("n2"), u.alias("u"), F.round((u - n1 * n2 / 2) / sigma, 6).alias("z"))


def long_form(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value)."""
    return df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(list(keys), list(metrics), "metric", "value")


def aggregate_metrics(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    rows = long_form(df, by, metrics).where(F.col("value").isNotNull())
    out = rows.groupBy(*by, "metric").agg(
        F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("min"), F.max("value").alias("max")
    ).join(percentiles(rows, "value", [0.5, 0.95, 0.99], [*by, "metric"]), [*by, "metric"])
    return out.select(*by, "metric", "n", "mean", "std", "min", "max", *[F.round(F.col("p")[i], 6).alias(q) for i, q in enumerate(("p50", "p95", "p99"))])


def pair_runs(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """Repeated runs of a key are averaged at six digits, by way of integers, so in whatever order; then both sides meet."""
    micros, n = F.sum(F.round(F.col(metric).cast("double") * 1e6).cast("long")), F.count(metric)
    mean = F.when(n > 0, F.floor((2 * micros + n) / (2 * n)) / 1e6)
    side = lambda df, name: df.groupBy(key).agg(mean.alias(name))
    return side(a, "a").join(side(b, "b"), key)


def contrast(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """pairs (by..., a, b): means, difference, wins, losses, ties; over all groups too ('all')."""
    rows = pairs
    for c in by:
        rows = rows.withColumn(c, F.explode(F.array(c, F.lit("all"))))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg("a"), 6).alias("mean_a"), F.round(F.avg("b"), 6).alias("mean_b"), F.round(F.avg(F.col("b") - F.col("a")), 6).alias("diff"),
        F.count_if(F.col("b") > F.col("a")).alias("wins"), F.count_if(F.col("b") < F.col("a")).alias("losses"), F.count_if(F.col("b") == F.col("a")).alias("ties"),
    )


def contrast_report(pairs: DataFrame, by: Sequence[str], key: str, replicates: int = 200, seed: int = 0, alpha: float = 0.05, least: int = 10) -> DataFrame:
    """``contrast`` with a bootstrap interval of the mean difference and McNemar's test of the flags sa and sb.

    pairs (by..., key, a, b, sa, sb); over all groups too ('all'). chi2 is null with fewer than ``least`` discordant pairs.
    """
    levels = pairs
    for c in by:
        levels = levels.withColumn(c, F.explode(F.array(c, F.lit("all"))))
    drawn = replicated(levels.select(*by, F.col(key).alias("k"), (F.col("b") - F.col("a")).alias("x")), replicates, seed)
    means = drawn.groupBy(*by, "rep").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))  # a row for each replicate
    ci = means.groupBy(*by).agg(F.percentile("m", [alpha / 2, 1 - alpha / 2]).alias("p"))
    flags = levels.groupBy(*by).agg(F.count_if(F.col("sa") & ~F.col("sb")).alias("only_a"), F.count_if(~F.col("sa") & F.col("sb")).alias("only_b"))
    n, d = F.col("only_a") + F.col("only_b"), F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0))
    flags = flags.withColumn("chi2", F.when(n >= least, F.round(d * d / n, 6)))
    out = contrast(pairs, by).join(ci, list(by)).join(flags, list(by))
    return out.withColumn("low", F.round(F.col("p")[0], 6)).withColumn("high", F.round(F.col("p")[1], 6)).drop("p")


def verdict(rows: DataFrame, cost: bool) -> DataFrame:
    """Better, worse or same by the sign of the difference (turned round for costs); one pair alone decides nothing."""
    sign = -F.col("diff") if cost else F.col("diff")
    return rows.withColumn("verdict", F.when(F.col("n") < 2, "inconclusive").when(sign > 0, "better").when(sign < 0, "worse").otherwise("same"))


def gate(metrics: DataFrame, bounds: DataFrame) -> DataFrame:
    """metrics (metric, value), bounds (metric, low, high): pass, fail or missing for each bound."""
    rows = bounds.join(metrics, "metric", "left")
    fine = (F.col("low").isNull() | (F.col("value") >= F.col("low"))) & (F.col("high").isNull() | (F.col("value") <= F.col("high")))
    return rows.select("metric", "value", F.when(F.col("value").isNull(), "missing").when(fine, "pass").otherwise("fail").alias("status"))


def gate_passed(gated: DataFrame) -> DataFrame:
    """Null without bounds; false with any failure; null with a missing metric; else true."""
    fails, missing = F.count_if(F.col("status") == "fail"), F.count_if(F.col("status") == "missing")
    return gated.agg(F.when(F.count("*") == 0, F.lit(None).cast("boolean")).when(fails > 0, False).when(missing > 0, F.lit(None).cast("boolean")).otherwise(True).alias("passed"))


def regression(base: DataFrame, current: DataFrame, lower_is_better: Sequence[str] = (), threshold: float = 0.05, as_percent: bool = False) -> DataFrame:
    """(metric, value) twice: change and status. ``as_percent`` compares the percentage itself with the threshold."""
    rows = base.withColumnRenamed("value", "base").join(current.withColumnRenamed("value", "current"), "metric", "full")
    delta = F.col("current") - F.col("base")
    share = F.when(F.col("base") != 0, delta / F.abs("base"))
    pct = F.round(share * 100, 6)
    moved = F.abs(share * 100 if as_percent else share) > threshold
    up = F.when(F.col("metric").isin(*lower_is_better), delta < 0).otherwise(delta > 0) if lower_is_better else delta > 0
    status = F.when(F.col("base").isNull(), "new").when(F.col("current").isNull(), "removed").when(~F.coalesce(moved, F.lit(False)), "neutral").when(up, "improved").otherwise("regressed")
    return rows.select("metric", F.round(delta, 6).alias("delta"), pct.alias("pct"), status.alias("status"))


def profile_correctness(got: DataFrame, want: DataFrame, key: str, fields: Sequence[str], sets: Sequence[str]) -> DataFrame:
    """By case: exact fields, set-valued fields compared without order, and all of them."""
    g, w = got.alias("g"), want.alias("w")
    rows = w.join(g, F.col(f"g.{key}") == F.col(f"w.{key}"), "left")
    same = [F.col(f"g.{f}").eqNullSafe(F.col(f"w.{f}")).alias(f"{f}_ok") for f in fields]
    same += [F.array_sort(F.array_distinct(f"g.{f}")).eqNullSafe(F.array_sort(F.array_distinct(f"w.{f}"))).alias(f"{f}_ok") for f in sets]
    out = rows.select(F.col(f"w.{key}").alias(key), *same)
    every = F.lit(True)
    for f in (*fields, *sets):
        every = every & F.col(f"{f}_ok")
    return out.withColumn("all_ok", every)


def filter_cases(cases: DataFrame, tags: Sequence[str] = (), metadata: Mapping[str, str] | None = None) -> DataFrame:
    out = cases.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else cases
    for key, value in (metadata or {}).items():
        out = out.where(F.element_at("metadata", F.lit(key)) == value)
    return out
