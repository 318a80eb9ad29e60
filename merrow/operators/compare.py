"""Comparisons of recommenders: guard-rails, variants by history, probes outside the core, query availability."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from merrow.functions.storage import stored

from .metrics import ranking_metrics, retrieval_metrics


def policy_guardrails(
    by_policy: DataFrame, baseline: str, metric: str, least_gain: float, retention: Mapping[str, float], ceilings: Mapping[str, float] | None = None
) -> DataFrame:
    """by_policy (policy, metrics...): gain against the baseline's row, and whether the guards hold.

    A metric of ``retention`` keeps at least its share of the baseline's; one of ``ceilings``, a latency, stays under so
    many times the baseline's.
    """
    ceilings = ceilings or {}
    base = by_policy.where(F.col("policy") == baseline).select(*[F.col(c).alias(f"base_{c}") for c in (metric, *retention, *ceilings)])
    rows = by_policy.crossJoin(base)  # one row
    gain = F.col(metric) - F.col(f"base_{metric}")
    kept = F.lit(True)
    for name, share in retention.items():
        kept = kept & (F.col(name) >= share * F.col(f"base_{name}"))
    for name, ratio in ceilings.items():
        kept = kept & (F.col(name) <= ratio * F.col(f"base_{name}"))
    return rows.select("policy", F.round(gain, 6).alias("gain"), kept.alias("guards_kept"), ((gain >= least_gain) & kept & (F.col("policy") != baseline)).alias("accepted"))


def history_bucket(size: Column) -> Column:
    return F.when(size == 0, "0").when(size <= 4, "1-4").when(size <= 9, "5-9").otherwise("10+")


def variant_compare(variants: Mapping[str, DataFrame], targets: DataFrame, cohort: DataFrame, k: int) -> DataFrame:
    """NDCG and recall at k of each variant by the size of the user's history, and over all ('all')."""
    out = None
    for name, recs in variants.items():
        rows = stored(ranking_metrics(recs, targets, k).select("user_id", "ndcg", "recall", F.lit(name).alias("variant")), "variant")
        out = rows if out is None else out.unionByName(rows)
    joined = out.join(cohort.select("user_id", history_bucket(F.col("history_size")).alias("bucket")), "user_id")
    levels = joined.withColumn("bucket", F.explode(F.array("bucket", F.lit("all"))))
    return levels.groupBy("variant", "bucket").agg(F.count("*").alias("users"), F.round(F.avg("ndcg"), 6).alias("ndcg"), F.round(F.avg("recall"), 6).alias("recall"))


def tuning_arms(cohort: DataFrame, per_segment: int, seed: int = 0) -> DataFrame:
    """(user_id, segment, arm): disjoint users for tuning and for confirmation, as many of a segment in either.

    Users are taken by a digest of their id. A segment of one user has nobody for a second arm and is left out.
    """
    sizes = cohort.groupBy("segment").agg(F.least(F.lit(per_segment), F.floor(F.count("*") / 2)).alias("size"))
    order = Window.partitionBy("segment").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("user_id"))), "user_id")
    placed = cohort.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * per_segment).join(sizes, "segment")
    arm = F.when(F.col("r") <= F.col("size"), "tuning").when(F.col("r") <= 2 * F.col("size"), "confirmation")
    return placed.select("user_id", "segment", arm.alias("arm")).where("arm IS NOT NULL")


def tune_hybrid(variants: Mapping[float, DataFrame], targets: DataFrame, cohort: DataFrame, per_segment: int, k: int) -> DataFrame:
    """(arm, weight, objective, chosen): NDCG at k by segment, weighted by the segments' users in the whole cohort.

    The weight with the best objective in the tuning arm (the smallest of equals) is chosen, and it alone is evaluated
    in the confirmation arm. Variants are few; their lists stay distributed.
    """
    arms = stored(tuning_arms(cohort, per_segment), "arms")
    share = cohort.groupBy("segment").agg(F.count("*").alias("users"))
    share = share.crossJoin(cohort.agg(F.count("*").alias("all_users"))).select("segment", (F.col("users") / F.col("all_users")).alias("share"))  # one row

    def objective(weight: float, arm: str) -> float:
        ndcg = ranking_metrics(variants[weight], targets, k).join(arms.where(F.col("arm") == arm), "user_id")
        means = ndcg.groupBy("segment").agg(F.avg("ndcg").alias("m")).join(share, "segment")
        return means.agg(F.round(F.sum(F.col("m") * F.col("share")), 6).alias("o")).first().o or 0.0

    tuned = {weight: objective(weight, "tuning") for weight in sorted(variants)}
    best = max(sorted(tuned), key=lambda weight: tuned[weight])
    rows = [("tuning", float(w), o, w == best) for w, o in tuned.items()] + [("confirmation", float(best), objective(best, "confirmation"), True)]
    return cohort.sparkSession.createDataFrame(rows, "arm string, weight double, objective double, chosen boolean")


def outside_core_eval(lists: DataFrame, targets: DataFrame, core: DataFrame, n_items: int) -> DataFrame:
    """lists (user_id, source, item): retrieval of the targets whose items are outside the core, by source."""
    outside = targets.join(core.select("item").distinct(), "item", "left_anti")
    return retrieval_metrics(lists, outside, n_items, ["source"]).select("source", "users", "macro_recall", "hit_rate")


def query_availability(cohort: DataFrame, queries: DataFrame) -> DataFrame:
    """By segment: users, and how many have a query with any token. queries (user_id, query)."""
    rows = cohort.join(queries, "user_id", "left")
    has = F.coalesce(F.trim("query"), F.lit("")) != ""
    return rows.groupBy("segment").agg(F.count("*").alias("users"), F.count_if(has).alias("with_query"), F.round(F.avg(F.when(has, 1.0).otherwise(0.0)), 6).alias("share"))


def score_outcome(
    recs: DataFrame, targets: DataFrame, seen: DataFrame, items: DataFrame, k: int, seeds: DataFrame | None = None, wanted: DataFrame | None = None
) -> DataFrame:
    """By user: ranking metrics; of what is shown, the share already seen, distinct domains and main categories.

    items (item, domain[, main_category]); with seeds (user_id, item) also whether a seed is shown, and with wanted
    (user_id, category) whether that main category is. Null where nothing is shown.
    """
    shown = recs.where(F.col("rank") <= k)
    flags = shown.join(seen.select("user_id", "item", F.lit(1).alias("s")).distinct(), ["user_id", "item"], "left").join(items, "item", "left")
    extra = [F.round(F.avg(F.coalesce("s", F.lit(0))), 6).alias("seen_rate"), F.count_distinct("domain").alias("domains")]
    if "main_category" in items.columns:
        extra.append(F.count_distinct("main_category").alias("main_categories"))
    if seeds is not None:
        flags = flags.join(seeds.select("user_id", "item", F.lit(True).alias("seed")).distinct(), ["user_id", "item"], "left")
        flags = flags.join(seeds.select("user_id", F.lit(True).alias("asked")).distinct(), "user_id", "left")
        extra.append((F.bool_or(F.coalesce("seed", F.lit(False))) & F.bool_or(F.coalesce("asked", F.lit(False)))).alias("seed_in_result"))
    if wanted is not None:
        flags = flags.join(wanted, "user_id", "left")
        extra.append(F.max(F.when(F.col("main_category") == F.col("category"), 1.0).otherwise(0.0)).alias("category_coverage"))
    return ranking_metrics(recs, targets, k).join(flags.groupBy("user_id").agg(*extra), "user_id", "left")


def recommend_from_intent(found: DataFrame, queries: DataFrame, seen: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """found (query_id, id, score, rank) in search order, without seen items, with titles; price words in a query are an error."""
    from pyspark.sql import Window

    price = F.col("text").rlike(r"(?i)(\$\s*\d|\d+\s*(usd|dollars?)\b)")
    asked = queries.select("query_id", F.when(price, F.raise_error(F.lit("price belongs in a filter")).cast("int")).otherwise(0).alias("fine"))
    rows = found.join(asked.where("fine = 0"), "query_id", "left_semi").join(seen, ["query_id", "id"], "left_anti").join(items, "id")
    order = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query_id", "id", "title", "place")
