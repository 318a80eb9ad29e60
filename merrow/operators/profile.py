"""User profiles as of a time, for all users at once, and evaluation requests from held-out events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered(by: str, column: str, alias: str):
    """The column's values of collected structs, in the order of another field."""
    return F.transform(F.array_sort(F.collect_list(F.struct(by, column))), lambda s: s[column]).alias(alias)


def user_profile(events: DataFrame, items: DataFrame, cutoff: int, order: Sequence[str], top: int = 5, recent: int = 10) -> DataFrame:
    """By user, from events up to the cutoff on visible items: events, price range, top categories, recent items.

    Categories are counted over distinct items; ties by name. Recent items keep repeats. Lists are cut by window ranks
    before they are collected, so a heavy user's history is never gathered.
    """
    seen = events.where(F.col("ts") <= cutoff).join(items.select(F.col("item_id").alias("parent_asin"), "price", "categories"), "parent_asin")
    base = seen.groupBy("user_id").agg(F.count("*").alias("n_events"), F.min("price").alias("price_min"), F.max("price").alias("price_max"))
    counts = seen.select("user_id", "parent_asin", F.explode(F.array_distinct("categories")).alias("category")).distinct().groupBy("user_id", "category").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "category"))).where(F.col("r") <= top)
    tops = ranked.groupBy("user_id").agg(ordered("r", "category", "top_categories"))
    latest = Window.partitionBy("user_id").orderBy(F.desc("ts"), *[F.desc(c) for c in order])
    last = seen.withColumn("r", F.row_number().over(latest)).where(F.col("r") <= recent)
    recents = last.groupBy("user_id").agg(ordered("r", "parent_asin", "recent_items"))
    return base.join(tops, "user_id", "left").join(recents, "user_id", "left")


def love_and_hate(ratings: DataFrame, love: float, hate: float) -> DataFrame:
    """Items by the user's mean rating at or above ``love``, at or below ``hate``."""
    means = ratings.groupBy("user_id", "item_id").agg(F.avg("rating").alias("r"))
    return means.groupBy("user_id").agg(
        F.collect_set(F.when(F.col("r") >= love, F.col("item_id"))).alias("love_items"), F.collect_set(F.when(F.col("r") <= hate, F.col("item_id"))).alias("hate_items")
    )


def love_and_hate_categories(events: DataFrame, items: DataFrame, love: float, hate: float, order: Sequence[str]) -> DataFrame:
    """Categories of the events rated at or above ``love``, and at or below ``hate``, as first seen in the order given.

    events (user_id, item_id, rating, order...); a user's lists have at most one entry a category.
    """
    rows = events.join(items.select("item_id", "categories"), "item_id")
    rows = rows.select("user_id", "rating", F.struct(*order).alias("o"), F.posexplode("categories").alias("pos", "category"))

    def lists(rated, name: str) -> DataFrame:
        first = rows.where(rated).groupBy("user_id", "category").agg(F.min(F.struct("o", "pos", "category")).alias("at"))
        return first.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["category"]).alias(name))

    users = events.select("user_id").distinct()
    loved, hated = lists(F.col("rating") >= love, "love_categories"), lists(F.col("rating") <= hate, "hate_categories")
    return users.join(loved, "user_id", "left").join(hated, "user_id", "left")


#: The segments of users that a kind of request is drawn from; other kinds have no user.
SEGMENTS = {"similar": ("sparse", "warm"), "personalized": ("sparse", "warm"), "constrained": ("sparse", "warm"), "cold_text": ("cold",), "exclusion": ("sparse", "warm")}
VAGUE = ("I need something nice", "what would you take?", "find me a gift")


def build_requests(
    train: DataFrame, target: DataFrame, items: DataFrame, per_cell: int, vague: int = 3, slack: float = 1.2, step: float = 50.0, sparse_max: int = 4, seed: int = 0
) -> DataFrame:
    """Requests of all kinds, ``per_cell`` of each kind and segment, from the users with held-out items.

    similar and personalized aim at all held-out items; constrained at those within a price limit (the first one's price
    with slack, rounded up to a multiple of ``step``) and of its deepest category; cold_text at those of the first one's
    category; exclusion at all but the first. "First" is by item id. A user that a kind has no basis for is passed.
    ambiguous and unanswerable requests have no user and no target.
    """
    from .split import segment

    fields = items.select(F.col("item_id").alias("parent_asin"), "price", "categories", F.element_at("categories", -1).alias("deepest"))
    held = target.select("user_id", "parent_asin").distinct().join(fields, "parent_asin", "left")
    row = F.struct("parent_asin", "price", "deepest", "categories")
    by_user = held.groupBy("user_id").agg(F.array_sort(F.collect_list(row)).alias("held"))  # a user's held-out items
    history = train.groupBy("user_id").agg(F.count_distinct("parent_asin").alias("n"), F.max_by("parent_asin", F.struct("ts", "parent_asin")).alias("last"))
    users = by_user.join(history, "user_id", "left").withColumn("segment", segment(F.coalesce("n", F.lit(0)), sparse_max))
    priced = F.filter("held", lambda x: x["price"].isNotNull() & x["deepest"].isNotNull())
    priced = F.get(priced, F.lit(0))
    limit = F.ceil(priced["price"] * slack / step) * step
    sorted_of = F.get(F.filter("held", lambda x: x["deepest"].isNotNull()), F.lit(0))["deepest"]
    first = F.get("held", F.lit(0))
    ids = lambda wanted: F.array_join(F.transform(wanted, lambda x: x["parent_asin"]), "|")
    has = lambda x, c: F.array_contains(x["categories"], c)
    nothing, no_price = F.lit(None).cast("string"), F.lit(None).cast("double")

    def made(kind: str, holds, targets, text, seed_item=nothing, price=no_price, category=nothing, excluded=nothing):
        fits = holds & F.col("segment").isin(*SEGMENTS[kind])
        value = F.struct(
            F.lit(kind).alias("kind"), targets.alias("targets"), text.alias("text"), seed_item.alias("seed_item_id"), price.cast("double").alias("price_max"), category.alias("category"), excluded.alias("excluded_item")
        )
        return F.when(fits, value)

    fits_both = F.filter("held", lambda x: (x["price"] <= limit) & has(x, priced["deepest"]))
    kinds = F.array(
        made("similar", F.col("last").isNotNull(), ids(F.col("held")), F.concat(F.lit("more like "), "last"), seed_item=F.col("last")),
        made("personalized", F.lit(True), ids(F.col("held")), F.lit("something that fits what I bought")),
        made("constrained", priced.isNotNull(), ids(fits_both), F.format_string("%s under %.0f", priced["deepest"], limit), price=limit, category=priced["deepest"]),
        made("cold_text", sorted_of.isNotNull(), ids(F.filter("held", lambda x: has(x, sorted_of))), F.concat(F.lit("I am new here and want "), sorted_of), category=sorted_of),
        made("exclusion", first["deepest"].isNotNull(), ids(F.filter("held", lambda x: x["parent_asin"] != first["parent_asin"])), F.concat(F.lit("anything but "), first["deepest"], F.lit(", and not "), first["parent_asin"]), category=first["deepest"], excluded=first["parent_asin"]),
    )
    rows = users.select("user_id", "segment", F.explode(F.filter(kinds, lambda k: k.isNotNull())).alias("k")).select("user_id", "segment", "k.*")
    order = Window.partitionBy("kind", "segment").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "kind", "user_id")), "user_id")
    rows = rows.withColumn("index", F.row_number().over(order) - 1).where(F.col("index") < per_cell)
    phrases = F.array(*map(F.lit, VAGUE))
    without = train.sparkSession.range(vague).select(F.col("id").cast("int").alias("index"), F.explode(F.array(F.lit("ambiguous"), F.lit("unanswerable"))).alias("kind"))
    without = without.where((F.col("kind") == "ambiguous") | (F.col("index") < per_cell))
    text = F.when(F.col("kind") == "ambiguous", F.get(phrases, F.col("index") % len(VAGUE))).otherwise("a product that costs less than nothing")
    without = without.select("kind", F.lit("none").alias("segment"), "index", text.alias("text"))
    out = rows.unionByName(without, allowMissingColumns=True)
    oracle = F.col("kind").isin("constrained", "cold_text")  # made from held-out items: an upper bound, no real request
    return out.withColumn("request_id", F.concat_ws("-", "kind", "segment", "index")).withColumn("oracle", oracle).drop("index")
