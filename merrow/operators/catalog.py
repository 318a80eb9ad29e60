"""The item catalog: normalised metadata, as-of views, structured filters, listing and lookup."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from difflib import SequenceMatcher
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FILTERS = (
    "domain", "price_min", "price_max", "include_missing_price", "average_rating_min", "rating_number_min",
    "categories_any", "categories_all", "store", "title_contains", "exclude_item_ids",
)


def ascii_fold_case(column: Column | str) -> Column:
    """A-Z in lower case; other letters stay, as in a binary-compared store."""
    return F.translate(column, UPPER, LOWER)


def filled(column: str) -> Column:
    return F.when(F.col(column).isNotNull() & (F.trim(F.col(column).cast("string")) != ""), 1).otherwise(0)


def dedupe_metadata(df: DataFrame, seq: Sequence[str], fields: Sequence[str], keys: Sequence[str] = ("domain", "asin")) -> DataFrame:
    """The most complete row of each key, the earliest of equals."""
    full = sum((filled(c) for c in fields), F.lit(0))
    others = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(-full, *seq)).alias("_row"))
    return best.select(*keys, "_row.*").select(*df.columns)


def coerced(column: str) -> Column:
    """A number from text with $ and thousands commas; anything else is null."""
    text = F.regexp_replace(F.trim(F.col(column).cast("string")), "[$,]", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))


def normalized_categories(column: Column | str) -> Column:
    """Trimmed, without blanks and nulls, first of equals kept; null is an empty list."""
    items = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda c: F.trim(c))
    return F.array_distinct(F.filter(items, lambda c: c.isNotNull() & (c != "")))


def coverage(items: DataFrame, ids: DataFrame) -> DataFrame:
    """Over all ('*') and by domain: mapped ids, how many have a catalog row, and their share."""
    have = items.select("item_id").distinct().withColumn("have", F.lit(True))
    rows = ids.join(have, "item_id", "left").select("have", F.explode(F.array("domain", F.lit("*"))).alias("domain"))
    return rows.groupBy("domain").agg(F.count("*").alias("ids"), F.count("have").alias("covered"), F.round(F.count("have") / F.count("*"), 6).alias("share"))


def require_coverage(report: DataFrame, least: float) -> DataFrame:
    low = report.where(F.col("share") < least).limit(5).collect()
    if low:
        raise ValueError(f"coverage under {least}: {[r.asDict() for r in low]}")
    return report


def validate_catalog(items: DataFrame) -> DataFrame:
    """One row: ids twice, ids without the domain's prefix, blank domains; ok if there are none."""
    twice = items.groupBy("item_id").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("repeated_ids"))
    wrong = items.agg(
        F.count_if(~F.col("item_id").eqNullSafe(F.concat_ws("::", "domain", "original_item_id"))).alias("bad_ids"),
        F.count_if(F.coalesce(F.trim("domain"), F.lit("")) == "").alias("blank_domains"),
    )
    return twice.crossJoin(wrong).withColumn("ok", F.col("repeated_ids") + F.col("bad_ids") + F.col("blank_domains") == 0)  # one row each


def catalog_asof(items: DataFrame, policy: str, cutoff: int) -> DataFrame:
    """items with first_seen_ts; what may change later is hidden under historical_static_catalog."""
    if policy == "no_filter":
        return items
    if policy not in ("historical_static_catalog", "snapshot"):
        raise ValueError(f"unknown policy {policy}")
    seen = items.where(F.col("first_seen_ts").isNotNull() & (F.col("first_seen_ts") <= cutoff))
    if policy == "snapshot":
        return seen
    return seen.withColumns({c: F.lit(None).cast("double") for c in ("price", "average_rating", "rating_number")})


def predicate(spec: Mapping[str, Any], domains: Sequence[str] | None = None) -> Column:
    """One Column from a filter spec. Unknown keys and impossible ranges are errors; empty values are no filter."""
    if unknown := set(spec) - set(FILTERS):
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    spec = {k: v for k, v in spec.items() if v is not None and v != "" and v != []}
    out = F.lit(True)
    if wanted := spec.get("domain"):
        wanted = [wanted] if isinstance(wanted, str) else list(wanted)
        if domains is not None and (wrong := set(wanted) - set(domains)):
            raise ValueError(f"unknown domains: {sorted(wrong)}")
        out = out & F.col("domain").isin(wanted)
    low, high = spec.get("price_min"), spec.get("price_max")
    if low is not None and high is not None and low > high:
        raise ValueError("price_min > price_max")
    if low is not None or high is not None:
        price = F.lit(True)
        price = price & (F.col("price") >= low) if low is not None else price
        price = price & (F.col("price") <= high) if high is not None else price
        out = out & (price | F.col("price").isNull() if spec.get("include_missing_price") else price)
    for key in ("average_rating", "rating_number"):
        if (least := spec.get(f"{key}_min")) is not None:
            out = out & (F.col(key) >= least)
    if wanted := spec.get("categories_any"):
        out = out & F.arrays_overlap("categories", F.array(*map(F.lit, wanted)))
    if wanted := spec.get("categories_all"):
        wanted = sorted(set(wanted))
        out = out & (F.size(F.array_intersect("categories", F.array(*map(F.lit, wanted)))) == len(wanted))
    if "store" in spec:
        out = out & (ascii_fold_case("store") == ascii_fold_case(F.lit(spec["store"])))
    if "title_contains" in spec:
        if "\0" in spec["title_contains"]:
            raise ValueError("NUL in title_contains")
        out = out & F.contains(ascii_fold_case("title"), ascii_fold_case(F.lit(spec["title_contains"])))
    if wanted := spec.get("exclude_item_ids"):
        out = out & ~F.col("item_id").isin(list(wanted))
    return out


def apply_filters(items: DataFrame, spec: Mapping[str, Any], domains: Sequence[str] | None = None) -> DataFrame:
    return items.where(predicate(spec, domains))


@F.pandas_udf(T.DoubleType())
def matching_ratio(first: pd.Series, second: pd.Series) -> pd.Series:
    """Twice the characters in matching blocks over the characters of both names."""
    return pd.Series([SequenceMatcher(None, a, b).ratio() for a, b in zip(first, second, strict=True)], dtype=float)


def _letters(names: DataFrame, name: str) -> DataFrame:
    """(name, length, letter): each character with its number among equal ones of the name, so that sets can tell repeats."""
    chars = F.regexp_extract_all(name, F.lit("(?s)(.)"), F.lit(1))
    numbered = F.transform(chars, lambda c, i: F.concat(c, F.size(F.filter(F.slice(chars, 1, i + 1), lambda d: d == c)).cast("string")))
    return names.select(name, F.char_length(name).alias("length"), F.explode(numbered).alias("letter"))


def close_names(wanted: DataFrame, vocabulary: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """wanted (category), vocabulary (known) -> (category, known, score): the ``most`` closest by matching ratio, at ``least``.

    Names in matching blocks share characters: two names of lengths a and b need least / 2 * (a + b) common ones, of which
    at least one is among the rarest characters of each, as many as may be missing and one more. Only such pairs are
    compared, so common letters bring no names together. Ties go to the name that sorts last.
    """
    known = _letters(vocabulary.where("known <> ''"), "known")
    rarity = known.groupBy("letter").agg(F.count("*").alias("n"))

    def rarest(letters: DataFrame, name: str) -> DataFrame:
        counted = letters.join(rarity, "letter", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        place = F.row_number().over(Window.partitionBy(name).orderBy("n", "letter"))  # a row a character of a name
        # the shortest partner that can reach the ratio has least / (2 - least) of the length
        needed = F.ceil(F.lit(least / 2) * F.col("length") * (1 + least / (2 - least)) - F.lit(1e-9))
        return counted.withColumn("place", place).where(F.col("place") <= F.col("length") - needed + 1).select(name, F.col("length").alias(f"{name}_length"), "letter")

    asked = _letters(wanted.select("category").distinct().where("category <> ''"), "category")
    total = F.col("category_length") + F.col("known_length")
    pairs = rarest(asked, "category").join(rarest(known, "known"), "letter")
    pairs = pairs.where(2 * F.least("category_length", "known_length") >= least * total - 1e-9).select("category", "known").distinct()
    scored = pairs.withColumn("score", matching_ratio("known", "category")).where(F.col("score") >= least)
    order = Window.partitionBy("category").orderBy(F.desc("score"), F.desc("known"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def resolve_categories(wanted: DataFrame, vocabulary: DataFrame, least: float = 0.6, most: int = 5) -> DataFrame:
    """wanted (category): the exact name, else the one name that differs in ASCII case, else close names by matching ratio.

    The vocabulary is the catalog's distinct categories; a name without any match keeps its closest ones.
    """
    v = vocabulary.select(F.col("category").alias("known"))
    exact = wanted.join(v, F.col("category") == F.col("known"), "left").select("category", F.col("known").alias("exact"))
    folded = v.groupBy(ascii_fold_case("known").alias("key")).agg(F.min("known").alias("folded"))
    found = exact.join(folded, ascii_fold_case("category") == F.col("key"), "left").select("category", F.coalesce("exact", "folded").alias("resolved"))
    near = close_names(found.where(F.col("resolved").isNull()), v, least, most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "known"))), lambda s: s["known"])  # ``most`` of them
    return found.join(near.groupBy("category").agg(ordered.alias("suggestions")), "category", "left")


def filter_items(items: DataFrame, spec: Mapping[str, Any], order: str = "rating_number", desc: bool = True, limit: int = 20) -> DataFrame:
    """The first rows in the order given, nulls last either way, with the number of all matches and whether it was cut."""
    found = apply_filters(items, spec)
    key = F.col(order).desc_nulls_last() if desc else F.col(order).asc_nulls_last()
    total = found.agg(F.count("*").alias("total_matches"))
    return found.orderBy(key, "item_id").limit(limit).crossJoin(total).withColumn("truncated", F.col("total_matches") > limit)  # one row


def lookup(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (pos, item_id): every id asked for in its place, found or not."""
    return wanted.join(items, "item_id", "left").withColumn("missing", F.col("domain").isNull())


def read_only_query(spark: SparkSession, sql: str, views: Mapping[str, DataFrame], max_rows: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, one row with truncated) of one SELECT or WITH statement over the views given."""
    if not re.match(r"\s*(select|with)\b", sql, re.IGNORECASE) or re.search(r";\s*\S", sql):
        raise ValueError("one SELECT or WITH statement")
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    rows = spark.sql(sql.rstrip().rstrip(";"))
    over = rows.limit(max_rows + 1).agg((F.count("*") > max_rows).alias("truncated"))
    return rows.limit(max_rows), over


def item_text(items: DataFrame) -> DataFrame:
    return items.select("item_id", "title", F.concat_ws(" ", "main_category", F.array_join("categories", " ")).alias("text"))


def catalog_text(items: DataFrame) -> DataFrame:
    """Title, store, main category and sorted categories in one text, absent parts left out."""
    part = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value, F.lit(". "))).otherwise("")
    text = F.concat(
        F.coalesce("title", F.lit("")), F.lit(". "), part("Store", F.col("store")), part("Main", F.col("main_category")),
        part("Categories", F.array_join(F.array_sort("categories"), ", ")),
    )
    return items.select("item_id", F.trim(text).alias("text"))


def deepest_category(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.when(F.size("categories") > 0, F.element_at("categories", -1)).alias("deepest"))


def satisfying(recs: DataFrame, items: DataFrame, price_max: float, category: str) -> DataFrame:
    """By request: recommended items with a known price within the limit and the category, and items without price."""
    joined = recs.join(items, "item_id")
    good = (F.col("price") <= price_max) & F.array_contains("categories", category)
    return joined.groupBy("request_id").agg(F.count_if(F.coalesce(good, F.lit(False))).alias("satisfying"), F.count_if(F.col("price").isNull()).alias("without_price"))


def normalize_candidates(lists: DataFrame) -> DataFrame:
    """lists (request_id, candidates array<struct<item_id, score>>): one row an item, its first position, scores kept."""
    rows = lists.select("request_id", F.posexplode("candidates").alias("pos", "c"))
    blank = F.coalesce(F.trim("c.item_id"), F.lit("")) == ""
    checked = rows.select("request_id", "pos", F.when(blank, F.raise_error(F.lit("candidate without item_id")).cast("string")).otherwise(F.col("c.item_id")).alias("item_id"), F.col("c.score").alias("score"))
    first = checked.groupBy("request_id", "item_id").agg(F.min(F.struct("pos", "score")).alias("f"))
    order = Window.partitionBy("request_id").orderBy("f.pos")
    return first.select("request_id", "item_id", (F.row_number().over(order) - 1).alias("pos"), F.col("f.score").alias("score"))
