"""Checks of answers against the catalog. answers (answer_id, text, item_ids)."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: how ids, numbers, prices and ratings are written
ITEM = r"((?<![A-Za-z0-9_])[A-Za-z][A-Za-z0-9_]*::[A-Za-z0-9_-]*[A-Za-z0-9_])"
NUMBER = r"(\d+(?:[.,]\d+)*)"
CURRENCIES = ("USD", "usd", "đô la", "đô", "dollars", "dollar")
STARS = ("sao", "stars", "star")
# one number is read once: what an id has taken is no price, and what a price has taken is no rating
WITH_CURRENCY = rf"\$\s?{NUMBER}|{NUMBER}\s?(?:{'|'.join(CURRENCIES)})(?![\p{{L}}\p{{N}}_])"
OUT_OF_FIVE = rf"(?<![\d.,])\d(?:[.,]\d)?\s*(?:/\s*5|(?:{'|'.join(STARS)}))(?![\p{{L}}\p{{N}}_])"
MENTION = f"{ITEM}|{WITH_CURRENCY}|{OUT_OF_FIVE}"
# fixed values: product codes, phrases that claim nothing, and words of claims
CODE = r"(?<![A-Za-z0-9_:])(B0[0-9A-Z]{8})(?![A-Za-z0-9_])"
COURTESIES = (
    r"(here|the following|these are|below) (are|is|you can find)",
    r"(i|we) (recommend|suggest)",
    r"(please|feel free to)",
    r"(hope|this helps)",
    r"let me know",
    r"based on your request",
    r"(thank you|thanks)",
    r"(sure|of course)",
)
COURTESY = f"^({'|'.join(COURTESIES)})"
PRODUCT_WORDS = (
    "price rating review star category store cheap expensive wireless wire cable feature best popular suitable good great dollar cents $ rated".split()
)


def number_value(raw: Column) -> Column:
    """The value of a number as people write it; null for what is no number.

    A comma before three digits each time, or beside a point that comes last, parts thousands; any other comma is a decimal
    comma. Points part thousands where there are several, or where a decimal comma follows; a single point is decimal.
    """
    comma, point = F.contains(raw, F.lit(",")), F.contains(raw, F.lit("."))
    continental = raw.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | raw.rlike(r"^\d{1,3}(\.\d{3}){2,}$")
    plain = (
        F.when(continental, F.translate(raw, ",.", "."))
        .when(comma & point, F.translate(raw, ",", ""))
        .when(raw.rlike(r"^\d+(,\d{3})+$"), F.translate(raw, ",", ""))
        .otherwise(F.translate(raw, ",", "."))
    )
    return plain.try_cast("double")


def numbers_in(text: Column | str) -> Column:
    """The values of all numbers of a text."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1)), number_value), lambda x: x.isNotNull())


def mentioned(text: Column | str) -> Column:
    """Structs (kind, raw, value) of the ids, prices and ratings of a text, from left to right; a number belongs to one of them."""

    def read(m: Column) -> Column:
        item, price = F.contains(m, F.lit("::")), m.rlike(rf"^\$|(?:{'|'.join(CURRENCIES)})$")
        raw = F.when(item, m).otherwise(F.regexp_extract(m, NUMBER, 1))
        kind = F.when(item, "item").when(price, "price").otherwise("rating")
        return F.struct(kind.alias("kind"), raw.alias("raw"), F.when(~item, number_value(raw)).alias("value"))

    return F.transform(F.regexp_extract_all(text, F.lit(MENTION), F.lit(0)), read)


def mentions(answers: DataFrame) -> DataFrame:
    """(answer_id, kind, value): item ids, prices and ratings as written."""
    return answers.select("answer_id", F.explode(mentioned("text")).alias("m")).select("answer_id", "m.kind", F.col("m.raw").alias("value"))


def mention_values(answers: DataFrame) -> DataFrame:
    """(answer_id, kind, amount): prices and ratings by value; what is no number is left out."""
    rows = answers.select("answer_id", F.explode(mentioned("text")).alias("m"))
    return rows.where(F.col("m.value").isNotNull()).select("answer_id", "m.kind", F.col("m.value").alias("amount"))


def check_grounding(answers: DataFrame, items: DataFrame, price_tolerance: float = 0.01, rating_tolerance: float = 0.05, code: str = CODE) -> DataFrame:
    """By answer: foreign ids, ids in the order given, product codes without domain, prices and ratings without basis.

    answers (answer_id, text, item_ids[, request_text]). A price has a basis in the price of a given item, in a number of
    the request and in a number of a given title; a rating in the rating of a given item to one decimal.
    """
    given = answers.select("answer_id", F.explode("item_ids").alias("item_id")).join(items.select("item_id", "price", "average_rating", "title"), "item_id")
    facts = given.groupBy("answer_id").agg(
        F.collect_set("price").alias("prices"),
        F.collect_set(F.bround("average_rating", 1)).alias("ratings"),
        F.flatten(F.collect_list(numbers_in(F.coalesce("title", F.lit(""))))).alias("printed"),
    )
    own = F.transform("item_ids", lambda x: F.element_at(F.split(x, "::"), -1))
    empty = F.array().cast("array<double>")
    rows = answers.join(facts, "answer_id", "left").withColumn("_said", mentioned("text"))
    of = lambda kind, field: F.transform(F.filter("_said", lambda m: m["kind"] == kind), lambda m: m[field])
    ids = of("item", "raw")

    def wrong(kind: str, known: Column, tolerance: float) -> Column:
        return F.size(F.filter(of(kind, "value"), lambda x: x.isNotNull() & ~F.exists(known, lambda y: F.abs(x - y) <= tolerance + 1e-9)))

    asked = numbers_in(F.coalesce("request_text", F.lit(""))) if "request_text" in answers.columns else empty
    known = F.concat(F.coalesce("prices", empty), F.coalesce("printed", empty), asked)
    codes = F.regexp_extract_all("text", F.lit(code), F.lit(1))
    out = rows.select(
        "answer_id",
        F.size(F.array_except(ids, "item_ids")).alias("foreign_ids"),
        (F.array_distinct(ids) == F.col("item_ids")).alias("ids_in_order"),
        F.size(F.filter(codes, lambda x: ~F.array_contains(own, x))).alias("bare_codes"),
        wrong("price", known, price_tolerance).alias("wrong_prices"),
        wrong("rating", F.coalesce("ratings", empty), rating_tolerance).alias("wrong_ratings"),
    )
    clean = [F.col(c) == 0 for c in ("foreign_ids", "bare_codes", "wrong_prices", "wrong_ratings")]
    return out.withColumn("grounded", reduce(and_, clean))


def claims(answers: DataFrame, items: DataFrame) -> DataFrame:
    """One row a sentence that claims something of a product: of which item, what, and whether the item's fields support it.

    The item is the one whose id the sentence has, else the first given one with two words of its title in it. Phrases of
    courtesy claim nothing, and neither do sentences without item or product word. A claim is contradicted by another
    number or name, unsupported where the field is null or nothing can be checked.
    """
    sentences = answers.select("answer_id", "item_ids", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("no", "sentence")).withColumn("low", F.lower("sentence"))
    sentences = sentences.where(~F.col("low").rlike(COURTESY)).withColumn("named", F.regexp_extract("sentence", ITEM, 1))
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))
    titles = answers.select("answer_id", F.posexplode("item_ids").alias("at", "item_id")).join(items.select("item_id", "title"), "item_id")
    meant = sentences.where("named = ''").join(titles, "answer_id").where(F.size(F.array_intersect(words("sentence"), words("title"))) >= 2)
    meant = meant.groupBy("answer_id", "no").agg(F.min_by("item_id", "at").alias("by_title"))
    found = sentences.join(meant, ["answer_id", "no"], "left").withColumn("item_id", F.coalesce(F.nullif("named", F.lit("")), "by_title"))
    has = lambda *parts: reduce(or_, [F.contains("low", F.lit(p)) for p in parts])
    found = found.where(F.col("item_id").isNotNull() | has(*PRODUCT_WORDS)).join(items.withColumn("known", F.lit(True)), "item_id", "left")
    bare = F.regexp_replace("low", "[a-z_]+::[a-z0-9]+", " ")  # an id's digits are no claim
    number = lambda p: F.regexp_extract(bare, p, 1).try_cast("double")

    def judged(field: str, good):
        return F.when(F.col(field).isNull(), "unsupported").when(F.coalesce(good, F.lit(True)), "supported").otherwise("contradicted")

    in_sentence = lambda c: F.contains("low", F.lower(c))
    of_title = F.size(F.array_intersect(words("sentence"), words("title"))) >= 2
    kinds = [
        (has("price", "cost", "$", "dollar", "cheap", "expensive"), "price", judged("price", F.abs(number(r"\$?(\d+\.?\d*)") - F.col("price")) <= 0.01 + 1e-9)),
        (has("rating", "star", "rated", "/5", "out of 5"), "rating", judged("average_rating", F.abs(number(r"(\d\.?\d*)\s*(?:star|rating|/|out of)") - F.col("average_rating")) <= 0.1 + 1e-9)),
        (has("review"), "reviews", judged("rating_number", number(r"(\d+)\s*(?:review|rating)") == F.col("rating_number"))),
        (has("store", "sold by", "available at"), "store", judged("store", in_sentence("store"))),
        (has("category", "type", "belongs to"), "category", judged("main_category", in_sentence("main_category"))),
        (of_title, "title", F.lit("supported")),
    ]
    kind, verdict = F.lit("other"), F.lit("unsupported")
    for condition, name, of in reversed(kinds):
        kind, verdict = F.when(condition, name).otherwise(kind), F.when(condition, of).otherwise(verdict)
    verdict = F.when(F.col("known").isNull(), "unknown_item").otherwise(verdict)
    return found.select("answer_id", "no", "item_id", kind.alias("claim"), verdict.alias("verdict"))


def grounding_rates(judged: DataFrame) -> DataFrame:
    """judged (case_id, verdict): share of supported and of unsupported claims."""
    good = F.count_if(F.col("verdict") == "supported")
    return judged.groupBy("case_id").agg(F.count("*").alias("claims"), F.round(good / F.count("*"), 6).alias("grounding_rate"), F.round(1 - good / F.count("*"), 6).alias("hallucination_rate"))
