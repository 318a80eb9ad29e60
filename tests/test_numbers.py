"""Numbers, prices, ratings and ids as people write them."""

import math

import pytest
from pyspark.sql import functions as F

from merrow.operators import grounding

VALUES = [
    ("12", 12.0), ("12.50", 12.5), ("12,50", 12.5), ("1,299", 1299.0), ("1,299.00", 1299.0), ("1.299,00", 1299.0), ("1.299", 1.299), ("1.299.000", 1299000.0),
    ("12,5", 12.5), ("1,234,567", 1234567.0), ("1,234,567.89", 1234567.89), ("1.234.567,8", 1234567.8), ("1,2,3", None), ("1.2.3", None), ("0,005", 5.0), (None, None),
]


def test_values_of_numbers(spark):
    rows = spark.createDataFrame([(raw,) for raw, _ in VALUES], "raw string").select("raw", grounding.number_value(F.col("raw")).alias("v")).collect()
    assert {r.raw: r.v for r in rows} == dict(VALUES)


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("costs 1.299,00 USD now", [("price", "1.299,00", 1299.0)]),
        ("$12,50 USD", [("price", "12,50", 12.5)]),  # one number, read once
        ("$ 4 / 5", [("price", "4", 4.0)]),
        ("rated 4,5 / 5 and 3.5 stars, 4 sao; 14,5 / 5", [("rating", "4,5", 4.5), ("rating", "3.5", 3.5), ("rating", "4", 4.0)]),
        ("20 dollars, 1 dollar, 5 đô la, 7 đô, 3 usdt", [("price", "20", 20.0), ("price", "1", 1.0), ("price", "5", 5.0), ("price", "7", 7.0)]),
        ("Dom_a::B-12_x, see x_Dom::Y_ and Dom::A-.", [("item", "Dom_a::B-12_x", None), ("item", "x_Dom::Y_", None), ("item", "Dom::A", None)]),
        ("D::P4 / 5 and D::9 USD", [("item", "D::P4", None), ("item", "D::9", None)]),
        ("$1,2,3 and 5 starsx", [("price", "1,2,3", None)]),
        ("", []),
    ],
)
def test_mentions_own_their_numbers(spark, text, found):
    rows = spark.createDataFrame([(text,)], "text string").select(F.explode(grounding.mentioned("text")).alias("m")).select("m.*").collect()
    assert [tuple(r) for r in rows] == found


def test_answers_are_checked_in_any_notation(spark):
    items = spark.createDataFrame([("D::A-1", 1299.0, 4.5, "Cable 3,5 mm"), ("D::B", None, 3.26, None)], "item_id string, price double, average_rating double, title string")
    texts = [
        "D::A-1 costs 1.299,00 USD, 4,5 / 5.", "D::A-1 costs $1,299 and 12,50 USD.", "D::A-1 has 3,5 dollars and 4.4 stars", "Up to 40,5 USD", "D::A-2 is 4,5/5",
        "D::B is 3.3 stars", None,
    ]
    given = [["D::A-1"]] * 5 + [["D::B"], ["D::B"]]
    answers = spark.createDataFrame([(i, t, g, "under 40.50") for i, (t, g) in enumerate(zip(texts, given))], "answer_id int, text string, item_ids array<string>, request_text string")
    got = {r.answer_id: (r.foreign_ids, r.wrong_prices, r.wrong_ratings, r.grounded) for r in grounding.check_grounding(answers, items).collect()}
    assert got[0] == (0, 0, 0, True) and got[1] == (0, 1, 0, False) and got[2] == (0, 0, 1, False)
    assert got[3] == (0, 0, 0, True) and got[4] == (1, 0, 0, False) and got[5] == (0, 0, 0, True)
    assert not any(isinstance(v, float) and math.isnan(v) for row in got.values() for v in row)
