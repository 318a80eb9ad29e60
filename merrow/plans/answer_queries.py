"""Queries of answers whose numbers and ids are written in several ways."""

from __future__ import annotations

from pyspark.sql import functions as F

from merrow.operators import grounding

from .registry import query
from .views import duck

#: Items with ids that have - and _, and prices beyond a thousand.
ID = "concat(domain, '_x::P-', CAST(seq AS STRING), '_', CAST(seq % 7 AS STRING))"
DEAR = "price + 1000 * (seq % 4)"
#: A price in notations that people use; ``said`` is the price, wrong for every seventh item.
THOUSANDS, REST = "CAST(CAST(floor(said / 1000) AS INT) AS STRING)", "printf('%06.2f', said - 1000 * floor(said / 1000))"
ENGLISH = f"CASE WHEN said >= 1000 THEN concat({THOUSANDS}, ',', {REST}) ELSE printf('%.2f', said) END"
CONTINENTAL = f"CASE WHEN said >= 1000 THEN concat({THOUSANDS}, '.', replace({REST}, '.', ',')) ELSE replace(printf('%.2f', said), '.', ',') END"
PRICE = f"""CASE seq % 6 WHEN 0 THEN concat('$', {ENGLISH}) WHEN 1 THEN concat({CONTINENTAL}, ' USD') WHEN 2 THEN concat({ENGLISH}, ' dollars')
  WHEN 3 THEN concat('$ ', {ENGLISH}, ' USD') WHEN 4 THEN concat({CONTINENTAL}, ' đô') ELSE concat(replace(printf('%.2f', said), '.', ','), 'usd') END"""
STARS = """CASE seq % 4 WHEN 0 THEN concat(replace(printf('%.1f', rated), '.', ','), ' / 5') WHEN 1 THEN concat(printf('%.1f', rated), ' stars')
  WHEN 2 THEN concat(replace(printf('%.1f', rated), '.', ','), ' sao') ELSE concat(printf('%.1f', rated), '/5') END"""
TEXT = f"""concat(item_id, ' costs ', coalesce({PRICE}, 'nothing'), ', rated ', {STARS}, '; yours was 1,234.50 and $99. ',
  CASE WHEN seq % 5 = 0 THEN 'See BIG_y::Q-1_z too.' ELSE '' END)"""
REQUEST = "'about 99 or 1.234,50'"
SAID = {
    "item_id": ID,
    "price": DEAR,
    "said": f"CASE WHEN seq % 7 = 0 THEN {DEAR} + 10 ELSE {DEAR} END",
    "rated": "CASE WHEN seq % 9 = 0 THEN average_rating - 0.5 ELSE average_rating END",
}
ITEMS = duck("v_items") + f", i AS (SELECT seq, title, average_rating, {', '.join(f'{e} AS {n}' for n, e in SAID.items())} FROM v_items), a AS (SELECT *, {TEXT} AS text FROM i)"

# without look-behind: prices are read where no id is left, ratings where no price is left
IDS = r"[A-Za-z][A-Za-z0-9_]*::[A-Za-z0-9_-]*[A-Za-z0-9_]"
NUM = r"\d+(?:[.,]\d+)*"
PRICES = rf"\$\s?{NUM}(?:\s?USD)?|{NUM}\s?(?:USD|usd|đô|dollars)"
READ = f"""{ITEMS}, r1 AS (SELECT *, regexp_replace(text, '{IDS}', '#', 'g') AS t1 FROM a), r2 AS (SELECT *, regexp_replace(t1, '{PRICES}', '#', 'g') AS t2 FROM r1),
m AS (
  SELECT seq, 'item' AS kind, unnest(regexp_extract_all(text, '{IDS}')) AS value FROM a
  UNION ALL SELECT seq, 'price', regexp_extract(unnest(regexp_extract_all(t1, '{PRICES}')), '{NUM}') FROM r2
  UNION ALL SELECT seq, 'rating', regexp_extract(unnest(regexp_extract_all(t2, '\\d(?:[.,]\\d)?\\s*(?:/\\s*5|sao|stars)')), '{NUM}') FROM r2)"""
VALUE = r"""CAST(CASE WHEN regexp_full_match(value, '\d{1,3}(\.\d{3})+,\d+') THEN replace(replace(value, '.', ''), ',', '.')
  WHEN contains(value, ',') AND contains(value, '.') OR regexp_full_match(value, '\d+(,\d{3})+') THEN replace(value, ',', '') ELSE replace(value, ',', '.') END AS DOUBLE)"""


def written(v):
    """answers (answer_id, text, item_ids, request_text, ...) and the items that they are about."""
    rows = v.v_items.select("seq", "title", "average_rating", *[F.expr(e).alias(n) for n, e in SAID.items()])
    answers = rows.select(F.col("seq").alias("answer_id"), F.expr(TEXT).alias("text"), F.array("item_id").alias("item_ids"), F.expr(REQUEST).alias("request_text"))
    return answers, rows


@query(f"{READ} SELECT seq AS answer_id, kind, value FROM m")
def n01_mentions_as_written(v):
    return grounding.mentions(written(v)[0])


@query(f"{READ} SELECT seq AS answer_id, kind, {VALUE} AS amount FROM m WHERE kind <> 'item'")
def n01_mention_values(v):
    return grounding.mention_values(written(v)[0])


@query(
    f"""{READ}, x AS (SELECT m.*, {VALUE} AS amount FROM m WHERE kind <> 'item'),
w AS (
  SELECT x.seq, count(*) FILTER (WHERE kind = 'price' AND NOT (abs(amount - 99) <= 0.01 OR abs(amount - 1234.5) <= 0.01
      OR coalesce(abs(amount - price) <= 0.010000001, false)
      OR len(list_filter(list_transform(regexp_extract_all(title, '{NUM}'), lambda t: CAST(t AS DOUBLE)), lambda t: abs(amount - t) <= 0.01)) > 0)) AS wrong_prices,
    count(*) FILTER (WHERE kind = 'rating' AND abs(amount - round_even(average_rating, 1)) > 0.050000001) AS wrong_ratings
  FROM x JOIN a USING (seq) GROUP BY 1),
f AS (SELECT seq, count(*) FILTER (WHERE value <> item_id) AS foreign_ids FROM m JOIN a USING (seq) WHERE kind = 'item' GROUP BY 1)
SELECT seq AS answer_id, foreign_ids, foreign_ids = 0 AS ids_in_order, 0 AS bare_codes, wrong_prices, wrong_ratings,
  foreign_ids = 0 AND wrong_prices = 0 AND wrong_ratings = 0 AS grounded FROM w JOIN f USING (seq)"""
)
def n02_check_as_written(v):
    return grounding.check_grounding(*written(v))
