"""Queries of the catalog: building it, filters, listing, lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from merrow.operators import catalog
from merrow.sources import interactions as src

from .registry import query
from .views import duck

META_SQL = duck("v_items") + """,
m AS (SELECT domain, original_item_id AS asin, title, store, price, seq, 0 AS copy_no FROM v_items
      UNION ALL SELECT domain, original_item_id, CASE WHEN seq % 2 = 0 THEN NULL ELSE title END, coalesce(store, 'Brand#0'), price, seq, 1 FROM v_items WHERE seq % 11 = 0)"""
PRICE_TEXT = "CASE seq % 6 WHEN 0 THEN '$1,234.50' WHEN 1 THEN 'N/A' WHEN 2 THEN NULL WHEN 3 THEN '1.0d' WHEN 4 THEN 'NaN' ELSE concat(' ', CAST(seq AS STRING), '.25') END"


def items(v):
    """The catalog with its categories as a list."""
    return v.v_items.withColumn("categories", F.array("cat1", "cat2"))


def meta(v):
    rows = v.v_items
    first = rows.selectExpr("domain", "original_item_id AS asin", "title", "store", "price", "seq", "0 AS copy_no")
    again = rows.where("seq % 11 = 0").selectExpr("domain", "original_item_id AS asin", "CASE WHEN seq % 2 = 0 THEN NULL ELSE title END AS title", "coalesce(store, 'Brand#0') AS store", "price", "seq", "1 AS copy_no")
    return first.unionByName(again)


def asof_items(v):
    return items(v).join(src.first_seen(v.v_interactions).withColumnRenamed("parent_asin", "item_id"), "item_id", "left")


@query(META_SQL + """, r AS (SELECT *, row_number() OVER (PARTITION BY domain, asin ORDER BY (CASE WHEN title IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN store IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN price IS NOT NULL THEN 1 ELSE 0 END) DESC, copy_no, seq) AS rn FROM m)
SELECT domain, asin, title, store, price, copy_no FROM r WHERE rn = 1""")
def b18_dedupe_metadata(v):
    return catalog.dedupe_metadata(meta(v), ["copy_no", "seq"], ["title", "store", "price"]).select("domain", "asin", "title", "store", "price", "copy_no")


@query(duck("v_items") + f" SELECT item_id, CASE seq % 6 WHEN 0 THEN 1234.5 WHEN 5 THEN CAST(seq + 0.25 AS DOUBLE) END AS price FROM v_items")
def b19_coerce_numeric(v):
    return v.v_items.withColumn("text", F.expr(PRICE_TEXT)).select("item_id", catalog.coerced("text").alias("price"))


@query(duck("v_items") + " SELECT item_id, CASE WHEN seq % 5 = 0 THEN '' ELSE concat(main_category, '|', cat2) END AS categories FROM v_items")
def b20_normalize_categories(v):
    dirty = v.v_items.withColumn("c", F.expr("CASE WHEN seq % 5 = 0 THEN NULL ELSE array(concat(' ', cat1), '  ', cat2, NULL, concat(cat1, ' ')) END"))
    return dirty.select("item_id", F.array_join(catalog.normalized_categories("c"), "|").alias("categories"))


@query(duck("v_items", "v_interactions") + """, i AS (SELECT item_id, domain, item_id IN (SELECT parent_asin FROM v_interactions) AS have FROM v_items)
SELECT domain, count(*) AS ids, count(*) FILTER (WHERE have) AS covered, round(count(*) FILTER (WHERE have) * 1.0 / count(*), 6) AS share
FROM (SELECT domain, have FROM i UNION ALL SELECT '*', have FROM i) GROUP BY domain""")
def b21_coverage(v):
    return catalog.coverage(v.v_interactions.select(F.col("parent_asin").alias("item_id")), v.v_items.select("item_id", "domain"))


@query(duck("v_items") + " SELECT 0 AS repeated_ids, count(*) FILTER (WHERE item_id <> concat(domain, '::', original_item_id)) AS bad_ids, count(*) FILTER (WHERE trim(coalesce(domain, '')) = '') AS blank_domains, true AS ok FROM v_items")
def b22_validate_catalog(v):
    return catalog.validate_catalog(v.v_items)


CUT = 880_000_000_000
SEEN_SQL = duck("v_items", "v_interactions") + ", s AS (SELECT parent_asin AS item_id, min(ts) AS first_seen_ts FROM v_interactions GROUP BY 1)"


@query(f"{SEEN_SQL} SELECT item_id, title, first_seen_ts, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS DOUBLE) AS average_rating, CAST(NULL AS DOUBLE) AS rating_number FROM v_items JOIN s USING (item_id) WHERE first_seen_ts <= {CUT}")
def b23_catalog_asof_static(v):
    return catalog.catalog_asof(asof_items(v), "historical_static_catalog", CUT).select("item_id", "title", "first_seen_ts", "price", "average_rating", "rating_number")


@query(f"{SEEN_SQL} SELECT item_id, title, first_seen_ts, price, average_rating, rating_number FROM v_items JOIN s USING (item_id) WHERE first_seen_ts <= {CUT}")
def b23_catalog_asof_snapshot(v):
    return catalog.catalog_asof(asof_items(v), "snapshot", CUT).select("item_id", "title", "first_seen_ts", "price", "average_rating", "rating_number")


def filtered(name: str, spec: dict, where: str) -> None:
    sql = f"{duck('v_items')} SELECT item_id, domain, price, store, title FROM v_items WHERE {where}"
    query(sql, name)(lambda v: catalog.apply_filters(items(v), spec, ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]).select("item_id", "domain", "price", "store", "title"))


filtered(
    "e01_filters_together",
    {"domain": ["PROMO", "SMALL"], "price_max": 1500.0, "average_rating_min": 2.0, "categories_any": ["Brand#1", "Brand#2", "Brand#3"], "title_contains": "", "exclude_item_ids": []},
    "domain IN ('PROMO', 'SMALL') AND price <= 1500 AND average_rating >= 2.0 AND (cat1 IN ('Brand#1', 'Brand#2', 'Brand#3') OR cat2 IN ('Brand#1', 'Brand#2', 'Brand#3'))",
)
filtered("e02_filter_domain", {"domain": ["PROMO", "LARGE"]}, "domain IN ('PROMO', 'LARGE')")
filtered("e03_filter_price", {"price_min": 950.0, "price_max": 1000.0}, "price BETWEEN 950 AND 1000")
filtered("e03_filter_price_or_missing", {"price_min": 950.0, "price_max": 1000.0, "include_missing_price": True}, "price BETWEEN 950 AND 1000 OR price IS NULL")
filtered("e04_filter_ratings", {"average_rating_min": 3.5, "rating_number_min": 400}, "average_rating >= 3.5 AND rating_number >= 400")
filtered("e05_filter_categories_any", {"categories_any": ["PROMO", "Brand#7"]}, "cat1 IN ('PROMO', 'Brand#7') OR cat2 IN ('PROMO', 'Brand#7')")
filtered("e06_filter_categories_all", {"categories_all": ["PROMO", "Brand#7", "PROMO"]}, "cat1 = 'PROMO' AND cat2 = 'Brand#7'")
filtered("e07_filter_store", {"store": "bRAND#5"}, "translate(store, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') = 'brand#5'")
filtered("e08_filter_title", {"title_contains": "E W"}, "contains(translate(title, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'e w')")
filtered("e09_filter_exclude", {"domain": "SMALL", "exclude_item_ids": [f"SMALL::P{i}" for i in range(100)]}, "domain = 'SMALL' AND seq >= 100")


@query(duck("v_items") + " SELECT DISTINCT main_category AS category, main_category AS resolved FROM v_items")
def e10_resolve_categories(v):
    known = items(v).select(F.explode("categories").alias("category")).distinct()
    wanted = v.v_items.select(F.lower("main_category").alias("category")).distinct()
    return catalog.resolve_categories(wanted, known).select(F.upper("category").alias("category"), "resolved")


@query(duck("v_items") + " SELECT item_id, rating_number, price, (SELECT count(*) FROM v_items WHERE price <= 1000) AS total_matches, (SELECT count(*) FROM v_items WHERE price <= 1000) > 25 AS truncated FROM v_items WHERE price <= 1000 ORDER BY rating_number DESC NULLS LAST, item_id LIMIT 25")
def e11_filtered_listing(v):
    return catalog.filter_items(items(v), {"price_max": 1000.0}, "rating_number", True, 25).select("item_id", "rating_number", "price", "total_matches", "truncated")


@query(duck("v_items") + " SELECT item_id, rating_number, (SELECT count(*) FROM v_items WHERE domain = 'PROMO') AS total_matches FROM v_items WHERE domain = 'PROMO' ORDER BY rating_number ASC NULLS LAST, item_id LIMIT 25")
def e11_filtered_listing_ascending(v):
    return catalog.filter_items(items(v), {"domain": "PROMO"}, "rating_number", False, 25).select("item_id", "rating_number", "total_matches")


@query(duck("v_interactions", "v_items") + ", w AS (SELECT row_number() OVER (ORDER BY x) AS pos, x AS item_id FROM (SELECT DISTINCT CASE WHEN l_partkey % 10 = 0 THEN concat(parent_asin, '?') ELSE parent_asin END AS x FROM v_interactions)) SELECT pos, w.item_id, title, v_items.item_id IS NULL AS missing FROM w LEFT JOIN v_items ON w.item_id = v_items.item_id")
def e12_lookup(v):
    from merrow.operators.ids import build_sorted_ids

    wanted = v.v_interactions.select(F.expr("CASE WHEN l_partkey % 10 = 0 THEN concat(parent_asin, '?') ELSE parent_asin END").alias("item_id"))
    wanted = build_sorted_ids(wanted, "item_id").select("item_id", (F.col("idx") + 1).alias("pos"))
    return catalog.lookup(items(v), wanted).select("pos", "item_id", "title", "missing")


@query(duck("v_items") + " SELECT domain, count(*) AS n, max(price) AS top FROM v_items GROUP BY domain ORDER BY domain LIMIT 4")
def e13_read_only_query(v):
    sql = "SELECT domain, count(*) AS n, max(price) AS top FROM items GROUP BY domain ORDER BY domain"
    return catalog.read_only_query(v.spark, sql, {"items": items(v)}, 4)[0]


@query(duck("v_items") + " SELECT DISTINCT domain, cat2 AS category FROM v_items UNION SELECT DISTINCT domain, cat1 FROM v_items")
def e14_domains_and_categories(v):
    return items(v).select("domain", F.explode("categories").alias("category")).distinct()


@query(duck("v_items") + " SELECT item_id, title, concat(main_category, ' ', cat1, ' ', cat2) AS text FROM v_items")
def e15_item_text(v):
    return catalog.item_text(items(v))


@query(duck("v_interactions", "v_items") + " SELECT user_id AS request_id, count(*) FILTER (WHERE price <= 1000 AND (cat1 = 'PROMO' OR cat2 = 'PROMO')) AS satisfying, count(*) FILTER (WHERE price IS NULL) AS without_price FROM (SELECT DISTINCT user_id, parent_asin FROM v_interactions) t JOIN v_items ON parent_asin = item_id GROUP BY 1")
def e16_satisfying(v):
    recs = v.v_interactions.select(F.col("user_id").alias("request_id"), F.col("parent_asin").alias("item_id")).distinct()
    return catalog.satisfying(recs, items(v), 1000.0, "PROMO")


@query(duck("v_items") + " SELECT item_id, cat2 AS deepest FROM v_items")
def e17_deepest_category(v):
    return catalog.deepest_category(items(v))


@query(duck("v_interactions") + ", f AS (SELECT user_id AS request_id, parent_asin AS item_id, row_number() OVER (PARTITION BY user_id ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS p, l_quantity AS score FROM v_interactions), g AS (SELECT request_id, item_id, min(p) AS p, arg_min(score, p) AS score FROM f GROUP BY 1, 2) SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY p) - 1 AS pos, score FROM g")
def e18_normalize_candidates(v):
    from .views import ORDER

    row = F.struct(*ORDER, F.struct(F.col("parent_asin").alias("item_id"), F.col("l_quantity").alias("score")).alias("c"))
    lists = v.v_interactions.groupBy(F.col("user_id").alias("request_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["c"]).alias("candidates"))
    return catalog.normalize_candidates(lists)


@query(duck("v_items") + " SELECT item_id, concat(title, '. ', CASE WHEN store IS NULL THEN '' ELSE concat('Store: ', store, '. ') END, 'Main: ', main_category, '. Categories: ', least(cat1, cat2), ', ', greatest(cat1, cat2), '.') AS text FROM v_items")
def f10_catalog_text(v):
    return catalog.catalog_text(items(v))
