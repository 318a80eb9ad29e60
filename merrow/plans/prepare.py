"""Queries of sources, cleaning, splitting, leak checks and diagnostics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from merrow.functions.storage import shared_folder
from merrow.operators import clean, eda, ids, kcore, leakage, split
from merrow.sources import interactions as src

from .registry import query
from .views import ORDER, duck

SEQ = ("copy_no", *ORDER)
OK = "user_id IS NOT NULL AND ts >= 631152000000 AND ts < 4102444800000 AND rating BETWEEN 1 AND 5"
SEQ_SQL = ", ".join(SEQ)
ORDER_SQL = ", ".join(ORDER)
CLEAN_SQL = f"v_clean AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, parent_asin, ts ORDER BY {', '.join(c + ' DESC' for c in SEQ)}) AS rn FROM v_raw WHERE {OK}) WHERE rn = 1)"


def scratch(v) -> str:
    return f"{shared_folder(v.spark)}/merrow-raw-{uuid.uuid4().hex}"


@query(duck("v_interactions") + " SELECT user_id, original_item_id AS parent_asin, CAST(rating AS DOUBLE) AS rating, ts AS timestamp FROM v_interactions")
def a01_read_reviews(v):
    """All events as compressed JSON lines, with columns that nobody asks for, read back."""
    path = scratch(v)
    raw = v.v_interactions.select("user_id", F.col("original_item_id").alias("parent_asin"), F.col("rating").cast("double").alias("rating"), F.col("ts").alias("timestamp"), F.lit("x").alias("title"), "domain")
    raw.write.option("compression", "gzip").json(path)
    return src.read_reviews(v.spark, path).drop("source_seq")


@query(duck("v_items") + " SELECT original_item_id AS parent_asin, domain, title, store, CAST(average_rating AS VARCHAR) AS average_rating, concat(cat1, '|', cat2) AS categories FROM v_items WHERE original_item_id IN (SELECT concat('P', CAST(l_partkey AS STRING)) FROM lineitem)")
def a02_read_metadata(v):
    """Item metadata of every domain as JSON lines; what has events is kept."""
    path = scratch(v)
    items = v.v_items.select(F.col("original_item_id").alias("parent_asin"), "domain", "title", "store", F.col("average_rating").cast("string").alias("average_rating"), F.array("cat1", "cat2").alias("categories"), F.lit(1).alias("other"))
    items.write.partitionBy("domain").json(path)
    files = {r.domain: f"{path}/domain={r.domain}" for r in items.select("domain").distinct().collect()}  # one row a domain
    keep = v.v_interactions.select(F.col("original_item_id").alias("parent_asin"), "domain")
    found = src.read_metadata(v.spark, files, keep)
    return found.select("parent_asin", "domain", "title", "store", "average_rating", F.array_join("categories", "|").alias("categories"))


@query(duck("v_interactions") + " SELECT user_id, parent_asin, rating FROM v_interactions")
def a03_scan_pruned(v):
    return v.v_interactions.select("user_id", "parent_asin", "rating")


@query(duck("v_interactions") + " SELECT user_id, original_item_id, parent_asin, domain, ts FROM v_interactions")
def a05_tag_domain(v):
    bare = v.v_interactions.select("user_id", F.col("original_item_id").alias("parent_asin"), "domain", "ts")
    return src.tag_domain(bare).select("user_id", "original_item_id", "parent_asin", "domain", "ts")


@query(duck("v_interactions") + " SELECT user_id, parent_asin, domain, ts FROM v_interactions")
def a06_merge_domains(v):
    rows = v.v_interactions.select("user_id", "parent_asin", "domain", "ts")
    domains = rows.select("domain").distinct().orderBy("domain").collect()  # one row a domain
    return src.merge_domains([rows.where(F.col("domain").eqNullSafe(r.domain)) for r in domains])


@query(duck("v_interactions") + " SELECT domain, count(*) AS events, count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) AS items FROM v_interactions GROUP BY domain")
def a07_domain_breakdown(v):
    return src.domain_breakdown(v.v_interactions)


@query(duck("v_interactions") + " SELECT parent_asin, min(ts) AS first_seen_ts FROM v_interactions GROUP BY parent_asin")
def a08_first_seen(v):
    return src.first_seen(v.v_interactions)


FIRST = "ts, " + ORDER_SQL
USERS_SQL = f"""u AS (SELECT user_id, row_number() OVER (ORDER BY ts, {ORDER_SQL}) - 1 AS idx FROM (SELECT user_id, {FIRST}, row_number() OVER (PARTITION BY user_id ORDER BY {FIRST}) AS rn FROM v_interactions) WHERE rn = 1)"""
ITEMS_SQL = "i AS (SELECT parent_asin, row_number() OVER (ORDER BY parent_asin) - 1 AS idx FROM (SELECT DISTINCT parent_asin FROM v_interactions))"


@query(f"{duck('v_interactions')}, {USERS_SQL}, {ITEMS_SQL} SELECT user_id, parent_asin, ts, u.idx AS user_idx, i.idx AS item_idx FROM v_interactions JOIN u USING (user_id) JOIN i USING (parent_asin)")
def a09_apply_ids(v):
    rows = v.v_interactions
    users, items = ids.build_ids(rows, "user_id", ["ts", *ORDER]), ids.build_sorted_ids(rows, "parent_asin")
    return ids.apply_ids(rows.select("user_id", "parent_asin", "ts"), users, items).select("user_id", "parent_asin", "ts", "user_idx", "item_idx")


@query(f"{duck('v_interactions')}, {USERS_SQL} SELECT user_id, idx FROM u")
def a10_ids_first_occurrence(v):
    return ids.build_ids(v.v_interactions, "user_id", ["ts", *ORDER])


@query(f"{duck('v_interactions')}, {ITEMS_SQL} SELECT parent_asin, idx FROM i")
def a11_ids_sorted(v):
    return ids.build_sorted_ids(v.v_interactions, "parent_asin")


@query(f"{duck('v_interactions')}, {ITEMS_SQL} SELECT parent_asin, idx FROM i")
def a12_saved_ids(v):
    path = scratch(v)
    ids.save_ids(ids.build_sorted_ids(v.v_interactions, "parent_asin"), path)
    return ids.load_ids(v.spark, path, "parent_asin")


@query(f"{duck('v_interactions')}, {ITEMS_SQL} SELECT user_id, i.idx AS item_idx FROM v_interactions JOIN i USING (parent_asin)")
def a13_translate_ids(v):
    rows = v.v_interactions.select("user_id", "parent_asin")
    local, everywhere = ids.build_sorted_ids(rows, "parent_asin"), ids.build_sorted_ids(v.v_interactions, "parent_asin")
    pairs = rows.join(local, "parent_asin").select("user_id", F.col("idx").alias("item_idx"))
    return ids.translate_ids(pairs, local, everywhere, "parent_asin", "item_idx")


@query(duck("v_raw") + " SELECT user_id, parent_asin, rating, ts FROM v_raw WHERE user_id IS NOT NULL AND parent_asin IS NOT NULL AND rating IS NOT NULL AND ts IS NOT NULL")
def b01_drop_missing(v):
    return clean.drop_missing(v.v_raw).select("user_id", "parent_asin", "rating", "ts")


@query(duck("v_raw") + " SELECT user_id, parent_asin, ts FROM v_raw WHERE ts >= 631152000000 AND ts < 4102444800000")
def b02_valid_timestamp(v):
    return v.v_raw.where(clean.valid_ts()).select("user_id", "parent_asin", "ts")


@query(duck("v_raw") + " SELECT user_id, parent_asin, rating FROM v_raw WHERE rating BETWEEN 1 AND 5")
def b03_valid_rating(v):
    return v.v_raw.where(clean.valid_rating()).select("user_id", "parent_asin", "rating")


@query(duck("v_raw") + " SELECT count(*) AS n, round(avg(CASE WHEN ts >= 631152000000 AND ts < 4102444800000 THEN 0.0 ELSE 1.0 END), 6) AS rate FROM v_raw WHERE user_id IS NOT NULL")
def b04_invalid_rate(v):
    return clean.drop_missing(v.v_raw).agg(F.count("*").alias("n"), F.round(F.avg(F.when(clean.valid_ts(), 0.0).otherwise(1.0)), 6).alias("rate"))


@query(f"{duck('v_raw')}, {CLEAN_SQL} SELECT user_id, parent_asin, ts, rating FROM v_clean")
def b05_dedupe_last(v):
    return clean.clean(v.v_raw, SEQ).select("user_id", "parent_asin", "ts", "rating")


@query(f"{duck('v_raw')} SELECT user_id, parent_asin, ts, rating FROM (SELECT *, row_number() OVER (PARTITION BY user_id, parent_asin, ts ORDER BY {SEQ_SQL}) AS rn FROM v_raw WHERE {OK}) WHERE rn = 1")
def b05_dedupe_first(v):
    return clean.dedupe(v.v_raw.where(clean.reason().isNull()), keep="first", seq=SEQ).select("user_id", "parent_asin", "ts", "rating")


REPORT_SQL = f"""{duck('v_raw')}, {CLEAN_SQL},
r AS (SELECT CASE WHEN user_id IS NULL OR parent_asin IS NULL OR rating IS NULL OR ts IS NULL THEN 'missing'
             WHEN NOT (ts >= 631152000000 AND ts < 4102444800000) THEN 'timestamp' WHEN NOT rating BETWEEN 1 AND 5 THEN 'rating' END AS reason FROM v_raw)
SELECT count(*) AS input_rows, count(*) FILTER (WHERE reason = 'missing') AS dropped_missing, count(*) FILTER (WHERE reason = 'timestamp') AS dropped_timestamp,
       count(*) FILTER (WHERE reason = 'rating') AS dropped_rating, count(*) FILTER (WHERE reason IS NULL) - (SELECT count(*) FROM v_clean) AS dropped_duplicates,
       (SELECT count(*) FROM v_clean) AS output_rows, (SELECT count(DISTINCT user_id) FROM v_clean) AS users, (SELECT count(DISTINCT parent_asin) FROM v_clean) AS items FROM r"""


@query(REPORT_SQL)
def b06_clean_report(v):
    return clean.clean_report(v.v_raw)


@query(duck("v_interactions") + " SELECT count(*) AS groups, CAST(coalesce(sum(events), 0) AS BIGINT) AS events FROM (SELECT count(*) AS events FROM v_interactions GROUP BY user_id, ts HAVING count(DISTINCT parent_asin) > 1)")
def b07_multi_item_groups(v):
    return clean.multi_item_groups(v.v_interactions)


@query(f"{duck('v_raw')} SELECT CAST(sum(CASE WHEN same THEN 1 ELSE 0 END) AS BIGINT) AS repeats FROM (SELECT user_id = lag(user_id) OVER w AND parent_asin = lag(parent_asin) OVER w AS same FROM v_raw WINDOW w AS (ORDER BY {SEQ_SQL}))")
def b08_consecutive_repeats(v):
    rows = v.v_raw.withColumn("slice", F.col("copy_no") * 1_000_000_000 + F.floor(F.col("l_orderkey") / 1000))
    return clean.consecutive_repeats(rows, SEQ, "slice")


def kcore_sql(view: str, k: int, rounds: int, pairs: bool = False) -> str:
    """The rounds written out; more rounds than it takes to settle change nothing."""
    start = f"SELECT DISTINCT user_id, parent_asin FROM {view}" if pairs else f"SELECT * FROM {view}"
    steps = [f"{duck(view)}, k0 AS MATERIALIZED ({start})"]
    for n in range(rounds):
        steps.append(
            f"k{n + 1} AS MATERIALIZED (SELECT * FROM k{n} WHERE user_id IN (SELECT user_id FROM k{n} GROUP BY 1 HAVING count(*) >= {k}) AND parent_asin IN (SELECT parent_asin FROM k{n} GROUP BY 1 HAVING count(*) >= {k}))"
        )
    return ", ".join(steps)


@query(f"{kcore_sql('v_interactions', 3, 20)} SELECT user_id, parent_asin, ts FROM k20")
def b09_k_core_events(v):
    return kcore.k_core(v.v_interactions, 3, 3).select("user_id", "parent_asin", "ts")


@query(f"{kcore_sql('v_interactions', 3, 20, True)} SELECT e.user_id, e.parent_asin, e.ts FROM v_interactions e JOIN k20 USING (user_id, parent_asin)")
def b10_k_core_pairs(v):
    core = kcore.k_core_pairs(v.v_interactions, 3, 3)
    return v.v_interactions.join(core, ["user_id", "parent_asin"], "left_semi").select("user_id", "parent_asin", "ts")


@query(duck("v_split") + " SELECT c1 AS first_cutoff, c2 AS second_cutoff FROM v_cut")
def b11_temporal_cutoffs(v):
    first, second = split.temporal_cutoffs(v.v_interactions)
    return v.spark.range(1).select(F.lit(first).cast("long").alias("first_cutoff"), F.lit(second).cast("long").alias("second_cutoff"))


@query(duck("v_split") + " SELECT user_id, parent_asin, ts, split FROM v_split")
def b12_temporal_split(v):
    return split.require_splits(v.split()).select("user_id", "parent_asin", "ts", "split")


@query(duck("v_split") + " SELECT 'fit' AS part, user_id, ts FROM v_split WHERE split <> 'test' UNION ALL SELECT 'target', user_id, ts FROM v_split WHERE split = 'test'")
def b13_select_fit_target(v):
    fit, target = split.select_fit_target(v.split(), "test")
    return fit.select(F.lit("fit").alias("part"), "user_id", "ts").unionByName(target.select(F.lit("target").alias("part"), "user_id", "ts"))


def core_of_train(rounds: int = 20) -> str:
    return ", ".join(
        [duck("v_split"), "k0 AS MATERIALIZED (SELECT * FROM v_split WHERE split = 'train')"]
        + [f"k{n + 1} AS MATERIALIZED (SELECT * FROM k{n} WHERE user_id IN (SELECT user_id FROM k{n} GROUP BY 1 HAVING count(*) >= 3) AND parent_asin IN (SELECT parent_asin FROM k{n} GROUP BY 1 HAVING count(*) >= 3))" for n in range(rounds)]
    )


@query(f"""{core_of_train()} SELECT user_id, parent_asin, ts, dense_rank() OVER (ORDER BY user_id) - 1 AS user_idx, dense_rank() OVER (ORDER BY parent_asin) - 1 AS item_idx FROM k20""")
def b14_train_core(v):
    core, users, items = kcore.prepare_train_core(v.split().where("split = 'train'"), 3, 3)
    return ids.apply_ids(core.select("user_id", "parent_asin", "ts"), users, items).select("user_id", "parent_asin", "ts", "user_idx", "item_idx")


COHORT_SQL = """h AS (SELECT user_id, count(DISTINCT parent_asin) AS n FROM v_split WHERE split = 'train' GROUP BY 1),
c AS (SELECT user_id, coalesce(n, 0) AS history_size, CASE WHEN coalesce(n, 0) = 0 THEN 'cold' WHEN n <= 4 THEN 'sparse' ELSE 'warm' END AS segment
      FROM (SELECT DISTINCT user_id FROM v_split WHERE split = 'validation') LEFT JOIN h USING (user_id))"""


@query(f"{duck('v_split')}, {COHORT_SQL} SELECT user_id, history_size, segment FROM c")
def b15_evaluation_cohort(v):
    return split.cohort(*split.select_fit_target(v.split(), "validation"))


@query(f"""{core_of_train()}, t AS (SELECT s.*, s.user_id NOT IN (SELECT user_id FROM k20) AS nu, s.parent_asin NOT IN (SELECT parent_asin FROM k20) AS ni FROM v_split s WHERE split <> 'train')
SELECT domain, split, count(*) AS events, count(DISTINCT CASE WHEN nu THEN user_id END) AS users_without_history, count(DISTINCT CASE WHEN ni THEN parent_asin END) AS cold_items,
       round(avg(CASE WHEN ni THEN 1.0 ELSE 0.0 END), 6) AS cold_event_rate FROM t GROUP BY domain, split""")
def b16_train_core_report(v):
    rows = v.split()
    return split.train_core_report(kcore.k_core(rows.where("split = 'train'"), 3, 3), rows)


DOMAINS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"""{kcore_sql('v_interactions', 2, 20)}, """ + ", ".join(
    [f"d{i}_0 AS MATERIALIZED (SELECT * FROM v_interactions WHERE domain = '{d}')" for i, d in enumerate(DOMAINS)]
    + [f"d{i}_{n + 1} AS MATERIALIZED (SELECT * FROM d{i}_{n} WHERE user_id IN (SELECT user_id FROM d{i}_{n} GROUP BY 1 HAVING count(*) >= 2) AND parent_asin IN (SELECT parent_asin FROM d{i}_{n} GROUP BY 1 HAVING count(*) >= 2))" for n in range(20) for i in range(6)]
) + " SELECT (SELECT count(*) FROM (" + " UNION ".join(f"SELECT user_id FROM d{i}_20" for i in range(6)) + ")) AS users_single_domain, (SELECT count(DISTINCT user_id) FROM k20) AS users_combined")
def b17_cold_start_report(v):
    return kcore.cold_start_report(v.v_interactions, 2, 2, DOMAINS)


@query(duck("v_split") + """ SELECT min(ts) FILTER (WHERE split = 'train') AS train_min, max(ts) FILTER (WHERE split = 'train') AS train_max, min(ts) FILTER (WHERE split = 'validation') AS validation_min,
 max(ts) FILTER (WHERE split = 'validation') AS validation_max, min(ts) FILTER (WHERE split = 'test') AS test_min, max(ts) FILTER (WHERE split = 'test') AS test_max,
 max(ts) FILTER (WHERE split = 'train') <= min(ts) FILTER (WHERE split = 'validation') AND max(ts) FILTER (WHERE split = 'validation') <= min(ts) FILTER (WHERE split = 'test') AS ok FROM v_split""")
def c01_split_order(v):
    return leakage.check_order(v.split())


@query(duck("v_split") + """, p AS (SELECT user_id, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, max(CASE WHEN split = 'validation' THEN 1 ELSE 0 END) AS b, max(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS c FROM v_split GROUP BY 1)
SELECT CAST(sum(a * b) AS BIGINT) AS train_validation, CAST(sum(a * c) AS BIGINT) AS train_test, CAST(sum(b * c) AS BIGINT) AS validation_test, sum(a * b) + sum(a * c) + sum(b * c) = 0 AS ok FROM p""")
def c02_split_overlap(v):
    return leakage.check_overlap(v.split(), ["user_id"])


@query(duck("v_split") + " SELECT count(*) FILTER (WHERE ts > (SELECT c1 FROM v_cut)) AS late_rows, max(ts) AS max_ts, count(*) FILTER (WHERE ts > (SELECT c1 FROM v_cut)) = 0 AS ok FROM v_split WHERE split <> 'test'")
def c03_profile_snapshot(v):
    return leakage.check_asof(v.split().where("split <> 'test'"), split.temporal_cutoffs(v.v_interactions)[0])


@query(f"""{kcore_sql('v_interactions', 3, 20)}, x AS (SELECT user_id, parent_asin, count(*) AS w FROM k20 GROUP BY 1, 2), y AS (SELECT user_id, parent_asin, count(*) AS h FROM v_interactions GROUP BY 1, 2)
SELECT CAST(coalesce(sum(greatest(w - coalesce(h, 0), 0)), 0) AS BIGINT) AS extra_rows, coalesce(sum(greatest(w - coalesce(h, 0), 0)), 0) = 0 AS ok
FROM x LEFT JOIN y USING (user_id, parent_asin)""")
def c04_core_is_subset(v):
    core = kcore.k_core(v.v_interactions, 3, 3)
    return leakage.check_subset(v.v_interactions, core, ["user_id", "parent_asin"])


@query(duck("v_split") + " SELECT max(ts) FILTER (WHERE split = 'train') AS fit_max, min(ts) FILTER (WHERE split = 'validation') AS target_min, max(ts) FILTER (WHERE split = 'train') < min(ts) FILTER (WHERE split = 'validation') AND min(ts) FILTER (WHERE split = 'train') > 0 AS ok FROM v_split")
def c05_evaluation_protocol(v):
    return leakage.check_protocol(*split.select_fit_target(v.split(), "validation"))


@query(duck("v_split") + """, x AS (SELECT *, l_partkey AS item_idx, CAST(substr(user_id, 2) AS BIGINT) AS user_idx FROM v_split)
SELECT split, count(*) AS rows, min(ts) AS min_ts, max(ts) AS max_ts, max(user_idx) AS max_user, max(item_idx) AS max_item, count(*) FILTER (WHERE user_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM customer) OR item_idx NOT BETWEEN 0 AND (SELECT count(*) - 1 FROM part)) AS out_of_range FROM x GROUP BY split""")
def c06_split_audit(v):
    rows = v.split().select("split", "ts", F.col("l_partkey").alias("item_idx"), F.expr("cast(substr(user_id, 2) as long)").alias("user_idx"))
    return leakage.audit_splits(rows, v.n_users(), v.n_items())


@query(duck("v_interactions", "v_items") + """ SELECT (SELECT count(*) FROM v_interactions) AS events, (SELECT count(*) FROM (SELECT DISTINCT user_id, parent_asin FROM v_interactions)) AS pairs,
(SELECT count(*) FROM v_items WHERE item_id NOT IN (SELECT parent_asin FROM v_interactions)) AS unmapped_items, (SELECT count(DISTINCT parent_asin) FROM v_interactions WHERE parent_asin NOT IN (SELECT item_id FROM v_items)) AS uncatalogued_ids""")
def c07_preflight(v):
    return leakage.preflight(v.v_interactions, v.v_items, v.v_interactions.select("parent_asin").distinct())


@query(duck("v_split") + """, f AS (SELECT user_id, parent_asin, min(ts) AS t FROM v_split GROUP BY 1, 2), s AS (SELECT DISTINCT user_id, parent_asin FROM v_split WHERE l_linenumber <= 2),
fu AS (SELECT user_id, parent_asin FROM f WHERE t > (SELECT c1 FROM v_cut))
SELECT user_id, count(*) FILTER (WHERE (user_id, parent_asin) IN (SELECT user_id, parent_asin FROM fu)) AS leaked_items, count(*) FILTER (WHERE (user_id, parent_asin) IN (SELECT user_id, parent_asin FROM fu)) > 0 AS leak
FROM s WHERE user_id IN (SELECT user_id FROM fu) GROUP BY user_id""")
def c08_leak_probe(v):
    shown = v.v_interactions.where("l_linenumber <= 2").groupBy("user_id").agg(F.collect_set("parent_asin").alias("items"))
    return leakage.leak_probe(v.v_interactions, shown, split.temporal_cutoffs(v.v_interactions)[0]).withColumn("leaked_items", F.col("leaked_items").cast("long"))


PER_USER = "p AS (SELECT user_id, count(*) AS n FROM v_interactions GROUP BY 1)"


@query(f"""{duck('v_interactions')}, {PER_USER} SELECT (SELECT count(*) FROM p) AS users, count(DISTINCT parent_asin) AS items, count(*) AS events,
round(1 - count(*) * 1.0 / ((SELECT count(*) FROM p) * count(DISTINCT parent_asin)), 6) AS sparsity, round((SELECT avg(n) FROM p), 6) AS mean_per_user, (SELECT quantile_cont(n, 0.5) FROM p) AS median_per_user,
round((SELECT quantile_cont(n, 0.9) FROM p), 6) AS p90_per_user, min(ts) AS min_ts, max(ts) AS max_ts FROM v_interactions""")
def d01_interaction_stats(v):
    return eda.interaction_stats(v.v_interactions)


@query(f"""{duck('v_interactions')}, {PER_USER} SELECT round(avg(rating), 6) AS avg_rating, round((SELECT quantile_cont(n, 0.99) FROM p), 6) AS p99_per_user, (SELECT max(n) FROM p) AS max_per_user,
(SELECT count(*) FROM p WHERE n = 1) AS users_one, (SELECT count(*) FROM p WHERE n >= 5) AS users_five, (SELECT count(*) FROM p WHERE n >= 10) AS users_ten FROM v_interactions""")
def d02_stats_report(v):
    return eda.stats_report(v.v_interactions)


@query(duck("v_items") + """ SELECT count(*) AS items, count(store) AS with_store, count(price) AS with_price, count(rating_number) AS with_rating_number, round(sum(coalesce(rating_number, 0)) / count(*), 6) AS mean_rating_number,
round(avg(average_rating), 6) AS mean_average_rating, count(DISTINCT store) AS stores, (SELECT count(*) FROM (SELECT cat1 FROM v_items UNION SELECT cat2 FROM v_items)) AS categories FROM v_items""")
def d03_metadata_stats(v):
    return eda.metadata_stats(eda.with_categories(v.v_items))


@query(duck("v_items") + " SELECT c AS category, count(*) AS n FROM (SELECT cat1 AS c FROM v_items UNION ALL SELECT cat2 FROM v_items) GROUP BY c ORDER BY n DESC, c LIMIT 10")
def d03_top_categories(v):
    return eda.top_categories(eda.with_categories(v.v_items), 10)


@query(duck("v_split") + " SELECT user_id, count(*) AS events, CASE WHEN count(*) <= 3 THEN 'sparse_history' ELSE 'warm' END AS segment FROM v_split WHERE ts <= (SELECT c1 FROM v_cut) GROUP BY 1")
def d04_segment_users(v):
    return eda.segment_users(v.v_interactions, split.temporal_cutoffs(v.v_interactions)[0])


@query(duck("v_split") + """, u AS (SELECT split, user_id, count(DISTINCT domain) AS d FROM v_split GROUP BY 1, 2)
SELECT split, count(*) AS rows, count(DISTINCT user_id) AS users, count(DISTINCT parent_asin) AS items, min(ts) AS min_ts, max(ts) AS max_ts, round(avg(CASE WHEN domain = 'PROMO' THEN 1.0 ELSE 0.0 END), 6) AS largest_domain_share,
(SELECT round(100.0 * avg(CASE WHEN d > 1 THEN 1.0 ELSE 0.0 END), 6) FROM u WHERE u.split = s.split) AS multi_domain_pct FROM v_split s GROUP BY split""")
def d05_split_diagnosis(v):
    return eda.diagnose_splits(v.split(), "PROMO")


@query(duck("v_split") + """, fp AS (SELECT DISTINCT user_id, parent_asin FROM v_split WHERE split = 'train'), tp AS (SELECT DISTINCT user_id, parent_asin, domain FROM v_split WHERE split = 'validation'),
hs AS (SELECT user_id, count(*) AS n FROM fp GROUP BY 1),
x AS (SELECT tp.*, tp.parent_asin IN (SELECT parent_asin FROM fp) AS warm, fp.user_id IS NOT NULL AS rep, coalesce(hs.n, 0) AS hist FROM tp LEFT JOIN fp USING (user_id, parent_asin) LEFT JOIN hs ON hs.user_id = tp.user_id),
g AS (SELECT coalesce(domain, '*') AS domain, user_id, count(*) AS n, count(*) FILTER (WHERE warm AND NOT rep) AS e, max(hist) AS hist, count(*) FILTER (WHERE warm) AS w, count(*) FILTER (WHERE rep) AS r FROM x GROUP BY GROUPING SETS ((domain, user_id), (user_id)))
SELECT domain, CAST(sum(n) AS BIGINT) AS target_pairs, round(100.0 * sum(w) / sum(n), 6) AS item_warm_pct, round(100.0 * sum(r) / sum(n), 6) AS repeat_pct, round(100.0 * sum(e) / sum(n), 6) AS novel_warm_pct,
round(100.0 * avg(CASE WHEN hist = 0 THEN 1.0 ELSE 0.0 END), 6) AS cold_user_pct, min(hist) AS min_history, quantile_cont(hist, 0.5) AS median_history, round(quantile_cont(hist, 0.9), 6) AS p90_history, round(avg(least(10, e) * 1.0 / n), 6) AS recall_ceiling FROM g GROUP BY domain""")
def d06_target_coverage(v):
    return eda.target_coverage(*split.select_fit_target(v.split(), "validation"))


@query(f"{duck('v_split')}, {COHORT_SQL} SELECT segment, count(*) AS users FROM c GROUP BY 1")
def d07_segment_by_history(v):
    return split.cohort(*split.select_fit_target(v.split(), "validation")).groupBy("segment").agg(F.count("*").alias("users"))


@query(duck("v_tool_log") + " SELECT tool, count(*) AS calls, round(sum(latency_seconds), 6) AS total, round(avg(latency_seconds), 6) AS mean, round(quantile_cont(latency_seconds, 0.5), 6) AS p50, round(quantile_cont(latency_seconds, 0.95), 6) AS p95 FROM v_tool_log GROUP BY 1")
def d08_latency_summary(v):
    return eda.latency_summary(v.v_tool_log, ["tool"])
