"""Queries of trajectory logs, dialogues, grounding and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from merrow.functions.draws import draw_sql
from merrow.operators import dialogue, grounding, profile, provenance, stats, trajectory

from .catalog_queries import items
from .registry import query
from .views import ORDER, duck

LOG, SCORED = duck("v_tool_log"), duck("v_scored")


@query(f"{duck('v_interactions', 'v_items')}" + """, e AS (SELECT t.*, price, cat1, cat2, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS rn FROM v_interactions t JOIN v_items ON parent_asin = item_id WHERE ts <= 915148800000),
c AS (SELECT user_id, c, count(*) AS n FROM (SELECT user_id, unnest([cat1, cat2]) AS c FROM (SELECT DISTINCT user_id, parent_asin, cat1, cat2 FROM e)) GROUP BY 1, 2), tc AS (SELECT user_id, string_agg(c, '|' ORDER BY n DESC, c) AS top FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, c) AS r FROM c) WHERE r <= 3 GROUP BY 1)
SELECT user_id, count(*) AS n_events, min(price) AS price_min, max(price) AS price_max, any_value(top) AS top_categories, string_agg(CASE WHEN rn <= 3 THEN parent_asin END, '|' ORDER BY rn) AS recent_items FROM e JOIN tc USING (user_id) GROUP BY user_id""")
def l01_user_profile(v):
    rows = profile.user_profile(v.v_interactions, items(v), 915148800000, list(ORDER), top=3, recent=3)
    return rows.select("user_id", "n_events", "price_min", "price_max", F.array_join("top_categories", "|").alias("top_categories"), F.array_join("recent_items", "|").alias("recent_items"))


@query(f"{duck('v_interactions', 'v_items')}" + """, p AS (SELECT user_id, item_id, cat2, avg(rating) AS r FROM v_interactions JOIN v_items ON parent_asin = item_id GROUP BY 1, 2, 3)
SELECT user_id, string_agg(item_id, '|' ORDER BY item_id) FILTER (WHERE r >= 4) AS love_items, string_agg(item_id, '|' ORDER BY item_id) FILTER (WHERE r <= 2) AS hate_items FROM p GROUP BY 1""")
def l01_love_and_hate(v):
    rows = profile.love_and_hate(v.v_interactions.select("user_id", F.col("parent_asin").alias("item_id"), "rating"), 4, 2)
    join = lambda c: F.when(F.size(c) > 0, F.array_join(F.array_sort(c), "|")).alias(c)
    return rows.select("user_id", join("love_items"), join("hate_items"))


FIRST_SEEN = "min((ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, pos))"


@query(f"""{duck('v_interactions', 'v_items')}, c AS (SELECT t.*, unnest([cat1, cat2]) AS category, unnest([0, 1]) AS pos FROM v_interactions t JOIN v_items ON parent_asin = item_id),
l AS (SELECT user_id, category, {FIRST_SEEN} AS since FROM c WHERE rating >= 5 GROUP BY 1, 2), h AS (SELECT user_id, category, {FIRST_SEEN} AS since FROM c WHERE rating <= 1 GROUP BY 1, 2)
SELECT user_id, love_categories, hate_categories FROM (SELECT DISTINCT user_id FROM v_interactions) LEFT JOIN (SELECT user_id, string_agg(category, '|' ORDER BY since) AS love_categories FROM l GROUP BY 1) USING (user_id)
LEFT JOIN (SELECT user_id, string_agg(category, '|' ORDER BY since) AS hate_categories FROM h GROUP BY 1) USING (user_id)""")
def l01_love_and_hate_categories(v):
    rows = v.v_interactions.withColumnRenamed("parent_asin", "item_id")
    out = profile.love_and_hate_categories(rows, items(v), 5, 1, ["ts", *ORDER])
    return out.select("user_id", *[F.array_join(c, "|").alias(c) for c in ("love_categories", "hate_categories")])


REQUESTS = f"""{duck('v_split', 'v_items')}, f AS (SELECT user_id, parent_asin, ts FROM v_split WHERE split = 'train'), t AS (SELECT DISTINCT user_id, parent_asin FROM v_split WHERE split = 'validation'),
h AS (SELECT user_id, count(DISTINCT parent_asin) AS n, arg_max(parent_asin, (ts, parent_asin)) AS last FROM f GROUP BY 1),
u AS (SELECT *, CASE WHEN coalesce(n, 0) = 0 THEN 'cold' WHEN n <= 4 THEN 'sparse' ELSE 'warm' END AS segment FROM (SELECT DISTINCT user_id FROM t) LEFT JOIN h USING (user_id)),
x AS (SELECT user_id, parent_asin, price, cat1, cat2, row_number() OVER (PARTITION BY user_id ORDER BY parent_asin) AS r FROM t JOIN v_items ON parent_asin = item_id),
p AS (SELECT user_id, cat2 AS pc, ceil(price * 1.2 / 50.0) * 50.0 AS lim FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY parent_asin) AS q FROM x WHERE price IS NOT NULL) WHERE q = 1),
o AS (SELECT user_id, parent_asin AS fi, cat2 AS fc FROM x WHERE r = 1),
k AS (SELECT user_id, segment, 'similar' AS kind, last AS seed_item_id, NULL::DOUBLE AS price_max, NULL AS category, NULL AS excluded_item, concat('more like ', last) AS text FROM u WHERE last IS NOT NULL AND segment <> 'cold'
UNION ALL SELECT user_id, segment, 'personalized', NULL, NULL, NULL, NULL, 'something that fits what I bought' FROM u WHERE segment <> 'cold'
UNION ALL SELECT user_id, segment, 'constrained', NULL, lim, pc, NULL, printf('%s under %.0f', pc, lim) FROM u JOIN p USING (user_id) WHERE segment <> 'cold'
UNION ALL SELECT user_id, segment, 'cold_text', NULL, NULL, fc, NULL, concat('I am new here and want ', fc) FROM u JOIN o USING (user_id) WHERE segment = 'cold'
UNION ALL SELECT user_id, segment, 'exclusion', NULL, NULL, fc, fi, concat('anything but ', fc, ', and not ', fi) FROM u JOIN o USING (user_id) WHERE segment <> 'cold'),
c AS (SELECT *, row_number() OVER (PARTITION BY kind, segment ORDER BY md5(concat_ws(':', '0', kind, user_id)), user_id) - 1 AS i FROM k),
w AS (SELECT c.*, (SELECT coalesce(string_agg(parent_asin, '|' ORDER BY parent_asin), '') FROM x WHERE x.user_id = c.user_id AND CASE c.kind WHEN 'constrained' THEN price <= price_max AND (cat1 = category OR cat2 = category)
      WHEN 'cold_text' THEN cat1 = category OR cat2 = category WHEN 'exclusion' THEN parent_asin <> excluded_item ELSE true END) AS targets FROM c WHERE i < 20)
SELECT concat_ws('-', kind, segment, i) AS request_id, kind, segment, user_id, seed_item_id, price_max, category, excluded_item, targets, text, kind IN ('constrained', 'cold_text') AS oracle FROM w
UNION ALL SELECT concat('ambiguous-none-', i), 'ambiguous', 'none', NULL, NULL, NULL, NULL, NULL, NULL, ['I need something nice', 'what would you take?', 'find me a gift'][CAST(i % 3 AS INT) + 1], false FROM range(0, 3) g(i)
UNION ALL SELECT concat('unanswerable-none-', i), 'unanswerable', 'none', NULL, NULL, NULL, NULL, NULL, NULL, 'a product that costs less than nothing', false FROM range(0, 3) g(i)"""


@query(REQUESTS)
def l02_build_requests(v):
    rows = v.split()
    return profile.build_requests(rows.where("split = 'train'"), rows.where("split = 'validation'"), items(v), 20)


@query(f"{SCORED} SELECT request_id, kind FROM v_scored WHERE kind IN ('K0', 'K1', 'K2')")
def l03_scope_filter(v):
    return v.v_scored.where(F.col("kind").isin("K0", "K1", "K2")).select("request_id", "kind")


TIERS = ["purchase", "click", "view"]


@query(f"{LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY CASE tool WHEN 'purchase' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, step_no DESC) AS rn FROM v_tool_log WHERE ok AND tool IN ('purchase', 'click', 'view')) SELECT request_id, tool, event_id FROM r WHERE rn = 1")
def l04_extract_recommendations(v):
    return trajectory.extract_recs(v.v_tool_log, TIERS, "event_id")


@query(f"{LOG} SELECT request_id, count(*) FILTER (WHERE tool = 'view') AS generated, count(DISTINCT CASE WHEN tool = 'view' THEN args END) AS unique_retrieved, max(CASE WHEN tool = 'purchase' THEN step_no END) AS ranked_at FROM v_tool_log GROUP BY 1")
def l06_funnel(v):
    return trajectory.funnel(v.v_tool_log, "view", "purchase", "args").withColumn("ranked_at", F.col("ranked_at").cast("long"))


INTERACT = "x AS (SELECT request_id, kind, steps AS recommended, errors AS without_price, CAST(steps - errors AS BIGINT) // 2 AS satisfying, latency > 0.5 AS error FROM v_scored)"


@query(f"""{SCORED}, {INTERACT} SELECT request_id, kind, CASE WHEN kind IN ('K1', 'K2') AND recommended - without_price > 0 THEN round(satisfying * 1.0 / (recommended - without_price), 6) END AS constraint_satisfaction,
CASE WHEN recommended > 0 THEN round(without_price * 1.0 / recommended, 6) END AS unknown_price_rate, CASE WHEN error THEN false WHEN kind IN ('K1', 'K2') THEN satisfying > 0 ELSE recommended > 0 END AS success FROM x""")
def l07_interaction_scores(v):
    rows = v.v_scored.selectExpr("request_id", "kind", "steps AS recommended", "errors AS without_price", "cast(floor((steps - errors) / 2) as long) AS satisfying", "latency > 0.5 AS error")
    return trajectory.score_interaction(rows, ["K1", "K2"])


@query(f"{SCORED}, a AS (SELECT request_id, CASE WHEN success THEN 'answered' WHEN errors = 1 THEN 'fallback' ELSE 'failed' END AS status FROM v_scored) SELECT request_id, status IN ('answered', 'fallback') AS answered, CASE WHEN status IN ('answered', 'fallback') THEN status = 'answered' END AS grounded, CASE WHEN status IN ('answered', 'fallback') THEN status = 'fallback' END AS fallback FROM a")
def l08_grounding_flags(v):
    return trajectory.score_grounding(v.v_scored.select("request_id", F.expr("CASE WHEN success THEN 'answered' WHEN errors = 1 THEN 'fallback' ELSE 'failed' END").alias("status")))


PROCESS = """, g AS (SELECT request_id, count(*) AS steps, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS steps_ok_rate, round(avg(CASE WHEN error_kind IN ('unknown_args', 'bad_reference') THEN 0.0 ELSE 1.0 END), 6) AS args_valid_rate, coalesce(string_agg(DISTINCT CASE WHEN NOT ok THEN tool END, ',' ORDER BY CASE WHEN NOT ok THEN tool END), '') AS failed_tools,
string_agg(tool, ' ' ORDER BY step_no) LIKE '%view%click%purchase%' AS plan_followed, NOT arg_min(ok, step_no) AS first_failed, NOT arg_min(ok, step_no) AND bool_or(ok) AS rescued FROM v_steps GROUP BY 1)"""


BEFORE_CALL = ["unknown_tool", "invented_id", "unknown_args", "bad_reference"]
STEPS, SCORED_STEPS = duck("v_steps"), duck("v_scored", "v_steps")


@query(f"{STEPS}{PROCESS} SELECT * FROM g")
def l09_process_scores(v):
    return trajectory.score_process(v.v_steps, ["view", "click", "purchase"], BEFORE_CALL)


@query(f"""{STEPS}, a AS (SELECT request_id, bool_or(CASE WHEN kind IN ('K1', 'K2') AND ok AND tool IN ('view', 'click') AND has_filter THEN asked_price <= 50 END) AS price_arg_ok,
bool_or(CASE WHEN kind IN ('K1', 'K2') AND ok AND tool IN ('view', 'click') AND asked_category = 'cat1' THEN true END) AS category_arg_ok, bool_or(ok AND tool = 'purchase') AS used_ranker FROM v_steps GROUP BY 1) SELECT * FROM a""")
def l09_argument_scores(v):
    filters = F.when(F.col("has_filter"), F.struct(F.col("asked_price").alias("price_max"), F.array("asked_category").alias("categories_any")))
    query_text = F.when(~F.col("has_filter"), F.concat(F.lit("Some "), F.upper("asked_category"), F.lit(" please")))
    steps = v.v_steps.withColumn("args", F.to_json(F.struct(filters.alias("filters"), query_text.alias("query"))))
    requests = v.v_steps.select("request_id", "kind").distinct().select("request_id", "kind", F.lit(50.0).alias("price_max"), F.lit("cat1").alias("category"))
    return trajectory.score_arguments(steps, requests, ["view", "click"], "purchase", ["K1", "K2"])


COST = "(prompt_tokens + 3 * completion_tokens) / 1000000"


@query(f"""{STEPS} SELECT request_id, count(*) AS calls, round(sum(latency_seconds), 6) AS latency, round(max(latency_seconds), 6) AS slowest, arg_max(tool, (latency_seconds, step_no)) AS slowest_tool, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens,
CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum({COST}), 6) AS cost, count(*) FILTER (WHERE error_kind = 'time_budget') AS time_budget_hits FROM v_steps GROUP BY 1""")
def l10_deployment_scores(v):
    return trajectory.score_deployment(v.v_steps.withColumn("cost", F.expr(COST)))


@query(f"""{STEPS} SELECT tool, count(*) AS calls, CAST(sum(prompt_tokens + completion_tokens) AS BIGINT) AS tokens, round(sum({COST}), 6) AS cost, round(quantile_cont(latency_seconds, 0.5), 9) AS p50, round(quantile_cont(latency_seconds, 0.95), 9) AS p95,
round(quantile_cont(latency_seconds, 0.99), 9) AS p99 FROM v_steps GROUP BY 1""")
def l10_deployment_by_tool(v):
    return trajectory.deployment_by_tool(v.v_steps.withColumn("cost", F.expr(COST)))


@query(f"{SCORED_STEPS}{PROCESS} SELECT request_id, agent, kind, segment, latency, steps_ok_rate, plan_followed FROM v_scored JOIN g USING (request_id)")
def l11_scored_rows(v):
    parts = [v.v_scored.select("request_id", "agent", "kind", "segment", "latency"), trajectory.score_process(v.v_steps, ["view", "click", "purchase"]).select("request_id", "steps_ok_rate", "plan_followed")]
    return trajectory.join_scores(parts)


@query(f"{SCORED} SELECT agent, kind, segment, count(*) AS n, round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS mean_success, round(avg(spend), 6) AS mean_spend, round(quantile_cont(latency, 0.5), 6) AS p50_latency, round(quantile_cont(latency, 0.95), 6) AS p95_latency FROM (SELECT * FROM v_scored UNION ALL SELECT * REPLACE ('all' AS segment) FROM v_scored) GROUP BY 1, 2, 3")
def l12_summary(v):
    return trajectory.summarize(v.v_scored, ["success", "spend"], ["latency"])


@query(f"""{SCORED_STEPS}, e AS (SELECT 'step' AS level, agent, kind, error_kind, request_id FROM v_steps WHERE NOT ok UNION ALL SELECT 'plan', agent, kind, CASE WHEN errors = steps THEN 'invalid_plan' ELSE 'truncated' END, request_id FROM v_scored WHERE errors = steps OR steps > 20)
SELECT level, agent, kind, error_kind, count(*) AS errors, count(DISTINCT request_id) AS requests FROM e GROUP BY 1, 2, 3, 4""")
def l13_error_taxonomy(v):
    plans = v.v_scored.withColumn("error_kind", F.expr("CASE WHEN errors = steps THEN 'invalid_plan' WHEN steps > 20 THEN 'truncated' END"))
    return trajectory.error_taxonomy(v.v_steps, F.col("error_kind"), plans)


@query(f"{SCORED} SELECT agent, count(*) AS n, round(avg(CASE WHEN NOT success THEN 1.0 ELSE 0.0 END), 6) AS any_error, round(avg(CASE WHEN errors = steps THEN 1.0 ELSE 0.0 END), 6) AS all_errors FROM v_scored GROUP BY 1")
def l14_failure_rates(v):
    return trajectory.failure_rates(v.v_scored, {"any_error": ~F.col("success"), "all_errors": F.col("errors") == F.col("steps")})


@query(f"{SCORED_STEPS}{PROCESS} SELECT agent, count(*) AS n, count(*) FILTER (WHERE first_failed) AS first_failed, round(avg(CASE WHEN first_failed THEN CASE WHEN rescued THEN 1.0 ELSE 0.0 END END), 6) AS rescue_rate, round(avg(CASE WHEN NOT first_failed THEN CASE WHEN success THEN 0.0 ELSE 1.0 END END), 6) AS blind_spot_rate FROM v_scored JOIN g USING (request_id) GROUP BY 1")
def l15_reflection(v):
    rows = v.v_scored.join(trajectory.score_process(v.v_steps, ["view"]).select("request_id", "first_failed", "rescued"), "request_id")
    return trajectory.reflection_stats(rows)


@query(f"{LOG}, s AS (SELECT request_id, step_no, tool, CASE WHEN step_no > 1 THEN step_no - 1 - step_no % 2 END AS ref FROM v_tool_log) SELECT m.request_id, m.step_no AS made_at, min(u.step_no) AS consumed_at FROM s m LEFT JOIN s u ON u.request_id = m.request_id AND u.ref = m.step_no AND u.step_no > m.step_no WHERE m.tool = 'view' GROUP BY 1, 2")
def l16_consumed_by(v):
    steps = v.v_tool_log.withColumn("step_no", F.col("step_no").cast("long")).withColumn("args", F.concat(F.lit('{"from": "$'), (F.col("step_no") - 1 - F.col("step_no") % 2).cast("string"), F.lit('"}')))
    steps = steps.withColumn("args", F.when(F.col("step_no") > 1, F.col("args")).otherwise("{}"))
    return trajectory.consumed_by(steps, "view")


@query(f"{LOG} SELECT agent, tool, count(*) AS calls, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS ok_rate, round(avg(latency_seconds), 6) AS mean, round(quantile_cont(latency_seconds, 0.5), 9) AS p50, round(quantile_cont(latency_seconds, 0.95), 9) AS p95, round(quantile_cont(latency_seconds, 0.99), 9) AS p99 FROM v_tool_log GROUP BY 1, 2")
def l17_tool_log_stats(v):
    return trajectory.tool_percentiles(v.v_tool_log, ["agent", "tool"])


TURNS = r"""WITH t AS (SELECT conv_id AS conversation_id, turn AS position, list_distinct(regexp_extract_all(text, '\b[A-Z][a-z]+')) AS items FROM conversations),
p AS (SELECT *, lag(items) OVER (PARTITION BY conversation_id ORDER BY position) AS before FROM t)"""


def turns(v):
    words = F.array_distinct(F.regexp_extract_all("text", F.lit(r"(\b[A-Z][a-z]+)"), F.lit(1)))
    return v.conversations.select(F.col("conv_id").alias("conversation_id"), F.col("turn").alias("position"), words.alias("items"))


@query(TURNS + " SELECT conversation_id, position, len(items) AS shown, CASE WHEN len(before) > 0 THEN round(len(list_intersect(items, before)) * 1.0 / len(before), 6) END AS item_match, NOT list_contains(items, 'The') AS exclusions_kept FROM p")
def m01_turn_scores(v):
    from pyspark.sql import Window

    rows = turns(v).withColumn("expected", F.coalesce(F.lag("items").over(Window.partitionBy("conversation_id").orderBy("position")), F.array().cast("array<string>")))
    return dialogue.score_turns(rows.withColumn("excluded", F.array(F.lit("x::The"))))


CONV = ", q AS (SELECT conversation_id, items, CASE WHEN before IS NOT NULL THEN len(list_filter(before, lambda x: NOT list_contains(items, x))) = 0 END AS kept FROM p), c AS (SELECT conversation_id, count(*) AS turns, bool_and(kept) AS retention, len(list_distinct(flatten(list(items)))) AS distinct_items FROM q GROUP BY 1)"


@query(TURNS + CONV + " SELECT * FROM c")
def m02_conversation_scores(v):
    return dialogue.score_conversations(turns(v))


@query(TURNS + """, a AS (SELECT conversation_id, position, string_agg(CAST(position AS VARCHAR), ',') OVER (PARTITION BY conversation_id ORDER BY position ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent_turns, len(list_distinct(flatten(list(items) OVER (PARTITION BY conversation_id ORDER BY position ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)))) AS n FROM t)
SELECT conversation_id, position, recent_turns, least(50, n) AS ring_size FROM a""")
def m03_session_state(v):
    return dialogue.session_state(turns(v))


@query(TURNS + CONV + " SELECT count(*) AS conversations, round(avg(turns), 6) AS mean_turns, round(stddev_pop(turns), 6) AS std_turns, round(avg(CASE WHEN retention THEN 1.0 WHEN NOT retention THEN 0.0 END), 6) AS retention_rate, round(avg(distinct_items), 6) AS mean_items FROM c")
def m04_conversation_summary(v):
    return dialogue.summarize_conversations(dialogue.score_conversations(turns(v)))


#: An answer for every item, sentence by sentence: every fifth names another id, every seventh a wrong price, every ninth
#: a wrong rating; some have codes without domain, a number of the request, the title, a store, or a courtesy.
NAMED = "CASE WHEN seq % 5 = 0 THEN 'NONE::X1' ELSE item_id END"
SENTENCES = [
    f"CASE WHEN price IS NULL THEN concat({NAMED}, ' has no price here.') ELSE concat({NAMED}, ' costs $', printf('%.2f', CASE WHEN seq % 7 = 0 THEN price + 10 ELSE price END), '.') END",
    f"concat({NAMED}, ' is rated ', printf('%.1f', CASE WHEN seq % 9 = 0 THEN average_rating - 0.5 ELSE average_rating END), '/5.')",
    "CASE WHEN seq % 11 = 0 THEN concat('Code B0', printf('%08d', seq), ' fits as well.') END",
    "CASE WHEN seq % 13 = 0 THEN 'It keeps to your budget of $40.' END",
    "CASE WHEN seq % 4 = 0 THEN concat('Some say ', title, ' lasts.') END",
    "CASE WHEN seq % 3 = 0 THEN concat(item_id, ' is sold by ', coalesce(store, 'nobody'), '.') END",
    "CASE WHEN seq % 2 = 0 THEN 'Thank you for asking about the price.' END",
]
REQUEST = "'something for 40 or less'"
ANSWERS = duck("v_items") + f", s AS (SELECT *, list_filter([{', '.join(SENTENCES)}], lambda x: x IS NOT NULL) AS sentences FROM v_items), a AS (SELECT *, seq AS answer_id, array_to_string(sentences, ' ') AS text FROM s)"


def answers(v):
    text = F.concat_ws(" ", *[F.expr(x) for x in SENTENCES])
    return v.v_items.select(F.col("seq").alias("answer_id"), text.alias("text"), F.array("item_id").alias("item_ids"), F.expr(REQUEST).alias("request_text"))


IDS, PRICES, RATINGS = r"'([A-Za-z_]+::[A-Za-z0-9]+)'", r"'\$(\d+(?:\.\d+)?)'", r"'(\d(?:\.\d+)?)\s*(?:/\s*5|stars?)'"


@query(f"""{ANSWERS} SELECT answer_id, 'item' AS kind, unnest(regexp_extract_all(text, {IDS}, 1)) AS value FROM a UNION ALL SELECT answer_id, 'price', unnest(regexp_extract_all(text, {PRICES}, 1)) FROM a
UNION ALL SELECT answer_id, 'rating', unnest(regexp_extract_all(text, {RATINGS}, 1)) FROM a""")
def n01_mentions(v):
    return grounding.mentions(answers(v))


WITHOUT = "len(list_filter(list_transform(regexp_extract_all(text, {0}, 1), lambda x: CAST(x AS DOUBLE)), lambda x: len(list_filter({1}, lambda y: abs(x - y) <= {2})) = 0))"
TITLE_NUMBERS = r"list_transform(regexp_extract_all(title, '\d+(?:[.,]\d+)*'), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"


@query(f"""{ANSWERS}, g AS (SELECT answer_id, CASE WHEN list_contains(regexp_extract_all(text, {IDS}, 1), 'NONE::X1') THEN 1 ELSE 0 END AS foreign_ids, list_distinct(regexp_extract_all(text, {IDS}, 1)) = [item_id] AS ids_in_order,
len(regexp_extract_all(text, 'B0[0-9A-Z]{{8}}')) AS bare_codes, {WITHOUT.format(PRICES, f"list_concat([40.0, coalesce(price, -1e9)], {TITLE_NUMBERS})", 0.01 + 1e-9)} AS wrong_prices, {WITHOUT.format(RATINGS, "[average_rating]", 0.05 + 1e-9)} AS wrong_ratings FROM a)
SELECT *, foreign_ids = 0 AND bare_codes = 0 AND wrong_prices = 0 AND wrong_ratings = 0 AS grounded FROM g""")
def n02_check_grounding(v):
    return grounding.check_grounding(answers(v), v.v_items)


CLAIMS = ANSWERS + r""", q AS (SELECT answer_id, unnest(range(len(sentences))) AS no, unnest(sentences) AS sentence, item_id AS given FROM a),
w AS (SELECT q.*, lower(sentence) AS low, nullif(regexp_extract(sentence, '([A-Za-z_]+::[A-Za-z0-9]+)', 1), '') AS named, t.title AS given_title FROM q JOIN v_items t ON t.item_id = given WHERE NOT starts_with(lower(sentence), 'thank you')),
n AS (SELECT answer_id, no, low, coalesce(named, CASE WHEN len(list_intersect(string_split(low, ' '), string_split(lower(given_title), ' '))) >= 2 THEN given END) AS item_id FROM w),
k AS (SELECT n.*, i.item_id IS NOT NULL AS known, price, average_rating, store, title FROM n LEFT JOIN v_items i ON i.item_id = n.item_id WHERE n.item_id IS NOT NULL OR regexp_matches(low, 'price|rating|review|star|category|store|cheap|expensive|wire|cable|feature|best|popular|suitable|good|great|dollar|cents|\$|rated')),
c AS (SELECT answer_id, no, item_id, CASE WHEN regexp_matches(low, 'price|cost|\$|dollar|cheap|expensive') THEN 'price' WHEN regexp_matches(low, 'rating|star|rated|/5|out of 5') THEN 'rating' WHEN contains(low, 'review') THEN 'reviews'
 WHEN regexp_matches(low, 'store|sold by|available at') THEN 'store' WHEN regexp_matches(low, 'category|type|belongs to') THEN 'category' WHEN len(list_intersect(string_split(low, ' '), string_split(lower(title), ' '))) >= 2 THEN 'title' ELSE 'other' END AS claim,
 TRY_CAST(nullif(regexp_extract(regexp_replace(low, '[a-z_]+::[a-z0-9]+', ' ', 'g'), '\$?(\d+\.?\d*)', 1), '') AS DOUBLE) AS p, TRY_CAST(nullif(regexp_extract(regexp_replace(low, '[a-z_]+::[a-z0-9]+', ' ', 'g'), '(\d\.?\d*)\s*(?:star|rating|/|out of)', 1), '') AS DOUBLE) AS r, known, price, average_rating, store, low FROM k),
cl AS (SELECT answer_id, no, item_id, claim, CASE WHEN NOT known THEN 'unknown_item' WHEN claim = 'price' THEN CASE WHEN price IS NULL THEN 'unsupported' WHEN coalesce(abs(p - price) <= 0.010000001, true) THEN 'supported' ELSE 'contradicted' END
 WHEN claim = 'rating' THEN CASE WHEN coalesce(abs(r - average_rating) <= 0.100000001, true) THEN 'supported' ELSE 'contradicted' END WHEN claim = 'store' THEN CASE WHEN store IS NULL THEN 'unsupported' WHEN contains(low, lower(store)) THEN 'supported' ELSE 'contradicted' END
 WHEN claim = 'title' THEN 'supported' ELSE 'unsupported' END AS verdict FROM c)"""


@query(CLAIMS + " SELECT * FROM cl")
def n03_claims(v):
    return grounding.claims(answers(v), v.v_items)


@query(CLAIMS + " SELECT answer_id AS case_id, count(*) AS claims, round(count(*) FILTER (WHERE verdict = 'supported') * 1.0 / count(*), 6) AS grounding_rate, round(1 - count(*) FILTER (WHERE verdict = 'supported') * 1.0 / count(*), 6) AS hallucination_rate FROM cl GROUP BY 1")
def n04_grounding_rates(v):
    return grounding.grounding_rates(grounding.claims(answers(v), v.v_items).withColumnRenamed("answer_id", "case_id"))


@query(f"{SCORED} SELECT request_id, CASE WHEN errors = steps THEN 'failed' WHEN errors > 0 AND spend IS NULL THEN 'partial' WHEN spend IS NOT NULL THEN 'bought' ELSE 'answered' END AS outcome FROM v_scored")
def n05_classify_outcome(v):
    rules = [(F.col("errors") == F.col("steps"), "failed"), ((F.col("errors") > 0) & F.col("spend").isNull(), "partial"), (F.col("spend").isNotNull(), "bought")]
    return v.v_scored.select("request_id", trajectory.classify_outcome(rules, "answered").alias("outcome"))


def two_agents(v):
    """Rows of both agents by user: odd and even days of the same kind of request meet."""
    return v.v_scored.withColumn("day", F.element_at(F.split("request_id", "-"), -1).cast("long")).withColumn("side", F.col("day") % 2 == 0)


def boot_sql(values: str, replicates: int = 200, alpha: float = 0.05) -> str:
    """values: a SELECT of k and x; the CTEs of the replicates' means (m) and of the interval (bi)."""
    cases = " ".join(f"WHEN d >= {step} THEN {n + 1}" for n, step in reversed(list(enumerate(stats.poisson_steps()))))
    return f"""bv AS ({values}), bw AS (SELECT rep, x, CASE {cases} ELSE 0 END AS w FROM (SELECT rep, x, {draw_sql('k', 'rep', '0')} AS d FROM bv CROSS JOIN range(1, {replicates + 1}) r(rep))),
bm AS (SELECT rep, sum(w * x) / sum(w) AS m FROM bw GROUP BY 1),
bi AS (SELECT (SELECT count(*) FROM bv) AS n, round((SELECT avg(x) FROM bv), 6) AS mean, round(quantile_cont(m, {alpha / 2!r}), 6) AS low, round(quantile_cont(m, {1 - alpha / 2!r}), 6) AS high FROM bm)"""


@query(f"{SCORED}, {boot_sql('SELECT request_id AS k, latency AS x FROM v_scored WHERE latency IS NOT NULL')} SELECT * FROM bi")
def p01_bootstrap_ci(v):
    return stats.bootstrap_ci(v.v_scored, "latency", "request_id")


DAYS = f"{SCORED}, d AS (SELECT *, CAST(string_split(request_id, '-')[-1] AS BIGINT) % 2 = 0 AS side FROM v_scored), pp AS (SELECT user_id, avg(latency) FILTER (WHERE side) AS a, avg(latency) FILTER (WHERE NOT side) AS b, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FILTER (WHERE side) >= 0.6 AS sa, avg(CASE WHEN success THEN 1.0 ELSE 0.0 END) FILTER (WHERE NOT side) >= 0.6 AS sb FROM d GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL)"


def paired(v):
    rows = two_agents(v).withColumn("won", F.col("success").cast("double"))
    pick = lambda f, c, side: f(F.when(F.col("side") == side, F.col(c)))
    out = rows.groupBy("user_id").agg(pick(F.avg, "latency", True).alias("a"), pick(F.avg, "latency", False).alias("b"), (pick(F.avg, "won", True) >= 0.6).alias("sa"), (pick(F.avg, "won", False) >= 0.6).alias("sb"))
    return out.where("a IS NOT NULL AND b IS NOT NULL")


PAIRED = """SELECT bi.*, (SELECT round(avg(CASE WHEN m <= 0 THEN 1.0 ELSE 0.0 END), 6) FROM bm) AS p_value,
(SELECT count(*) FROM bv WHERE x > 0) AS improved, (SELECT count(*) FROM bv WHERE x < 0) AS worse, (SELECT count(*) FROM bv WHERE x = 0) AS unchanged FROM bi"""


@query(f"{DAYS}, {boot_sql('SELECT user_id AS k, b - a AS x FROM pp')} {PAIRED}")
def p02_paired_bootstrap(v):
    return stats.paired_bootstrap(paired(v), "a", "b", "user_id")


@query(f"{DAYS}, {boot_sql('SELECT user_id AS k, b - a AS x FROM pp', alpha=0.05 / 5)} {PAIRED}")
def p03_family_wise_interval(v):
    return stats.paired_bootstrap(paired(v), "a", "b", "user_id", planned=5)


@query(f"{SCORED}, s AS (SELECT success AS a, latency > 0.05 AS b FROM v_scored), c AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE NOT a AND b) AS c FROM s), x AS (SELECT b, c, CASE WHEN b + c >= 10 THEN round(power(greatest(abs(b - c) - 1, 0), 2) / (b + c), 6) END AS chi2 FROM c) SELECT b, c, chi2, CASE WHEN chi2 >= 10.828 THEN 0.001 WHEN chi2 >= 6.635 THEN 0.01 WHEN chi2 >= 3.841 THEN 0.05 WHEN chi2 IS NOT NULL THEN 1.0 END::DOUBLE AS p FROM x")
def p04_mcnemar(v):
    return stats.mcnemar(v.v_scored.select(F.col("success").alias("a"), (F.col("latency") > 0.05).alias("b")), "a", "b")


@query(f"{SCORED}, x AS (SELECT round(CAST(errors AS DOUBLE) - steps / 4.0, 9) AS d FROM v_scored), y AS (SELECT d, abs(d) AS s FROM x WHERE d <> 0), r AS (SELECT s, count(*) AS t, count(*) FILTER (WHERE d > 0) AS up, sum(count(*)) OVER (ORDER BY s) - (count(*) - 1) / 2.0 AS rank FROM y GROUP BY s) SELECT CAST(sum(t) AS BIGINT) AS n, CAST(sum(up * rank) AS DOUBLE) AS w_plus, round((sum(up * rank) - sum(t) * (sum(t) + 1) / 4.0) / sqrt(sum(t) * (sum(t) + 1) * (2 * sum(t) + 1) / 24.0 - sum(t * t * t - t) / 48.0), 6) AS z FROM r")
def p05_wilcoxon(v):
    return stats.wilcoxon(v.v_scored.select((F.col("steps") / 4.0).alias("a"), F.col("errors").alias("b")), "a", "b")


@query(f"{SCORED}, r AS (SELECT steps, count(*) AS t, count(*) FILTER (WHERE success) AS g, sum(count(*)) OVER (ORDER BY steps) - (count(*) - 1) / 2.0 AS rank FROM v_scored GROUP BY 1), s AS (SELECT CAST(sum(t) AS DOUBLE) AS n, CAST(sum(g) AS DOUBLE) AS n1, CAST(sum(g * rank) AS DOUBLE) AS r, CAST(sum(t * t * t - t) AS DOUBLE) AS ties FROM r) SELECT CAST(n1 AS BIGINT) AS n1, CAST(n - n1 AS BIGINT) AS n2, r - n1 * (n1 + 1) / 2 AS u, round((r - n1 * (n1 + 1) / 2 - n1 * (n - n1) / 2) / sqrt(n1 * (n - n1) / 12 * ((n + 1) - ties / (n * (n - 1)))), 6) AS z FROM s")
def p05_mann_whitney(v):
    return stats.mann_whitney(v.v_scored.select("steps", "success"), "steps", "success")


LONG = "l AS (SELECT agent, 'latency' AS metric, latency AS value FROM v_scored UNION ALL SELECT agent, 'spend', spend FROM v_scored UNION ALL SELECT agent, 'errors', CAST(errors AS DOUBLE) FROM v_scored)"
AGG = "count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99"


@query(f"{SCORED}, {LONG} SELECT agent, metric, {AGG} FROM l WHERE value IS NOT NULL GROUP BY 1, 2")
def p06_aggregate_metrics(v):
    return stats.aggregate_metrics(v.v_scored, ["latency", "spend", "errors"], ["agent"])


MICRO_MEAN = "floor((2 * sum(m) FILTER (WHERE {0}) + count(*) FILTER (WHERE {0})) / (2 * count(*) FILTER (WHERE {0}))) / 1e6"


@query(
    f"{DAYS}, m AS (SELECT user_id, side, CAST(round(latency * 1e6) AS BIGINT) AS m FROM d) "
    f"SELECT user_id, {MICRO_MEAN.format('side')} AS a, {MICRO_MEAN.format('NOT side')} AS b FROM m JOIN pp USING (user_id) GROUP BY user_id"
)
def p07_pair_runs(v):
    rows = two_agents(v)
    return stats.pair_runs(rows.where("side"), rows.where("NOT side"), "user_id", "latency")


CONTRAST = f"{DAYS}, k AS (SELECT concat('K', CAST(user_id % 5 AS VARCHAR)) AS kind, CAST(round(a * 1000) AS BIGINT) / 1000.0::DOUBLE AS a, CAST(round(b * 1000) AS BIGINT) / 1000.0::DOUBLE AS b FROM pp), g AS (SELECT kind, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(b - a), 6) AS diff, count(*) FILTER (WHERE b > a) AS wins, count(*) FILTER (WHERE b < a) AS losses, count(*) FILTER (WHERE a = b) AS ties FROM (SELECT * FROM k UNION ALL SELECT 'all', a, b FROM k) GROUP BY 1)"


def contrasted(v):
    milli = lambda c: (F.round(F.col(c) * 1000).cast("long") / 1000.0).alias(c)
    return stats.contrast(paired(v).select(F.concat(F.lit("K"), (F.col("user_id") % 5).cast("string")).alias("kind"), milli("a"), milli("b")), ["kind"])


POISSON = " ".join(f"WHEN d >= {step} THEN {n + 1}" for n, step in reversed(list(enumerate(stats.poisson_steps()))))


@query(f"""{CONTRAST}, kk AS (SELECT user_id, concat('K', CAST(user_id % 5 AS VARCHAR)) AS kind, CAST(round(a * 1000) AS BIGINT) / 1000.0::DOUBLE AS a, CAST(round(b * 1000) AS BIGINT) / 1000.0::DOUBLE AS b, sa, sb FROM pp),
lv AS (SELECT * FROM kk UNION ALL SELECT user_id, 'all', a, b, sa, sb FROM kk),
bw AS (SELECT kind, rep, x, CASE {POISSON} ELSE 0 END AS w FROM (SELECT kind, rep, b - a AS x, {draw_sql('user_id', 'rep', '0')} AS d FROM lv CROSS JOIN range(1, 201) r(rep))),
bm AS (SELECT kind, rep, sum(w * x) / sum(w) AS m FROM bw GROUP BY 1, 2), ci AS (SELECT kind, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM bm GROUP BY 1),
fl AS (SELECT kind, count(*) FILTER (WHERE sa AND NOT sb) AS only_a, count(*) FILTER (WHERE NOT sa AND sb) AS only_b FROM lv GROUP BY 1)
SELECT kind, n, mean_a, mean_b, diff, wins, losses, ties, low, high, only_a, only_b, CASE WHEN only_a + only_b >= 10 THEN round(power(greatest(abs(only_a - only_b) - 1, 0), 2) / (only_a + only_b), 6) END AS chi2
FROM g JOIN ci USING (kind) JOIN fl USING (kind)""")
def p08_contrast_report(v):
    milli = lambda c: (F.round(F.col(c) * 1000).cast("long") / 1000.0).alias(c)
    rows = paired(v).select("user_id", F.concat(F.lit("K"), (F.col("user_id") % 5).cast("string")).alias("kind"), milli("a"), milli("b"), "sa", "sb")
    return stats.contrast_report(rows, ["kind"], "user_id")


@query(f"{DAYS} SELECT user_id, sa, sb FROM pp WHERE sa <> sb")
def p09_disagreements(v):
    return paired(v).where("sa <> sb").select("user_id", "sa", "sb")


@query(f"{CONTRAST} SELECT kind, n, diff, CASE WHEN n < 2 THEN 'inconclusive' WHEN -diff > 0 THEN 'better' WHEN -diff < 0 THEN 'worse' ELSE 'same' END AS verdict FROM g")
def p10_metric_analysis(v):
    return stats.verdict(contrasted(v), cost=True).select("kind", "n", "diff", "verdict")


@query("SELECT tag, count(*) AS cases, round(avg(quality), 6) AS success_rate, round(avg(n_chars), 6) AS mean, round(stddev_pop(n_chars), 6) AS std, CAST(min(n_chars) AS DOUBLE) AS min, CAST(max(n_chars) AS DOUBLE) AS max, round(quantile_cont(n_chars, 0.5), 6) AS p50, round(quantile_cont(n_chars, 0.95), 6) AS p95, round(quantile_cont(n_chars, 0.99), 6) AS p99 FROM (SELECT quality, n_chars, unnest(['all', lang, source]) AS tag FROM labels JOIN documents USING (doc_id)) GROUP BY 1")
def p11_benchmark_summary(v):
    rows = v.labels.join(v.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").withColumn("tag", F.explode(F.array(F.lit("all"), "lang", "source")))
    rate = rows.groupBy("tag").agg(F.round(F.avg("quality"), 6).alias("success_rate"))
    return stats.aggregate_metrics(rows, ["n_chars"], ["tag"]).join(rate, "tag").drop("metric").withColumnRenamed("n", "cases")


GATES = "b AS (SELECT * FROM (VALUES ('latency', 0.0, 0.1), ('spend', 0.0, 0.01), ('errors', NULL, 100.0), ('tokens', 0.0, 1.0)) x(metric, low, high))"


def gated(v):
    means = stats.aggregate_metrics(v.v_scored, ["latency", "spend", "errors"]).select("metric", F.col("mean").alias("value"))
    bounds = v.spark.createDataFrame([("latency", 0.0, 0.1), ("spend", 0.0, 0.01), ("errors", None, 100.0), ("tokens", 0.0, 1.0)], "metric string, low double, high double")
    return stats.gate(means, bounds)


@query(f"{SCORED}, {LONG}, {GATES}, m AS (SELECT metric, round(avg(value), 6) AS value FROM l GROUP BY 1) SELECT metric, value, CASE WHEN value IS NULL THEN 'missing' WHEN (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) THEN 'pass' ELSE 'fail' END AS status FROM b LEFT JOIN m USING (metric)")
def p12_gates(v):
    return gated(v)


@query(f"{DAYS}, {LONG.replace('FROM v_scored', 'FROM v_scored').replace('l AS (', 'l AS (')}, s AS (SELECT side, 'latency' AS metric, latency AS value FROM d UNION ALL SELECT side, 'errors', CAST(errors AS DOUBLE) FROM d), m AS (SELECT metric, round(avg(value) FILTER (WHERE side), 6) AS base, round(avg(value) FILTER (WHERE NOT side), 6) AS cur FROM s GROUP BY 1) SELECT metric, round(cur - base, 6) AS delta, round((cur - base) / abs(base) * 100, 6) AS pct, CASE WHEN abs((cur - base) / abs(base)) <= 0.001 THEN 'neutral' WHEN cur < base THEN 'improved' ELSE 'regressed' END AS status FROM m")
def p13_regression(v):
    rows = two_agents(v)
    of = lambda df: stats.aggregate_metrics(df, ["latency", "errors"]).select("metric", F.col("mean").alias("value"))
    return stats.regression(of(rows.where("side")), of(rows.where("NOT side")), ["latency", "errors"], 0.001)


@query(f"{SCORED} SELECT request_id, steps % 3 <> 0 AS errors_ok, true AS tools_ok, steps % 3 <> 0 AS all_ok FROM v_scored")
def p14_profile_correctness(v):
    want = v.v_scored.select("request_id", "errors", F.array("agent", "kind").alias("tools"))
    got = v.v_scored.select("request_id", F.expr("CASE WHEN steps % 3 = 0 THEN errors + 1 ELSE errors END").alias("errors"), F.array("kind", "agent", "kind").alias("tools"))
    return stats.profile_correctness(got, want, "request_id", ["errors"], ["tools"])


@query(f"{SCORED} SELECT request_id FROM v_scored WHERE (agent = 'A0' OR kind = 'K3') AND segment = 'warm'")
def p15_filter_cases(v):
    cases = v.v_scored.select("request_id", F.array("agent", "kind").alias("tags"), F.create_map(F.lit("segment"), "segment").alias("metadata"))
    return stats.filter_cases(cases, ["A0", "K3"], {"segment": "warm"}).select("request_id")


def print_sql(columns: list[str]) -> str:
    """rows, hash_sum and hash_xor of a table with these columns."""
    parts = ", ".join(f"coalesce(concat_ws(':', length(CAST({c} AS VARCHAR)), CAST({c} AS VARCHAR)), '')" for c in sorted(columns))
    return f"count(*) AS rows, CAST(coalesce(sum(h), 0) AS VARCHAR) AS hash_sum, coalesce(bit_xor(h), 0) AS hash_xor FROM (SELECT CAST('0x' || substr(md5(concat_ws('|', {parts})), 1, 15) AS BIGINT) AS h FROM {{0}})"


@query(duck("v_interactions") + " SELECT " + print_sql(["user_id", "parent_asin", "ts"]).format("v_interactions"))
def q07_fingerprint(v):
    return provenance.fingerprint(v.v_interactions.select("user_id", "parent_asin", "ts"))


@query(duck("v_interactions") + ", a AS (SELECT count(*) AS n FROM v_interactions), b AS (SELECT count(*) AS n FROM v_interactions WHERE ts > 0), c AS (SELECT count(*) AS n FROM v_interactions WHERE ts > 900000000000) SELECT 0 AS position, 'clean' AS stage, a.n AS input_rows, b.n AS output_rows, true AS linked FROM a, b UNION ALL SELECT 1, 'filter', b.n, c.n, true FROM b, c")
def q08_manifest(v):
    rows = v.v_interactions.select("user_id", "parent_asin", "ts")
    first = provenance.manifest("clean", rows, rows.where("ts > 0"))
    second = provenance.manifest("filter", rows.where("ts > 0"), rows.where("ts > 900000000000"))
    return provenance.verify_chain([first, second])
