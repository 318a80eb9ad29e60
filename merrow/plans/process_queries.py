"""Queries of process diagnostics: runs, steps and requests made of the tool log."""

from __future__ import annotations

from pyspark.sql import functions as F

from merrow.operators import process

from .registry import query
from .views import duck

TOOLS = process.Tools(memory="view", search="click", filter="filter", similar="purchase", rank="signup", lookup="lookup")
PLANS = {
    "K1": [["click", "filter"], ["signup"]],
    "K2": [["view"], ["click"]],
    "K3": [["purchase"], ["signup"]],
    "K4": [["click"], ["purchase", "view"]],
}
ALL, FEW = ("view", "click", "purchase", "signup"), ("view", "click")

#: Runs of kind K0 (ambiguous) with an even last digit have no steps and ask the user instead.
QUIET = "kind = 'K0' AND CAST(right(request_id, 1) AS INT) % 2 = 0"
STEP = {
    "tool": "CASE WHEN tool <> 'error' THEN tool WHEN prompt_tokens % 3 = 0 THEN 'view' WHEN prompt_tokens % 3 = 1 THEN 'click' ELSE 'purchase' END",
    "error_kind": "CASE WHEN NOT ok THEN CASE WHEN prompt_tokens % 7 = 0 THEN 'invented_id' ELSE error_kind END END",
    "invented_ids": "CASE WHEN prompt_tokens % 7 = 0 THEN 1 + prompt_tokens % 2 ELSE 0 END",
    "word": "CASE prompt_tokens % 4 WHEN 0 THEN 'Red CAT1 shoes' WHEN 1 THEN 'ab' WHEN 2 THEN ' ' ELSE '' END",
    "refers": "CASE WHEN prompt_tokens % 3 = 0 AND step_no > 1 THEN CAST(step_no - 1 - prompt_tokens % 2 AS INT) END",
}
ARGS = """concat('{"items": ["I', CAST(prompt_tokens % 5 AS STRING), '"], "filters": {"categories_any": ["cat', CAST(completion_tokens % 3 AS STRING),
  '"], "price_max": ', CAST(10 * (prompt_tokens % 4) AS STRING), '}, "query": "', word, '"',
  CASE WHEN refers IS NOT NULL THEN concat(', "source": "$', CAST(refers AS STRING), '.categories"') ELSE '' END, '}')"""
DATA = """concat('{"categories": ["cat', CAST(prompt_tokens % 3 AS STRING), '", "cat1"], "price_max": ', CAST(10 * (completion_tokens % 4) AS STRING), '}')"""
RUN = {
    "error": "CASE WHEN n % 9 = 0 THEN 'bad plan' END",
    "ask_user": QUIET,
    "attempts": "CAST(1 + n % 3 AS INT)",
    "truncated": "CASE WHEN n % 5 = 0 THEN NULL ELSE n % 4 = 0 END",
    "reflections": "CAST(n % 3 AS INT)",
    "first_attempt_ok": "CASE WHEN n % 5 = 0 THEN NULL ELSE n % 2 = 0 END",
    "recommended": "n % 4",
    "few": "n % 6 = 0",
}


def inputs(v):
    """runs, steps, requests."""
    logged = v.v_steps.select(
        "request_id", "agent", "kind", F.col("step_no").cast("int").alias("step_no"), "ok", "prompt_tokens", "completion_tokens", *[F.expr(e).alias(n) for n, e in STEP.items()]
    )
    steps = logged.where(f"NOT ({QUIET})").withColumns({"args": F.expr(ARGS), "data": F.expr(DATA)})
    runs = logged.groupBy("request_id", "agent", "kind").agg(F.count("*").alias("n")).select("*", *[F.expr(e).alias(n) for n, e in RUN.items()])
    runs = runs.withColumn("tools_available", F.when(F.col("few"), F.array(*map(F.lit, FEW))).otherwise(F.array(*map(F.lit, ALL))))
    return runs.drop("kind"), steps, runs.select("request_id", "kind", F.lit("I0").alias("seed_item_id"))


def met(plan: list[list[str]], there: tuple[str, ...]) -> str:
    groups = [[t for t in g if t in there] for g in plan]
    return "regexp_matches(tools, '" + ".*".join(f"<({'|'.join(g)})>" for g in groups if g) + "')"


CHOSEN = " ".join(f"WHEN kind = '{k}' THEN CASE WHEN few THEN {met(p, FEW)} ELSE {met(p, ALL)} END" for k, p in PLANS.items())
INPUTS = duck("v_steps") + f""",
l AS (SELECT request_id, agent, kind, CAST(step_no AS INT) AS step_no, ok, prompt_tokens, completion_tokens, {', '.join(f'{e} AS {n}' for n, e in STEP.items())} FROM v_steps),
e AS (SELECT * FROM l WHERE NOT ({QUIET})),
r AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in RUN.items())} FROM (SELECT request_id, agent, kind, count(*) AS n FROM l GROUP BY 1, 2, 3))"""


@query(
    f"""{INPUTS},
g AS (
  SELECT request_id, count(*) AS n_steps, count(*) FILTER (WHERE ok) AS good, CAST(sum(invented_ids) AS BIGINT) AS invented,
    count(*) FILTER (WHERE error_kind IN ('unknown_tool', 'invented_id', 'unknown_args', 'bad_reference')) AS before,
    count(*) FILTER (WHERE ok OR error_kind NOT IN ('unknown_tool', 'invented_id')) AS judged,
    string_agg('<' || tool || '>', '' ORDER BY step_no) AS tools, bool_or(ok AND tool = 'signup') AS ranked,
    bool_or(ok AND tool = 'purchase' AND prompt_tokens % 5 = 0) AS seeded, min(step_no) FILTER (WHERE ok AND tool = 'view') AS memory,
    arg_min(word, step_no) FILTER (WHERE ok AND tool = 'click' AND word <> '') AS word, bool_and(ok) AS all_ok FROM e GROUP BY 1),
u AS (SELECT DISTINCT request_id FROM e JOIN g USING (request_id) WHERE step_no > memory AND e.tool IN ('click', 'purchase') AND refers = memory),
d AS (
  SELECT r.* EXCLUDE (n), agent = 'A0' AS plans, coalesce(n_steps, 0) AS n, coalesce(tools, '') AS tools, good, invented, before, judged, ranked, seeded, memory, word,
    coalesce(all_ok, true) AS all_ok, u.request_id IS NOT NULL AS used FROM r LEFT JOIN g USING (request_id) LEFT JOIN u USING (request_id))
SELECT request_id, error IS NULL AS plan_valid, CASE WHEN plans THEN attempts END AS plan_attempts, CASE WHEN plans THEN coalesce(truncated, false) END AS plan_truncated,
  CASE WHEN plans THEN n END AS n_steps, CASE WHEN n > 0 THEN round(good * 1.0 / n, 6) END AS steps_ok_rate, CASE WHEN plans THEN coalesce(invented, 0) END AS invented_ids,
  CASE WHEN plans THEN CAST(reflections AS BIGINT) END AS reflections, CASE WHEN plans THEN first_attempt_ok END AS first_attempt_ok,
  CASE WHEN plans THEN CASE WHEN kind = 'K0' THEN error IS NULL AND n = 0 AND ask_user {CHOSEN} END END AS tool_selection_ok,
  CASE WHEN plans AND n > 0 THEN round(1 - before * 1.0 / n, 6) END AS args_valid_rate, CASE WHEN plans AND n > 0 THEN ranked END AS used_ranker,
  CASE WHEN plans AND kind = 'K3' AND seeded THEN true END AS seed_correct, plans AND memory IS NOT NULL AS memory_retrieved,
  CASE WHEN plans AND memory IS NOT NULL THEN CASE WHEN used THEN 'retrieved_and_used' ELSE 'retrieved_not_used' END END AS memory_usage,
  CASE WHEN plans THEN CASE word WHEN 'Red CAT1 shoes' THEN 'good' WHEN 'ab' THEN 'weak' WHEN ' ' THEN 'empty' END END AS keyword_quality,
  CASE WHEN plans AND judged > 0 THEN round(good * 1.0 / judged, 6) END AS argument_correctness, plans AND reflections > 0 AS reflection_invoked,
  plans AND reflections > 0 AND NOT coalesce(first_attempt_ok, false) AND all_ok AND recommended > 0 AS reflection_succeeded FROM d"""
)
def l09_diagnostics(v):
    """Validity, arguments, seeds, memory, keywords and reflection of each run; null where a metric does not apply."""
    return process.diagnose(*inputs(v), ["A0"], PLANS, TOOLS, ambiguous="K0", similar="K3")


@query(
    f"""{INPUTS} SELECT request_id, tool, coalesce(error_kind, 'unknown') AS error_kind, count(*) AS failures FROM e WHERE NOT ok AND agent = 'A0' GROUP BY 1, 2, 3"""
)
def l09_component_failures(v):
    runs, steps, _ = inputs(v)
    return process.component_failures(runs, steps, ["A0"])


@query(
    f"""{INPUTS}, c AS (SELECT request_id, tool, bool_or(ok) AS good, bool_or(NOT ok) AS bad FROM e GROUP BY 1, 2),
t AS (SELECT request_id, few, unnest({list(TOOLS)}) AS tool FROM r WHERE agent = 'A0')
SELECT request_id, tool, CASE WHEN NOT list_contains(CASE WHEN few THEN {list(FEW)} ELSE {list(ALL)} END, tool) THEN 'not_implemented' WHEN good IS NULL THEN 'not_invoked'
  WHEN good AND bad THEN 'mixed_results' WHEN good THEN 'invoked_and_succeeded' ELSE 'invoked_and_failed' END AS state FROM t LEFT JOIN c USING (request_id, tool)"""
)
def l09_component_states(v):
    runs, steps, _ = inputs(v)
    return process.component_states(runs, steps, ["A0"], TOOLS)


@query(
    f"""{INPUTS},
m AS (
  SELECT request_id, step_no AS made_at, unnest([
    {{'field': 'categories', 'value': 'cat' || prompt_tokens % 3}}, {{'field': 'categories', 'value': 'cat1'}}, {{'field': 'price_max', 'value': (10 * (completion_tokens % 4)) || '.0'}}], recursive := true)
  FROM e WHERE ok AND tool = 'view'),
a AS (
  SELECT request_id, step_no AS used_at, tool, unnest([
    {{'argument': 'items', 'text': 'I' || prompt_tokens % 5}}, {{'argument': 'filters.categories_any', 'text': 'cat' || completion_tokens % 3}},
    {{'argument': 'filters.price_max', 'text': (10 * (prompt_tokens % 4)) || '.0'}}, {{'argument': 'query', 'text': word}},
    {{'argument': 'source', 'text': '$' || refers || '.categories'}}], recursive := true) FROM e),
h AS (
  SELECT DISTINCT request_id, made_at, field, value, used_at, tool, argument,
    CASE WHEN text = value THEN 'equal' WHEN starts_with(text, '$' || made_at || '.' || field) THEN 'reference'
      WHEN argument IN ('query', 'source') AND contains(lower(text), lower(value)) THEN 'within' END AS how FROM m JOIN a USING (request_id) WHERE used_at > made_at)
SELECT * FROM h WHERE how IS NOT NULL"""
)
def l09_value_lineage(v):
    """Which later argument holds a value that the memory step returned, or refers to it."""
    arguments = {"items": "array<string>", "filters.categories_any": "array<string>", "filters.price_max": "double", "query": "string", "source": "string"}
    return process.value_lineage(inputs(v)[1], "view", {"categories": "array<string>", "price_max": "double"}, arguments)
