"""Analytics of logged trajectories: steps (request_id, step_no, tool, ok, latency_seconds, ...) and scored rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import percentiles


def extract_recs(steps: DataFrame, tiers: Sequence[str], value: str) -> DataFrame:
    """The value of the last successful step of the first tier of tools that has one."""
    tier = F.array_position(F.array(*map(F.lit, tiers)), F.col("tool"))
    good = steps.where(F.col("ok") & F.col("tool").isin(*tiers))
    return good.groupBy("request_id").agg(F.max_by(F.struct("tool", value), F.struct(-tier, F.col("step_no"))).alias("b")).select("request_id", "b.*")


def funnel(steps: DataFrame, generated: str, ranked: str, value: str) -> DataFrame:
    """Candidates generated (with repeats), distinct ones, and the step number of the last ranking."""
    made = F.col("ok") & (F.col("tool") == generated)
    return steps.groupBy("request_id").agg(
        F.count_if(made).alias("generated"), F.count_distinct(F.when(made, F.col(value))).alias("unique_retrieved"), F.max(F.when(F.col("ok") & (F.col("tool") == ranked), F.col("step_no"))).alias("ranked_at")
    )


def follows_plan(tools: Column, plan: Sequence[str]) -> Column:
    """Whether the plan's tools occur in this order: one pass with the number of tools met so far."""
    want = F.array(*map(F.lit, plan))
    met = F.aggregate(tools, F.lit(0), lambda n, t: F.when((n < len(plan)) & (t == F.get(want, n)), n + 1).otherwise(n))
    return met == len(plan)


def score_process(steps: DataFrame, plan: Sequence[str], before_call: Sequence[str] = ()) -> DataFrame:
    """By request: steps, share that went well, share that reached its tool, failed tools, plan followed, recovery.

    ``before_call`` names the values of ``error_kind`` of steps that failed before the tool was called (unknown tool or
    arguments, bad reference); without them every step has reached its tool.
    """
    kind = F.col("error_kind") if "error_kind" in steps.columns else F.lit(None).cast("string")
    reached = ~F.coalesce(kind.isin(*before_call), F.lit(False)) if before_call else F.lit(True)
    rows = steps.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("step_no", "tool", "ok", reached.alias("reached")))).alias("s"))
    n, good = F.size("s"), F.size(F.filter("s", lambda x: x["ok"]))
    failed = F.array_sort(F.array_distinct(F.transform(F.filter("s", lambda x: ~x["ok"]), lambda x: x["tool"])))
    first_bad = ~F.col("s")[0]["ok"]
    return rows.select(
        "request_id", n.cast("long").alias("steps"), F.round(good / n, 6).alias("steps_ok_rate"),
        F.round(F.size(F.filter("s", lambda x: x["reached"])) / n, 6).alias("args_valid_rate"), F.array_join(failed, ",").alias("failed_tools"),
        follows_plan(F.transform("s", lambda x: x["tool"]), plan).alias("plan_followed"), first_bad.alias("first_failed"), (first_bad & F.exists("s", lambda x: x["ok"])).alias("rescued"),
    )


def score_arguments(steps: DataFrame, requests: DataFrame, tools: Sequence[str], ranker: str, kinds: Sequence[str]) -> DataFrame:
    """By request: whether a search kept to the price limit and the category asked for, and whether the ranker was used.

    requests (request_id, kind, price_max, category); steps have args as JSON, with filters.price_max,
    filters.categories_any, filters.categories_all and query. Null where the request asks for no such thing, or, for the
    price, where no search of ``tools`` names one.
    """
    arg = lambda path: F.get_json_object("args", f"$.{path}")
    lists = [F.from_json(arg(f"filters.{name}"), "array<string>") for name in ("categories_any", "categories_all")]
    called = steps.where(F.col("ok") & F.col("tool").isin(*tools)).join(requests.where(F.col("kind").isin(*kinds)).select("request_id", "price_max", "category"), "request_id")
    price = arg("filters.price_max").try_cast("double")
    within = F.bool_or(F.when(price.isNotNull() & F.col("price_max").isNotNull(), price <= F.col("price_max") + 1e-9))
    named = reduce(or_, [F.coalesce(F.array_contains(x, F.col("category")), F.lit(False)) for x in lists], F.contains(F.lower(F.coalesce(arg("query"), F.lit(""))), F.lower("category")))
    kept = called.groupBy("request_id").agg(within.alias("price_arg_ok"), F.when(F.bool_or(named), True).alias("category_arg_ok"))
    ranked = steps.groupBy("request_id").agg(F.bool_or(F.col("ok") & (F.col("tool") == ranker)).alias("used_ranker"))
    return ranked.join(kept, "request_id", "left")


def score_deployment(steps: DataFrame) -> DataFrame:
    """By request: calls, latency, slowest step and its tool; tokens, cost and exhausted time budgets where steps log them."""
    logged = [F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens") if c in steps.columns]
    if "cost" in steps.columns:
        logged.append(F.round(F.sum("cost"), 6).alias("cost"))
    if "error_kind" in steps.columns:
        logged.append(F.count_if(F.col("error_kind") == "time_budget").alias("time_budget_hits"))
    return steps.groupBy("request_id").agg(
        F.count("*").alias("calls"), F.round(F.sum("latency_seconds"), 6).alias("latency"), F.round(F.max("latency_seconds"), 6).alias("slowest"),
        F.max_by("tool", F.struct("latency_seconds", "step_no")).alias("slowest_tool"), *logged,
    )


def deployment_by_tool(steps: DataFrame) -> DataFrame:
    """By tool: calls, tokens, cost, and latency percentiles."""
    sums = steps.groupBy("tool").agg(F.count("*").alias("calls"), F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).alias("tokens"), F.round(F.sum("cost"), 6).alias("cost"))
    out = sums.join(percentiles(steps, "latency_seconds", [0.5, 0.95, 0.99], ["tool"]), "tool")
    return out.select("tool", "calls", "tokens", "cost", *[F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def tool_percentiles(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    out = steps.groupBy(*by).agg(
        F.count("*").alias("calls"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("ok_rate"), F.round(F.avg("latency_seconds"), 6).alias("mean")
    ).join(percentiles(steps, "latency_seconds", [0.5, 0.95, 0.99], by), list(by))
    return out.select(*by, "calls", "ok_rate", "mean", *[F.round(F.col("p")[i], 9).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def score_grounding(answers: DataFrame) -> DataFrame:
    """Flags by answer status; grounded is null where nothing was answered."""
    status = F.col("status")
    answered = status.isin("answered", "fallback")
    return answers.select("request_id", answered.alias("answered"), F.when(answered, status == "answered").alias("grounded"), F.when(answered, status == "fallback").alias("fallback"))


def score_interaction(rows: DataFrame, kinds_with_price: Sequence[str]) -> DataFrame:
    """rows (request_id, kind, recommended, satisfying, without_price, error): constraint satisfaction and success by kind."""
    known = F.col("recommended") - F.col("without_price")
    satisfied = F.when(F.col("kind").isin(*kinds_with_price) & (known > 0), F.round(F.col("satisfying") / known, 6))
    unknown = F.when(F.col("recommended") > 0, F.round(F.col("without_price") / F.col("recommended"), 6))
    success = F.when(F.col("error"), False).when(F.col("kind").isin(*kinds_with_price), F.coalesce(F.col("satisfying") > 0, F.lit(False))).otherwise(F.col("recommended") > 0)
    return rows.select("request_id", "kind", satisfied.alias("constraint_satisfaction"), unknown.alias("unknown_price_rate"), success.alias("success"))


def join_scores(parts: Sequence[DataFrame], key: str = "request_id") -> DataFrame:
    """One flat row a request from several scorers."""
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, key, "left")
    return out


def summarize(rows: DataFrame, means: Sequence[str], quantiles: Sequence[str]) -> DataFrame:
    """By agent, kind and segment, and over all segments ('all'): n, means of what is not null, p50 and p95."""
    levels = rows.withColumn("segment", F.explode(F.array("segment", F.lit("all"))))
    out = levels.groupBy("agent", "kind", "segment").agg(
        F.count("*").alias("n"), *[F.round(F.avg(F.col(c).cast("double")), 6).alias(f"mean_{c}") for c in means]
    )
    for c in quantiles:
        out = out.join(percentiles(levels, c, [0.5, 0.95], ["agent", "kind", "segment"]).withColumnRenamed("p", f"q_{c}"), ["agent", "kind", "segment"], "left")
    return out.select("agent", "kind", "segment", "n", *[f"mean_{c}" for c in means], *[F.round(F.col(f"q_{c}")[i], 6).alias(f"{q}_{c}") for c in quantiles for i, q in enumerate(("p50", "p95"))])


def error_taxonomy(steps: DataFrame, error_kind: Column, plans: DataFrame | None = None) -> DataFrame:
    """Failed steps by agent, kind and error; plans (request_id, agent, kind, error_kind) adds the errors of whole plans."""
    failed = steps.where(~F.col("ok")).select("agent", "kind", error_kind.alias("error_kind"), "request_id", F.lit("step").alias("level"))
    if plans is not None:
        failed = failed.unionByName(plans.where("error_kind IS NOT NULL").select("agent", "kind", "error_kind", "request_id", F.lit("plan").alias("level")))
    return failed.groupBy("level", "agent", "kind", "error_kind").agg(F.count("*").alias("errors"), F.count_distinct("request_id").alias("requests"))


def failure_rates(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    return rows.groupBy("agent").agg(F.count("*").alias("n"), *[F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6).alias(n) for n, c in flags.items()])


def reflection_stats(rows: DataFrame) -> DataFrame:
    """rows (agent, first_failed, rescued, success): how often a first failure is rescued, and how often one goes unseen."""
    rate = lambda of, given: F.round(F.avg(F.when(given, of.cast("double"))), 6)
    return rows.groupBy("agent").agg(
        F.count("*").alias("n"), F.count_if("first_failed").alias("first_failed"), rate(F.col("rescued"), F.col("first_failed")).alias("rescue_rate"),
        rate(~F.col("success"), ~F.col("first_failed")).alias("blind_spot_rate"),
    )


def consumed_by(steps: DataFrame, producer: str) -> DataFrame:
    """Steps of a tool and the first later step whose args refer to them as $step_no."""
    made = steps.where(F.col("tool") == producer).select("request_id", F.col("step_no").alias("made_at"))
    used = steps.select("request_id", F.col("step_no").alias("used_at"), F.explode(F.regexp_extract_all("args", F.lit(r"\$(\d+)"), F.lit(1))).alias("ref")).select("request_id", "used_at", F.col("ref").cast("long").alias("made_at"))
    hits = made.join(used.where(F.col("used_at") > F.col("made_at")), ["request_id", "made_at"], "left")
    return hits.groupBy("request_id", "made_at").agg(F.min("used_at").alias("consumed_at"))


def classify_outcome(rules: Sequence[tuple[Column, str]], otherwise: str) -> Column:
    """The first rule that holds."""
    out = F.when(rules[0][0], rules[0][1])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out.otherwise(otherwise)
