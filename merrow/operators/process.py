"""Diagnostics of how planning agents worked, from runs, their steps and what was asked.

runs (request_id, agent, error, ask_user, attempts, truncated, reflections, first_attempt_ok, recommended, tools_available)
steps (request_id, step_no from 1, tool, ok, error_kind, args as JSON, invented_ids, data as JSON)
requests (request_id, kind, seed_item_id)

A metric that an agent or a request does not have is null, never zero. Steps of a run are a plan's: a short list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Tools(NamedTuple):
    """What the tools of a log are called."""

    memory: str = "MemoryTool"
    search: str = "SearchTool"
    filter: str = "FilterTool"
    similar: str = "SimilarTool"
    rank: str = "RankTool"
    lookup: str = "LookupTool"


# fixed values: errors before a tool is called, and those that are no fault of the arguments
BEFORE_CALL = ("unknown_tool", "invented_id", "unknown_args", "bad_reference")
NO_ARGUMENTS = ("unknown_tool", "invented_id")


def plan_met(tools: Column, kind: Column, available: Column, plans: Mapping[str, Sequence[Sequence[str]]]) -> Column:
    """Whether tools come in the order of the kind's plan, a plan being groups of tools of which one is enough.

    Groups without an available tool fall out of the plan.
    """
    groups = F.lit(None).cast("array<array<string>>")
    for name, plan in plans.items():
        groups = F.when(kind == name, F.array(*[F.array(*map(F.lit, g)) for g in plan])).otherwise(groups)
    usable = F.filter(F.transform(groups, lambda g: F.array_intersect(g, available)), lambda g: F.size(g) > 0)
    met = F.aggregate(tools, F.lit(0), lambda n, t: F.when(F.coalesce(F.array_contains(F.get(usable, n), t), F.lit(False)), n + 1).otherwise(n))
    return met == F.size(usable)


def query_quality(text: Column) -> Column:
    """'good': two words or more, one of them longer than two; 'weak': other words; 'empty': blanks; null without text."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    good = (F.size(words) >= 2) & F.exists(words, lambda w: F.length(w) > 2)
    return F.when(F.length(text) > 0, F.when(good, "good").when(F.size(words) > 0, "weak").otherwise("empty"))


def step_facts(steps: DataFrame, requests: DataFrame, tools: Tools) -> DataFrame:
    """A row a step with what the diagnostics need of its arguments."""
    arg = lambda path: F.get_json_object("args", f"$.{path}")
    referred = F.filter(F.map_values(F.from_json("args", "map<string,string>")), lambda x: x.rlike(r"^\$\d+\."))
    rows = steps.join(requests.select("request_id", "seed_item_id"), "request_id", "left")
    seeded = F.col("ok") & (F.col("tool") == tools.similar) & F.array_contains(F.from_json(arg("items"), "array<string>"), F.col("seed_item_id"))
    quality = F.when(F.col("ok") & (F.col("tool") == tools.search), query_quality(arg("query")))
    return rows.select(
        "request_id",
        "step_no",
        "tool",
        "ok",
        "error_kind",
        F.coalesce("invented_ids", F.lit(0)).alias("invented"),
        F.coalesce(seeded, F.lit(False)).alias("seeded"),
        F.transform(referred, lambda x: F.regexp_extract(x, r"^\$(\d+)", 1).cast("int")).alias("refers"),
        quality.alias("quality"),
    )


def diagnose(
    runs: DataFrame,
    steps: DataFrame,
    requests: DataFrame,
    planners: Sequence[str],
    plans: Mapping[str, Sequence[Sequence[str]]],
    tools: Tools = Tools(),
    ambiguous: str = "ambiguous",
    similar: str = "similar",
) -> DataFrame:
    """One row a run. For an agent that does not plan all is null but validity, the share of good steps and the false flags."""
    fields = ("step_no", "tool", "ok", "error_kind", "invented", "seeded", "refers", "quality")
    collected = step_facts(steps, requests, tools).groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("s"))
    shape = "array<struct<step_no:int,tool:string,ok:boolean,error_kind:string,invented:bigint,seeded:boolean,refers:array<int>,quality:string>>"
    rows = runs.join(requests.select("request_id", "kind"), "request_id", "left").join(collected, "request_id", "left")
    rows = rows.withColumn("s", F.coalesce(F.col("s").cast(shape), F.array().cast(shape)))

    plans_at_all, n = F.col("agent").isin(*planners), F.size("s")
    for_planners = lambda c: F.when(plans_at_all, c)
    with_steps = lambda c: F.when(plans_at_all & (n > 0), c)
    count = lambda f: F.size(F.filter("s", f))
    valid = F.col("error").isNull()
    asked = valid & (n == 0) & F.coalesce("ask_user", F.lit(False))
    chosen = plan_met(F.transform("s", lambda x: x["tool"]), F.col("kind"), F.col("tools_available"), plans)
    before = lambda x: F.coalesce(x["error_kind"].isin(*BEFORE_CALL), F.lit(False))
    judged = count(lambda x: x["ok"] | ~F.coalesce(x["error_kind"].isin(*NO_ARGUMENTS), F.lit(False)))
    first_memory = F.array_min(F.transform(F.filter("s", lambda x: x["ok"] & (x["tool"] == tools.memory)), lambda x: x["step_no"]))
    rows = rows.withColumn("_memory", first_memory)
    takers = (tools.filter, tools.search, tools.similar)
    later = lambda x: (x["step_no"] > F.col("_memory")) & x["tool"].isin(*takers) & F.array_contains(x["refers"], F.col("_memory"))
    used = F.exists("s", lambda x: F.coalesce(later(x), F.lit(False)))
    qualities = F.transform(F.filter("s", lambda x: x["quality"].isNotNull()), lambda x: x["quality"])
    invoked = F.coalesce(plans_at_all & (F.col("reflections") > 0), F.lit(False))
    turned = ~F.coalesce("first_attempt_ok", F.lit(False)) & F.forall("s", lambda x: x["ok"]) & (F.col("recommended") > 0)
    return rows.select(
        "request_id",
        valid.alias("plan_valid"),
        for_planners(F.col("attempts")).alias("plan_attempts"),
        for_planners(F.coalesce("truncated", F.lit(False))).alias("plan_truncated"),
        for_planners(n).cast("long").alias("n_steps"),
        F.when(n > 0, F.round(count(lambda x: x["ok"]) / n, 6)).alias("steps_ok_rate"),
        for_planners(F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["invented"])).alias("invented_ids"),
        for_planners(F.coalesce("reflections", F.lit(0))).cast("long").alias("reflections"),
        for_planners(F.col("first_attempt_ok")).alias("first_attempt_ok"),
        for_planners(F.when(F.col("kind") == ambiguous, asked).otherwise(chosen)).alias("tool_selection_ok"),
        with_steps(F.round(1 - count(before) / n, 6)).alias("args_valid_rate"),
        with_steps(F.exists("s", lambda x: x["ok"] & (x["tool"] == tools.rank))).alias("used_ranker"),
        F.when(plans_at_all & (F.col("kind") == similar) & F.exists("s", lambda x: x["seeded"]), True).alias("seed_correct"),
        F.coalesce(plans_at_all & F.col("_memory").isNotNull(), F.lit(False)).alias("memory_retrieved"),
        F.when(plans_at_all & F.col("_memory").isNotNull(), F.when(used, "retrieved_and_used").otherwise("retrieved_not_used")).alias("memory_usage"),
        for_planners(F.get(qualities, F.lit(0))).alias("keyword_quality"),
        F.when(plans_at_all & (judged > 0), F.round(count(lambda x: x["ok"]) / judged, 6)).alias("argument_correctness"),
        invoked.alias("reflection_invoked"),
        (invoked & F.coalesce(turned, F.lit(False))).alias("reflection_succeeded"),
    )


def component_failures(runs: DataFrame, steps: DataFrame, planners: Sequence[str]) -> DataFrame:
    """(request_id, tool, error_kind, failures) of planning agents."""
    failed = steps.where(~F.col("ok")).join(runs.where(F.col("agent").isin(*planners)).select("request_id"), "request_id", "left_semi")
    return failed.groupBy("request_id", F.coalesce("tool", F.lit("unknown")).alias("tool"), F.coalesce("error_kind", F.lit("unknown")).alias("error_kind")).agg(F.count("*").alias("failures"))


def component_states(runs: DataFrame, steps: DataFrame, planners: Sequence[str], tools: Tools = Tools()) -> DataFrame:
    """(request_id, tool, state) of planning agents: whether a tool was there, was called, and how its calls went."""
    planned = runs.where(F.col("agent").isin(*planners)).select("request_id", "tools_available", F.explode(F.array(*map(F.lit, tools))).alias("tool"))
    calls = steps.groupBy("request_id", "tool").agg(F.bool_or("ok").alias("some_good"), F.bool_or(~F.col("ok")).alias("some_bad"))
    rows = planned.join(calls, ["request_id", "tool"], "left")
    there = F.coalesce(F.array_contains("tools_available", F.col("tool")), F.lit(False))
    state = (
        F.when(~there, "not_implemented")
        .when(F.col("some_good").isNull(), "not_invoked")
        .when(F.col("some_good") & F.col("some_bad"), "mixed_results")
        .when(F.col("some_good"), "invoked_and_succeeded")
        .otherwise("invoked_and_failed")
    )
    return rows.select("request_id", "tool", state.alias("state"))


def value_lineage(steps: DataFrame, producer: str, fields: Mapping[str, str], arguments: Mapping[str, str]) -> DataFrame:
    """Which later argument holds what an earlier step of ``producer`` returned.

    ``fields``: path in a step's data -> its type ("string", "double", "array<string>"); ``arguments``: the same for args.
    (request_id, made_at, field, value, used_at, tool, argument, how): 'equal' values, 'within' the text of an argument of
    type string (any case), or a 'reference' $n.field to the step. Values meet arguments of their own run only.
    """

    def leaves(column: str, paths: Mapping[str, str], name: str) -> Column:
        def of(path: str, kind: str) -> Column:
            at = F.get_json_object(column, f"$.{path}")
            if kind.startswith("array"):
                return F.transform(F.from_json(at, kind), lambda x: F.struct(F.lit(path).alias(name), x.cast("string").alias("value"), F.lit(False).alias("free")))
            value = at.try_cast("double").cast("string") if kind == "double" else at
            return F.array(F.struct(F.lit(path).alias(name), value.alias("value"), F.lit(kind == "string").alias("free")))

        empty = F.expr(f"CAST(array() AS array<struct<{name}:string,value:string,free:boolean>>)")
        found = F.concat(*[F.coalesce(of(p, k), empty) for p, k in paths.items()])
        return F.explode(F.filter(found, lambda x: x["value"].isNotNull() & (x["value"] != "")))

    good = steps.where(F.col("ok") & (F.col("tool") == producer))
    made = good.select("request_id", F.col("step_no").alias("made_at"), leaves("data", fields, "field").alias("m"))
    made = made.select("request_id", "made_at", "m.field", "m.value")
    used = steps.select("request_id", F.col("step_no").alias("used_at"), "tool", leaves("args", arguments, "argument").alias("u"))
    used = used.select("request_id", "used_at", "tool", "u.argument", F.col("u.value").alias("text"), "u.free")
    met = made.join(used, "request_id").where(F.col("used_at") > F.col("made_at"))
    how = (
        F.when(F.col("text") == F.col("value"), "equal")
        .when(F.col("text").startswith(F.concat(F.lit("$"), F.col("made_at").cast("string"), F.lit("."), F.col("field"))), "reference")
        .when(F.col("free") & F.contains(F.lower("text"), F.lower("value")), "within")
    )
    return met.withColumn("how", how).where(F.col("how").isNotNull()).select("request_id", "made_at", "field", "value", "used_at", "tool", "argument", "how").distinct()
