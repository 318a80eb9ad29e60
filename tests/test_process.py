"""Process diagnostics against runs worked out by hand."""

import json

from merrow.operators import process

PLANS = {"similar": [["SimilarTool"], ["RankTool"]], "cold": [["SearchTool", "FilterTool"], ["RankTool"]]}
ALL = ["MemoryTool", "SearchTool", "FilterTool", "SimilarTool", "RankTool", "LookupTool"]
RUN = "request_id string, agent string, error string, ask_user boolean, attempts int, truncated boolean, reflections int, first_attempt_ok boolean, recommended int, tools_available array<string>"
STEP = "request_id string, step_no int, tool string, ok boolean, error_kind string, args string, invented_ids int, data string"


def frames(spark):
    runs = [
        ("similar", "planner", None, None, 2, None, 1, False, 3, ALL),
        ("unsure", "planner", None, True, 1, True, 0, None, 0, ALL),
        ("broken", "planner", "bad", True, 3, False, None, None, 0, ["RankTool"]),
        ("plain", "popular", None, None, None, None, 4, True, 5, ALL),
        ("weak", "planner", None, None, 1, False, 2, None, 0, [t for t in ALL if t != "RankTool"]),
    ]
    args = lambda **a: json.dumps(a)
    steps = [
        ("similar", 1, "MemoryTool", True, None, args(), 0, args(categories=["Red Shoes", "hats"], price_max=20)),
        ("similar", 2, "SimilarTool", True, None, args(items=["A", "SEED"], source="$1.categories"), 2, None),
        ("similar", 3, "SearchTool", True, None, args(query="cheap red shoes", filters={"price_max": 20.0, "categories_any": ["hats"]}), None, None),
        ("similar", 4, "RankTool", True, None, None, 0, None),
        ("plain", 1, "RankTool", False, "tool_error", args(), 1, None),
        ("plain", 2, "RankTool", True, None, args(), 0, None),
        ("weak", 1, "SearchTool", False, "unknown_args", "{not json", 0, None),
        ("weak", 2, "SearchTool", True, None, args(query=""), 0, None),
        ("weak", 3, "SearchTool", True, None, args(query=" ab "), 0, None),
        ("weak", 4, "Odd", False, "unknown_tool", args(x="$9.y"), 1, None),
        ("weak", 5, "MemoryTool", True, None, args(source="$5.a"), 0, args(categories=[])),
        ("weak", 6, "RankTool", True, None, args(source="$5.a"), 0, None),
    ]
    requests = [("similar", "similar", "SEED"), ("unsure", "ambiguous", None), ("broken", "ambiguous", None), ("plain", "similar", "SEED"), ("weak", "cold", None)]
    return spark.createDataFrame(runs, RUN), spark.createDataFrame(steps, STEP), spark.createDataFrame(requests, "request_id string, kind string, seed_item_id string")


def test_each_metric_or_null(spark):
    got = {r.request_id: r.asDict() for r in process.diagnose(*frames(spark), ["planner"], PLANS).collect()}
    want = {
        "similar": (True, 2, False, 4, 1.0, 2, 1, False, True, 1.0, True, True, True, "retrieved_and_used", "good", 1.0, True, True),
        "unsure": (True, 1, True, 0, None, 0, 0, None, True, None, None, None, False, None, None, None, False, False),
        "broken": (False, 3, False, 0, None, 0, 0, None, False, None, None, None, False, None, None, None, False, False),
        "plain": (True, None, None, None, 0.5, None, None, None, None, None, None, None, False, None, None, None, False, False),
        "weak": (True, 1, False, 6, 0.666667, 1, 2, None, True, 0.666667, True, None, True, "retrieved_not_used", "weak", 0.8, True, False),
    }
    names = [n for n in got["weak"] if n != "request_id"]
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == want


def test_failures_and_states_of_components(spark):
    runs, steps, _ = frames(spark)
    assert sorted(map(tuple, process.component_failures(runs, steps, ["planner"]).collect())) == [("weak", "Odd", "unknown_tool", 1), ("weak", "SearchTool", "unknown_args", 1)]
    states = {(r.request_id, r.tool): r.state for r in process.component_states(runs, steps, ["planner"]).collect()}
    assert states["weak", "SearchTool"] == "mixed_results" and states["weak", "RankTool"] == "not_implemented" and states["weak", "FilterTool"] == "not_invoked"
    assert states["similar", "MemoryTool"] == "invoked_and_succeeded" and not any(r == "plain" for r, _ in states)


def test_values_are_followed_into_arguments(spark):
    _, steps, _ = frames(spark)
    found = process.value_lineage(
        steps, "MemoryTool", {"categories": "array<string>", "price_max": "double"},
        {"query": "string", "filters.price_max": "double", "filters.categories_any": "array<string>", "source": "string"},
    )
    assert sorted((r.request_id, r.field, r.value, r.used_at, r.argument, r.how) for r in found.collect()) == [
        ("similar", "categories", "Red Shoes", 2, "source", "reference"),
        ("similar", "categories", "Red Shoes", 3, "query", "within"),
        ("similar", "categories", "hats", 2, "source", "reference"),
        ("similar", "categories", "hats", 3, "filters.categories_any", "equal"),
        ("similar", "price_max", "20.0", 3, "filters.price_max", "equal"),
    ]
    assert process.value_lineage(steps.where("false"), "MemoryTool", {"a": "string"}, {"b": "string"}).count() == 0
