"""Negatives drawn one at a time against the first free one of all draws."""

from pyspark.sql import functions as F

from merrow.functions.draws import draw
from merrow.operators import factors
from merrow.operators.ids import build_sorted_ids


def test_first_free_draw_or_lowest_unseen(spark):
    few = [(f"u{u}", i * 3) for u in range(20) for i in range(12) if (u * 7 + i * i) % 5]
    pairs = spark.createDataFrame([*few, *(("most", i * 3) for i in range(11)), *(("all", i * 3) for i in range(12))], "user_id string, item long").cache()
    items = [r.item for r in build_sorted_ids(pairs, "item").orderBy("idx").collect()]
    held = {}
    for u, i in pairs.collect():
        held.setdefault(u, set()).add(i)
    for tries in (1, 3, 8):
        draws = pairs.select("user_id", "item", F.array(*[draw(F.col("user_id"), F.col("item"), F.lit(t), F.lit(2), F.lit(5)) % len(items) for t in range(tries)]).alias("d")).collect()
        want = set()
        for u, i, d in draws:
            free = [x for x in items if x not in held[u]]
            if free:
                want.add((u, i, next((items[x] for x in d if items[x] not in held[u]), free[0])))
        got = factors.sample_triples(pairs.unionByName(pairs.limit(9)), 2, 5, tries).collect()
        assert len(got) == len(want) and {(r.user_id, r.item, r.negative) for r in got} == want


def test_draws_are_not_multiplied(spark):
    """Before, each pair was a row for each of its eight draws in two joins."""
    pairs = spark.range(400).select((F.col("id") % 20).cast("string").alias("user_id"), "id").withColumnRenamed("id", "item")
    plan = factors.sample_triples(pairs, 0)._jdf.queryExecution().optimizedPlan().toString()
    assert "[0,1,2,3,4,5,6,7]" not in plan and "sequence(0, 7" not in plan
