"""The registered queries read the whole of their tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from merrow.operators import text
from merrow.plans import registry
from merrow.plans.views import Views

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def train():
    """(events, users, items, pairs) up to the 80 percent cut of all events."""
    return duckdb.sql(f"""
WITH e AS (SELECT o_custkey AS u, l_partkey AS i, o_orderdate AS ts FROM '{DIR}/lineitem.parquet' JOIN '{DIR}/orders.parquet' ON o_orderkey = l_orderkey JOIN '{DIR}/part.parquet' ON p_partkey = l_partkey),
c AS (SELECT ts AS cut FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS rn FROM e) WHERE rn = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM e))
SELECT count(*), count(DISTINCT u), count(DISTINCT i), count(DISTINCT (u, i)) FROM e, c WHERE ts <= cut""").fetchall()[0]


def test_popularity_counts_all_events(spark, train):
    pop = __spark_entry__.queries()["h03_popularity_events"](spark, DIR).agg(F.sum("pop"), F.count("*")).first()
    assert tuple(pop) == (train[0], train[2])


def test_pairs_and_queries_without_sql_see_all_events(spark, train):
    found = __spark_entry__.queries()
    assert found["h01_binary_pairs"](spark, DIR).count() == train[3]
    assert found["h22_bpr_fit"](spark, DIR).count() == train[2]


def test_search_scores_every_word_of_the_query(spark):
    found = __spark_entry__.queries()["f05_bm25_search"](spark, DIR)
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
        expected = {(q, i): (s, r) for q, i, s, r in con.sql(registry.SQL["f05_bm25_search"]).fetchall()}
    got = {(r.query_id, r.id): (r.score, r["rank"]) for r in found.collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k][0] - expected[k][0]) < 2e-6 and got[k][1] == expected[k][1] for k in got)


def test_search_outside_the_core_leaves_out_half_of_all_pairs(spark):
    """Every other document is seen, labelled or not; the pairs of queries and documents are not made."""
    found = __spark_entry__.queries()["f08_outside_core_search"](spark, DIR)
    with duckdb.connect() as con:
        for table in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DIR}/{table}.parquet'")
        expected = sorted(con.sql(registry.SQL["f08_outside_core_search"]).fetchall())
    got = sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect())
    assert [(q, i, n) for q, i, _, n in got] == [(q, i, n) for q, i, _, n in expected]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, expected, strict=True))
    assert got and all((q + i) % 2 and i % 3 for q, i, _, _ in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and not re.search(r"NestedLoopJoin Build\w+, \w+, ", plan)  # a join with one row has no condition


def test_seen_by_shelf_is_seen_by_pair(spark):
    rows = [(i, f"w{i % 4} w{i % 7} w{i % 5}") for i in range(-40, 80)] + [(100, None), (101, "!"), (102, "")]
    docs = spark.createDataFrame(rows, "id long, text string")
    queries = spark.createDataFrame([(q, f"w{q % 4}") for q in range(-3, 6)], "query_id long, token string")
    postings = text.asked_postings(docs, "id", "text", queries)
    core, shelf = spark.range(0, 80, 3).toDF("id"), F.pmod("id", F.lit(3))
    seen = queries.select("query_id", F.pmod("query_id", F.lit(3)).alias("shelf"))
    pairs = spark.createDataFrame([(q, i) for q in range(-3, 6) for i, _ in rows if (q - i) % 3 == 0], "query_id long, id long")
    lists = [sorted(map(tuple, text.outside_core_search(postings, queries, core, *how).select("query_id", "id", "score", "rank").collect())) for how in ((seen, 6, shelf), (pairs, 6))]
    assert lists[0] == lists[1] and len(lists[0]) == 54
    plain = text.bm25(text.build_postings(docs, "id", "text"), queries, docs.join(core, "id", "left_anti")).where("(query_id - id) % 3 <> 0")
    scored = {(r.query_id, r.id): round(r.score, 6) for r in plain.collect()}
    assert all(abs(scored[q, i] - score) < 2e-6 for q, i, score, _ in lists[0])


def test_every_domain_and_every_document(spark):
    found = __spark_entry__.queries()
    events = duckdb.sql(f"SELECT p_type, count(*) FROM '{DIR}/lineitem.parquet' JOIN '{DIR}/orders.parquet' ON o_orderkey = l_orderkey JOIN '{DIR}/part.parquet' ON p_partkey = l_partkey GROUP BY 1").fetchall()
    merged = found["a06_merge_domains"](spark, DIR).groupBy("domain").count().collect()
    assert sorted(map(tuple, merged)) == sorted(events)
    assert found["f03_tokenize_ascii"](spark, DIR).count() == spark.read.parquet(f"{DIR}/documents.parquet").count()


def test_sizes_come_from_the_tables(spark):
    found = __spark_entry__.queries()
    assert found["h17_score_candidates"](spark, DIR).agg(F.max("item")).first()[0] < 200
    audit = found["c06_split_audit"](spark, DIR)
    assert {r.out_of_range for r in audit.collect()} == {0}
    assert found["k13_retrieval_metrics"](spark, DIR).where("source = 'cf'").first().catalog_share > 0.2


def test_sizes(spark):
    v = Views(spark, DIR)
    assert (v.n_users(), v.n_items()) == (150, 200)
