"""Search over the postings that are asked for against the search over all postings."""

import random

from pyspark.sql import functions as F

from merrow.operators import text

from .test_pruned import asked, rows, zipf_docs


def test_same_lists_and_ranks(spark):
    docs = zipf_docs(400, 3)
    docs += [(5000 + i, docs[i][1]) for i in range(40)] + [(9000, ""), (9001, None), (9002, "--")]  # copies: ties
    table, queries, rng = spark.createDataFrame(docs, "id long, text string"), asked(spark, random.Random(4), 12), random.Random(7)
    whole, held = text.build_postings(table, "id", "text").cache(), text.asked_postings(table, "id", "text", queries).cache()
    shape = "query_id", "rank", "id", "score"
    for limit in (5, 5000):
        assert rows(text.asked_search(held, queries, limit), *shape) == rows(text.bm25_search(whole, queries, limit), *shape)
    targets = spark.createDataFrame([(q, rng.choice(docs)[0]) for q in range(13) for _ in range(6)] + [(3, 77777), (4, 9000)], "query_id long, id long").distinct()
    got = rows(text.asked_rank_of(held, queries, targets).fillna({"rank": -1}), "query_id", "id", "rank", "place")
    assert got == rows(text.bm25_rank_of(whole, queries, targets).fillna({"rank": -1}), "query_id", "id", "rank", "place")
    assert {"no_match", "inside", "outside"} == {r[3] for r in got}
    some = table.where("id % 3 = 0")
    visible = rows(text.asked_search(text.asked_postings(some, "id", "text", queries), queries, 7), *shape)
    assert visible == rows(text.bm25_search(whole, queries, 7, some.select("id")), *shape)


def test_search_queries_write_no_postings_that_nobody_asks_for(spark, tmp_path):
    from merrow.plans import retrieval_queries
    from merrow.plans.views import Views

    spark.createDataFrame([(i, "seldom " * 3 + f"w{i}", "en") for i in range(50)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "w7 w8")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    postings, queries = retrieval_queries.asked_index(Views(spark, str(tmp_path)))
    assert postings.where("token <> ''").count() == 2 and postings.where("token = ''").select(F.sum("dl")).first()[0] == 200 and queries.count() == 2
    for name in ("f05_bm25_search", "f06_bm25_batch_filtered"):
        assert sorted(r.id for r in getattr(retrieval_queries, name)(Views(spark, str(tmp_path))).collect()) == [7, 8]
