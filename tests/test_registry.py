import __spark_entry__


def test_every_checked_query_is_registered():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(found) > 150


def test_entry_has_rows(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["segment", "users", "ndcg"] and df.count() > 0
