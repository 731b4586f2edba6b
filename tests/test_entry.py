import __spark_entry__ as e


def test_entry_and_names(spark):
    assert e.entry(spark).count() > 0
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q) and {"p3_found", "p5_found", "unique_first"} <= set(q)
