import __spark_entry__ as entry


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 20
    totals = [r["total"] for r in rows]
    assert totals == sorted(totals, reverse=True)


def test_sql_only_for_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 50
