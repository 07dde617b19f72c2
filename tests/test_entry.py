import __spark_entry__ as entry


def test_entry_runs(spark):
    out = entry.entry(spark)
    assert out.columns == ["partition_id", "outbox", "wakeups", "oldest_age"]
    assert 0 < out.count() <= 16


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_inventory_rows_are_covered():
    from strataq.queries import base

    rows = {r for x in base.ROWS.values() for r in x.split()}
    assert len(rows) > 250


def test_rows_without_their_method_are_not_covered():
    from strataq.queries import base

    rows = {r for x in base.ROWS.values() for r in x.split()}
    assert not rows & {"I27", "I32"}
