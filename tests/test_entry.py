import __spark_entry__
from kindred.plans import catalog


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == catalog.K


def test_queries_and_sql_match():
    known = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(known) and set(__spark_entry__.oracle_sql()) <= set(known)
