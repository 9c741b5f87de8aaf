import pytest
from oracle import compare

from cairnlight.plans import knowledge, managed, tables

SF = "/root/testdata/sf0.001"
ALL = tables.ORACLES | knowledge.ORACLES | managed.ORACLES
QUERIES = tables.QUERIES | knowledge.QUERIES | managed.QUERIES


@pytest.mark.parametrize("name", sorted(ALL))
def test_query_equals_its_sql(spark, name):
    compare(spark, QUERIES[name], ALL[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ALL)))
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
