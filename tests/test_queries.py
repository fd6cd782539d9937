import pytest

import __spark_entry__ as entry
from vicinal import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_its_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 10


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
