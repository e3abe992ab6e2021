import pytest

import __spark_entry__
from codeloom.plans.driver_queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(name, against_sql):
    against_sql(QUERIES[name], ORACLE_SQL[name])


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(QUERIES) <= set(__spark_entry__.queries())
