import pytest

from millrace import plans
from tests.oracle import DATA, check


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_against_sql(spark, name):
    check(spark, plans.QUERIES[name], plans.SQL[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_runs(spark, name):
    assert plans.QUERIES[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 2
    assert set(entry.oracle_sql()) <= set(entry.queries())
