import pytest
from differential import both

from quarry.plans.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, sf, name):
    got, want = both(spark, sf, QUERIES[name], ORACLE[name])
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    assert len(entry.entry(spark).collect()) == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
