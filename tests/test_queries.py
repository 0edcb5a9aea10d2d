"""Every registered query against its SQL equivalent, on the smallest tables."""

import pytest
from run_oracles import compare, connection

from cubetally import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    if name not in registry.ORACLES:
        assert registry.QUERIES[name](spark, sf).count() > 0
        return
    same, got, want, a, b = compare(spark, connection(sf), registry.QUERIES[name], registry.ORACLES[name], sf)
    assert sorted(a) == sorted(b)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 9
    assert set(e.oracle_sql()) <= set(e.queries())
