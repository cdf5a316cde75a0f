import pytest
from oracle import same

from stepforge import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    same(spark, name, catalog.QUERIES[name], catalog.ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert {r["bucket"] for r in e.entry(spark).collect()} == {"op_2_10", "op_11_14", "op_15_20"}
    assert set(e.oracle_sql()) <= set(e.queries())
