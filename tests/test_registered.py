"""Every registered query beside its checking SQL on the smallest tables."""

import pytest

import oracle
from featlake.plans import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert oracle.compare(df, con, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == QUERIES["d1_category_profile"](spark, SF).columns
