"""Every registered query against its SQL oracle on the sf0.001 tables
(the same check the driver runs at sf0.01), plus the entry contract."""

import pytest

import __spark_entry__ as E
from outletiq.plans.check import canonical_rows, duck

SF = "/root/testdata/sf0.001"
NAMES = sorted(E.queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF)
    srows = [tuple(r) for r in sdf.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert srows is not None
        return
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    assert sorted(sdf.columns) == sorted(dcols)
    assert canonical_rows(srows, sdf.columns) == canonical_rows(res.fetchall(), dcols)
