"""Every query with SQL gives the rows of its SQL; every other one runs."""

import pytest
from compare import connection, differences

from seriesloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    if name in catalog.ORACLES:
        assert not differences(rows, df.columns, catalog.ORACLES[name], db)
    else:
        assert rows
