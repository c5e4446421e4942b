"""Every query against its SQL; those without SQL must give rows of a stable schema."""

import pytest
from compare import same
from conftest import DATA

from lorehouse import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA)
    if name in catalog.ORACLE_SQL:
        same(got.toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert got.count() >= 0 and got.columns
