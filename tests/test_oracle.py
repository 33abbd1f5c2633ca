"""Every query of the library that has SQL gives the rows of that SQL."""

import pytest

from quernstone import catalog

from .oracle import connect, same_rows


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        same_rows(df, duck.sql(catalog.ORACLE_SQL[name]))
    else:
        assert df.columns
        df.collect()
