"""Every registered core query against DuckDB over whole tables."""

import compare
import pytest

from quillrake.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    assert all(kind != "void" for _, kind in df.dtypes)
    if name in ORACLE_SQL:
        assert compare.same(df, duck, ORACLE_SQL[name]) is None
    else:
        assert df.count() > 0
