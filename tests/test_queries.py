"""Every registered query of the library against its SQL; those without SQL give rows."""

import oracle
import pytest

from threadloom.plans.registry import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert oracle.compare(df, con, SQL[name]) is None
    else:
        assert df.columns
        df.collect()
