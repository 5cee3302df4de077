"""Every core query against its SQL on the smallest tables; queries without SQL must run."""

import oracle
import pytest

from loomgraph import plans

QUERIES, SQL = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        oracle.compare(df, con, SQL[name])
    else:
        assert df.count() >= 0


def test_names_are_unique_and_not_reserved():
    import re

    books = plans._books()
    assert sum(len(b.queries) for b in books) == len(QUERIES)
    assert not [n for n in QUERIES if re.match(r"(op|p)\d+_", n)]


def test_entry(spark, sf_dir):
    import __spark_entry__ as e

    assert plans.flagship(spark, sf_dir).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
