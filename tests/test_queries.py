"""Every registered query runs; those with SQL give the same rows as DuckDB."""

import pytest

from sparkloom import plans
from tests.compare import connect, rows


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, data, con, name):
    out = plans.QUERIES[name](spark, data).toPandas()
    if name in plans.SQL:
        want = con.execute(plans.SQL[name]).df()
        assert sorted(out.columns) == sorted(want.columns)
        assert rows(out) == rows(want)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "id", "score", "bm25_rank", "dense_rank", "rank"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
