"""Every query of the subpackage runs; those with SQL give the same rows as DuckDB."""

import pytest

from sparkloom.llm import queries
from tests.compare import connect, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, data, name):
    out = queries.QUERIES[name](spark, data).toPandas()
    if name in queries.SQL:
        assert rows(out) == rows(connect(data).execute(queries.SQL[name]).df())
