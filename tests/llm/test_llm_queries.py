import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import oracle  # noqa: E402

from strandline.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.fixture(scope="module")
def connection(data):
    return oracle.tables(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, connection, data, name):
    oracle.same(spark, connection, QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
