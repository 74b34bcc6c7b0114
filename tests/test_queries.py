import os

import oracle
import pytest

import __spark_entry__ as entry
from strandline.plans import alignment_queries, file_queries, problems, relational_queries, scalar_queries

QUERIES = {n: f for m in (problems, scalar_queries, relational_queries, file_queries, alignment_queries) for n, f in m.QUERIES.items()}
SQL = {n: s for m in (problems, scalar_queries, relational_queries, file_queries, alignment_queries) for n, s in m.SQL.items()}


@pytest.fixture(scope="module")
def connection(data):
    return oracle.tables(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, connection, data, name):
    oracle.same(spark, connection, QUERIES[name], SQL[name], data)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_query_without_sql_has_rows(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_contract(spark):
    assert QUERIES.keys() <= entry.queries().keys() and entry.oracle_sql().keys() <= entry.queries().keys()
    assert entry.entry(spark).count() > 0


def test_nothing_else_imports_llm():
    root = os.path.join(os.path.dirname(entry.__file__), "strandline")
    for folder, _, files in os.walk(root):
        if os.sep + "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    text = open(os.path.join(folder, f)).read()
                    assert "from .llm" not in text and "..llm" not in text and "strandline.llm" not in text, f
