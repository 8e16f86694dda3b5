from pathlib import Path

import pytest

import __spark_entry__ as entry
from tests.oracle import difference

SF = "/root/testdata/sf0.001"
SQL = {n: s for n, s in entry.oracle_sql().items() if "llm" not in entry.queries()[n].__module__}


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), SQL[name], SF) == ""


@pytest.mark.skipif(not Path(SF).exists(), reason="no test data")
def test_queries_without_sql_have_rows(spark):
    for name, q in entry.queries().items():
        if name not in entry.oracle_sql() and "llm" not in q.__module__:
            assert q(spark, SF).limit(1).count() == 1, name


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(f.__doc__ for f in entry.queries().values())
