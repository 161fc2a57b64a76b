import pytest
from check import compare

from tidemill.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_names():
    import __spark_entry__ as e

    assert set(QUERIES) | {"pipeline"} <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_duckdb(spark, duck, name):
    assert not compare(duck, QUERIES[name](spark, SF), SQL[name])
