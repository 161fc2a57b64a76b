"""Every registered query against its check SQL on the smallest data set."""

import pytest
from check import compare
from paths import SF_DIR

import __spark_entry__ as contract
from tidemill.plans.catalog import QUERIES

CHECKED = sorted(n for n, q in QUERIES.items() if q.sql)
UNCHECKED = sorted(n for n, q in QUERIES.items() if not q.sql)


@pytest.mark.parametrize("name", CHECKED)
def test_matches_check_sql(name, spark, duck):
    assert compare(duck, QUERIES[name](spark, SF_DIR), QUERIES[name].sql) == ""


@pytest.mark.parametrize("name", UNCHECKED)
def test_runs(name, spark):
    df = QUERIES[name](spark, SF_DIR)
    assert df.columns and df.count() >= 0


def test_contract(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).columns == ["pipeline_name", "run_no", "rule", "rule_order", "anomaly_type", "metric"]
