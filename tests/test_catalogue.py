import pytest

import __spark_entry__ as entry
from tidemark.plans import catalogue

from .compare import both

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equals_sql(spark, name):
    mine, theirs = both(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], FOLDER)
    assert mine == theirs


def test_flagship_has_rows(spark):
    found = entry.entry(spark)
    assert found.columns == ["k", "v", "lsn"] and found.count() > 0


def test_every_query_of_the_catalogue_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)
    assert set(catalogue.QUERIES) <= set(entry.queries())


def test_range_reaches_the_scan(spark):
    plan = catalogue.QUERIES["range_ie"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(o_orderkey,100)" in plan and "LessThan(o_orderkey,200)" in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_order_of_scans(spark):
    forward = [r["k"] for r in catalogue.QUERIES["range_limit"](spark, FOLDER).collect()]
    backward = [r["k"] for r in catalogue.QUERIES["range_backward_limit"](spark, FOLDER).collect()]
    assert forward == sorted(forward) and backward == sorted(backward, reverse=True)
