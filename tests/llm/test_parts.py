import pytest

import __spark_entry__ as entry
from tests.compare import both
from tidemark.llm import queries


@pytest.mark.parametrize("name", sorted(queries.PART_ORACLES))
def test_part_equals_sql(spark, folder, name):
    mine, theirs = both(spark, queries.PARTS[name], queries.PART_ORACLES[name], folder)
    assert mine == theirs


def test_parts_are_no_operators():
    """The operators and what SQL can say of them are listed apart, and both are registered with their SQL."""
    assert all(name.startswith("op") for name in queries.QUERIES) and set(queries.PARTS) == set(queries.PART_ORACLES)
    assert not set(queries.PARTS) & set(queries.QUERIES)
    assert set(queries.PARTS) | set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.PART_ORACLES) | set(queries.ORACLES) <= set(entry.oracle_sql())
