import random

import pytest

from tidemark.llm import suffix_dedup
from tests.llm.test_duplicates import brute_removal, ordered, removed


@pytest.mark.parametrize("run", [1, 200_000])
def test_rows_stored_twice_count_once(spark, monkeypatch, run):
    """With runs of one entry the copies meet in the merge, else in one run."""
    monkeypatch.setattr(suffix_dedup, "RUN", run)
    rng = random.Random(2)
    a, b, c = ("".join(rng.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    rows = [(1, a), (1, a), (2, "x" + a[50:250] + c), (2, "x" + a[50:250] + c), (None, b), (None, b), (None, b), (3, c[:150]), (4, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = removed(df)
    assert len(found) == len(rows) and sorted(set(found)) == brute_removal(ordered(df), 100)
    assert [x[2] for x in found if x[0] == "1"] == [0, 0]
