from pyspark.sql import functions as F

from tidemark.operators import running


def test_rows_spread_over_the_ranges_in_order(spark, monkeypatch):
    """Ranges follow the order and none holds most rows; totals over them are those of one window."""
    monkeypatch.setattr(running, "SMALL", 50)
    df = spark.createDataFrame([((i * 37) % 1000, "k" if i % 2 else None) for i in range(1000)], "n long, k string").repartition(3)
    rows = running.bucketed(df, ["k", "n"], "b").collect()
    ordered = sorted(rows, key=lambda r: (r["k"] is not None, r["k"] or "", r["n"]))
    assert [r["b"] for r in ordered] == sorted(r["b"] for r in rows)
    counts = [[r["b"] for r in rows].count(b) for b in {r["b"] for r in rows}]
    assert len(counts) >= 15 and max(counts) <= 150
    total, want = 0, {}
    for r in ordered:
        total += r["n"]
        want[r["n"]] = total
    assert {r["n"]: r["running"] for r in running.running_sum(df, F.col("n"), ["k", "n"]).collect()} == want
