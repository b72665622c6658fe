import pytest
from pyspark.sql import functions as F

from tidemark.functions import types as kinds
from tidemark.functions.visibility import Snapshot, visible_among, visible_at
from tidemark.operators import dml, history, running
from tidemark.operators.running import following, running_sum
from tidemark.operators.scan import Bound, scan
from tidemark.operators.structure import routed

SNAP = Snapshot(10, 20, frozenset({12, 15}))


@pytest.mark.parametrize(("xmin", "xmax", "seen"), [(5, 0, True), (5, 8, False), (12, 0, False), (5, 15, True), (25, 0, False), (0, 0, True), (5, 25, True)])
def test_truth_table(spark, xmin, xmax, seen):
    assert spark.range(1).select(SNAP.visible(F.lit(xmin), F.lit(xmax))).first()[0] is seen


def test_aborted_creators_and_deleters(spark):
    snap = Snapshot(10, 20, frozenset(), frozenset({7}))
    row = spark.range(1).select(snap.visible(F.lit(7), F.lit(0)), snap.visible(F.lit(5), F.lit(7))).first()
    assert tuple(row) == (False, True)


@pytest.mark.parametrize(("xmin", "xmax", "seen"), [(12, 0, True), (12, 12, False), (5, 12, False), (12, 15, True)])
def test_own_writes(spark, xmin, xmax, seen):
    assert spark.range(1).select(SNAP.visible_to(12, F.lit(xmin), F.lit(xmax))).first()[0] is seen


def test_in_progress(spark):
    ids = spark.createDataFrame([(0,), (9,), (12,), (13,), (30,)], "t long")
    assert [r[0] for r in ids.orderBy("t").select(SNAP.in_progress(F.col("t"))).collect()] == [False, False, True, False, True]


def test_latest_sees_everything_committed(spark):
    assert spark.range(1).select(Snapshot.latest().visible(F.lit(99), F.lit(0))).first()[0] is True


def test_one_visible_version_at_every_bound(spark):
    ops = spark.createDataFrame([(i + 1, i // 4 + 1, i * 7 % 5, "D" if i % 6 == 5 else "P", float(i)) for i in range(120)], "lsn long, txn_id long, k long, op string, v double")
    clog = history.statuses(ops)
    bad = {r["txn_id"] for r in history.not_committed(clog).collect()}
    rows = [tuple(r) for r in ops.collect()]
    versions, gone = history.versions(ops, clog, span=16).cache(), history.not_committed(clog)
    for bound in (1, 9, 17, 31):
        state = {}
        for lsn, txn, k, op, v in sorted(rows):
            if txn < bound and txn not in bad:
                state.pop(k, None) if op == "D" else state.update({k: (v, lsn)})
        assert {r["k"]: (r["v"], r["lsn"]) for r in visible_at(versions, gone, bound).collect()} == state


def test_following_over_pieces(spark):
    rows = [(i % 3, i, i * 10) for i in range(50) if i % 7]
    df = spark.createDataFrame(rows, "k long, lsn long, t long")
    for span in (1, 5, 1000):
        got = {(r["k"], r["lsn"]): r["n"] for r in following(df, "k", "lsn", "t", span, "n").collect()}
        assert got == {(k, lsn): next((u for a, b, u in rows if a == k and b > lsn), None) for k, lsn, _ in rows}


def test_running_sum_and_routing(spark):
    df = spark.createDataFrame([(f"u{i:03d}", i) for i in range(40)], "u string, n long")
    got = {r["u"]: r["running"] for r in running_sum(df, F.col("n"), ["u"]).collect()}
    assert got == {f"u{i:03d}": i * (i + 1) // 2 for i in range(40)}
    seps = spark.createDataFrame([("u005",), ("u020",), ("u0205",)], "s string")
    child = {r["u"]: r["child"] for r in routed(df.select("u"), "u", seps, "s").collect()}
    assert child == {f"u{i:03d}": (i >= 5) + (i >= 20) + (i >= 21) for i in range(40)}


def test_running_sum_of_a_hot_key_and_nulls(spark, monkeypatch):
    """One key holds most rows and all keys begin alike, yet ranges hold few rows each."""
    monkeypatch.setattr(running, "SMALL", 20)
    rows = [(None if i % 50 == 0 else "https://www.example.org/" + ("hot" if i % 3 else f"{i:04d}"), i) for i in range(600)]
    df = spark.createDataFrame(rows, "u string, n long").repartition(3)
    total, want = 0, {}
    for u, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        total += n
        want[n] = total
    assert {r["n"]: r["running"] for r in running_sum(df, F.col("n"), ["u", "n"]).collect()} == want
    sizes = [r["count"] for r in running.bucketed(df, ["u", "n"], "b").groupBy("b").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 120
    seps = spark.createDataFrame([(None,), ("https://www.example.org/0300",), ("https://www.example.org/hot",), ("z",)], "s string")
    child = {(r["u"], r["n"]): r["child"] for r in routed(df, "u", seps, "s").collect()}
    assert child == {(u, n): 1 + sum(x <= (u or "") for x in ("https://www.example.org/0300", "https://www.example.org/hot")) for u, n in rows}


def test_versions_with_carried_statuses(spark):
    """The joinless forms equal those over a status table."""
    ops = spark.createDataFrame([(i + 1, i // 4 + 1, i * 7 % 5, "D" if i % 6 == 5 else "P", float(i)) for i in range(120)], "lsn long, txn_id long, k long, op string, v double")
    clog, columns = history.statuses(ops), ["k", "v", "lsn", "xmin", "xmax"]
    for last_lsn in (None, 120):
        marked = history.settled_versions(history.with_status(ops, 30), last_lsn, span=16)
        plain = history.versions(ops, clog, span=16)
        assert sorted(map(tuple, marked.select(columns).collect())) == sorted(map(tuple, plain.collect()))
        for bound, me in ((9, None), (17, 19), (None, None)):
            want = visible_at(plain, history.not_committed(clog), bound, me)
            assert sorted(map(tuple, visible_among(marked, bound, me).select(columns).collect())) == sorted(map(tuple, want.collect()))


def test_bounds(spark):
    df = spark.createDataFrame([(i,) for i in range(8)] + [(None,)], "k long")
    values = range(8)
    for low in (Bound(), Bound.included(2), Bound.excluded(2), Bound.included(9)):
        for high in (Bound(), Bound.included(5), Bound.excluded(5)):
            want = [v for v in values if (not low.bounded or v > low.value or low.inclusive and v == low.value) and (not high.bounded or v < high.value or high.inclusive and v == high.value)]
            if not low.bounded and not high.bounded:
                want = [None, *want]
            assert [r["k"] for r in scan(df, "k", low, high).collect()] == want
            assert [r["k"] for r in scan(df, "k", low, high, backward=True).collect()] == want[::-1]


def test_claims_against_all_pairs(spark):
    claims = [(i * 31 % 17, i % 3, i) for i in range(60)]
    df = spark.createDataFrame(claims, "tid long, k long, lsn long")
    got = sorted(tuple(r) for r in dml.claim_conflicts(df, 10).collect())
    assert got == sorted((a[0], b[0]) for a in claims for b in claims if a[1] == b[1] and a[2] < b[2] <= a[2] + 10 and a[0] != b[0])


def test_key_types():
    from pyspark.sql import types as T

    for good in ("int", "string", "binary", "array<string>", "struct<a:int,b:date>", "decimal(20,0)"):
        kinds.check_key_type(T._parse_datatype_string(good) if not good.startswith("struct") else T._parse_datatype_string(f"x {good}").fields[0].dataType)
    for bad in (T.DoubleType(), T.FloatType(), T.MapType(T.StringType(), T.StringType()), T.ArrayType(T.DoubleType())):
        with pytest.raises(kinds.KeyTypeError):
            kinds.check_key_type(bad)
    numbers = [-(1 << 127), -5, -1, 0, 7, (1 << 127) - 1]
    coded = [kinds.ordered_i128(n) for n in numbers]
    assert coded == sorted(coded) and [kinds.from_ordered_i128(c) for c in coded] == numbers
