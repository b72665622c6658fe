"""Snapshots as boolean columns.

``xmax = 0`` means live and id 0 is always committed, so all predicates are two-valued.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Statuses of a transaction.
COMMITTED, ABORTED, ACTIVE = "C", "A", "V"
#: Up to so many ids a set is a literal in the predicate; beyond, a join.
LITERAL_IDS = 1000


@dataclass(frozen=True)
class Snapshot:
    """Ids below ``xmin`` are settled, ids from ``xmax`` on haven't begun; ``active`` ones in between were in flight. ``aborted`` is what readers must know of the status table (committed is presumed)."""

    xmin: int
    xmax: int
    active: frozenset[int] = field(default_factory=frozenset)
    aborted: frozenset[int] = field(default_factory=frozenset)

    @classmethod
    def latest(cls, aborted: frozenset[int] = frozenset()) -> Snapshot:
        return cls((1 << 63) - 1, (1 << 63) - 1, frozenset(), aborted)

    def committed(self, txn: Column) -> Column:
        seen = (txn < self.xmax) & ~_among(txn, self.active) & ~_among(txn, self.aborted)
        return (txn == 0) | seen

    def in_progress(self, txn: Column, settled: Column | None = None) -> Column:
        """``settled``: whether the status table has the id as committed or aborted."""
        settled = F.lit(False) if settled is None else settled
        open_ = (txn >= self.xmax) | _among(txn, self.active)
        return (txn != 0) & ~settled & (txn >= self.xmin) & open_

    def visible(self, xmin: Column, xmax: Column) -> Column:
        return self.committed(xmin) & ((xmax == 0) | ~self.committed(xmax))

    def visible_to(self, me: int, xmin: Column, xmax: Column) -> Column:
        """With the writes of transaction ``me``: what it deleted is gone, what it wrote is there."""
        return F.when(xmax == me, False).when(xmin == me, True).otherwise(self.visible(xmin, xmax))


def _among(txn: Column, ids: frozenset[int]) -> Column:
    return txn.isin(sorted(ids)) if ids else F.lit(False)


def with_status(versions: DataFrame, bad: DataFrame) -> DataFrame:
    """Adds ``_creator_bad`` and ``_deleter_bad``: whether the ids are in ``bad`` (txn_id), by equality joins that go broadcast only if the table turns out small."""
    ids = bad.select("txn_id").distinct()
    creators = ids.select(F.col("txn_id").alias("xmin"), F.lit(True).alias("_creator_bad"))
    deleters = ids.select(F.col("txn_id").alias("xmax"), F.lit(True).alias("_deleter_bad"))
    return versions.join(creators, "xmin", "left").join(deleters, "xmax", "left").fillna(False, ["_creator_bad", "_deleter_bad"])


def visible_among(marked: DataFrame, bound: int | None, me: int | None = None) -> DataFrame:
    """As ``visible_at`` over versions that carry ``creator`` and ``deleter`` statuses: a filter, no join."""
    early = (lambda c: F.lit(True)) if bound is None else (lambda c: c < bound)
    creator = early(F.col("xmin")) & (F.col("creator") == COMMITTED)
    deleter = (F.col("xmax") != 0) & early(F.col("xmax")) & F.col("deleter").eqNullSafe(COMMITTED)
    seen = creator & ~deleter
    if me is not None:
        seen = F.when(F.col("xmax") == me, False).when(F.col("xmin") == me, True).otherwise(seen)
    return marked.where(seen)


def visible_at(versions: DataFrame, bad: DataFrame, bound: int | None, me: int | None = None) -> DataFrame:
    """Versions visible to a snapshot below which every id is settled: ``bad`` ids didn't commit. No ``bound``: the latest state. ``me``: a transaction's own view."""
    early = (lambda c: F.lit(True)) if bound is None else (lambda c: c < bound)
    creator = early(F.col("xmin")) & ~F.col("_creator_bad")
    deleter = (F.col("xmax") != 0) & early(F.col("xmax")) & ~F.col("_deleter_bad")
    seen = creator & ~deleter
    if me is not None:
        seen = F.when(F.col("xmax") == me, False).when(F.col("xmin") == me, True).otherwise(seen)
    elif bound is not None:
        versions = versions.where(F.col("xmin") < bound)  # before the joins
    return with_status(versions, bad).where(seen).select(versions.columns)
