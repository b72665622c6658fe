"""Ordered reads: point, many keys, bounded ranges in both directions, first and last."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """An end of a range; ``Bound()`` is unbounded."""

    value: Any = None
    inclusive: bool = True
    bounded: bool = False

    @classmethod
    def included(cls, value: Any) -> Bound:
        return cls(value, True, True)

    @classmethod
    def excluded(cls, value: Any) -> Bound:
        return cls(value, False, True)


def within(key: Column, low: Bound = Bound(), high: Bound = Bound()) -> Column:
    """The predicate of a range, in a form that reaches the Parquet statistics. An empty range selects nothing."""
    found = F.lit(True)
    if low.bounded:
        found = (key >= low.value) if low.inclusive else (key > low.value)
    if high.bounded:
        upper = (key <= high.value) if high.inclusive else (key < high.value)
        found = found & upper if low.bounded else upper
    return found


def scan(df: DataFrame, key: str, low: Bound = Bound(), high: Bound = Bound(), *, backward: bool = False, limit: int | None = None, ordered: bool = True) -> DataFrame:
    """Rows of the range in key order (nulls first, last when backward). With a limit only so many rows are kept by each task."""
    out = df.where(within(F.col(key), low, high)) if low.bounded or high.bounded else df
    if ordered:
        out = out.orderBy(F.col(key).desc_nulls_last() if backward else F.col(key).asc_nulls_first())
    return out.limit(limit) if limit is not None else out


def select(df: DataFrame, key: str, pk: Any = None, where: str | None = None, limit: int | None = None) -> DataFrame:
    """Rows in key order: of one primary key, under a SQL condition, at most ``limit`` of them."""
    rows = df if pk is None else point(df, key, pk)
    return scan(rows.where(where) if where else rows, key, limit=limit)


def point(df: DataFrame, key: str, value: Any) -> DataFrame:
    return df.where(F.col(key).eqNullSafe(F.lit(value)) if value is None else F.col(key) == value)


def many(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Rows whose key is among ``keys`` (a column of the same name)."""
    return df.join(keys.select(key), key, "left_semi")


def first_last(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"))


def rank_of(df: DataFrame, key: str, value: Any) -> DataFrame:
    """How many keys are below ``value``: where it would be inserted."""
    return df.where(F.col(key) < value).agg(F.count(F.lit(1)).alias("rank"))
