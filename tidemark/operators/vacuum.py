"""What can be removed: horizon, dead versions, status entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_statuses(versions: DataFrame, clog: DataFrame) -> DataFrame:
    """Adds ``creator`` and ``deleter`` statuses (null if the id is unknown or 0)."""
    creators = clog.select(F.col("txn_id").alias("xmin"), F.col("status").alias("creator"))
    deleters = clog.select(F.col("txn_id").alias("xmax"), F.col("status").alias("deleter"))
    return versions.join(creators, "xmin", "left").join(deleters, "xmax", "left")


def is_vacuumable(horizon: int | None) -> Column:
    """Over ``with_statuses``: made by an aborted transaction, or ended by a committed one below the horizon (None: nothing is pinned)."""
    ended = (F.col("xmax") != 0) & F.col("deleter").eqNullSafe("C")
    if horizon is not None:
        ended = ended & (F.col("xmax") < horizon)
    return F.col("creator").eqNullSafe("A") | ended


def split_versions(marked: DataFrame, horizon: int | None) -> tuple[DataFrame, DataFrame]:
    """(removable, surviving) of versions with their statuses."""
    return marked.where(is_vacuumable(horizon)), marked.where(~is_vacuumable(horizon))


def global_xmin(clog: DataFrame) -> DataFrame:
    """Oldest id in flight, else the next id."""
    return clog.agg(F.coalesce(F.min(F.when(F.col("status") == "V", F.col("txn_id"))), F.max("txn_id") + 1).alias("global_xmin"))


def truncated(clog: DataFrame, committed_from: int, aborted_from: int) -> DataFrame:
    keep = (F.col("status") == "V") | ((F.col("status") == "C") & (F.col("txn_id") >= committed_from)) | ((F.col("status") == "A") & (F.col("txn_id") >= aborted_from))
    return clog.where(keep)


def settled_status(ids: DataFrame, clog: DataFrame, horizon: DataFrame) -> DataFrame:
    """(txn_id, status): as recorded; else committed below the horizon (one row, ``global_xmin``), else active."""
    unknown = F.when(F.col("txn_id") < F.col("global_xmin"), "C").otherwise("V")
    return ids.join(clog, "txn_id", "left").join(F.broadcast(horizon)).select("txn_id", F.coalesce("status", unknown).alias("status"))
