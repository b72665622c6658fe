"""Recovery as folds over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .history import latest

ENDS = ("Commit", "Abort")


def rebuilt_statuses(log: DataFrame) -> DataFrame:
    """(txn_id, status) from the last Commit or Abort of each transaction."""
    return log.where(F.col("rec_type").isin(*ENDS)).groupBy("txn_id").agg(F.when(F.max_by("rec_type", "lsn") == "Commit", "C").otherwise("A").alias("status"))


def crash_victims(log: DataFrame) -> DataFrame:
    """Ids seen without an end, in one pass over the log."""
    ended = F.max(F.col("rec_type").isin(*ENDS))
    return log.groupBy("txn_id").agg(ended.alias("_ended")).where(~F.col("_ended")).select("txn_id")


def watermarks(log: DataFrame, next_txn_id: int = 1, next_lsn: int = 1) -> DataFrame:
    """The next id and position, not below those of the checkpoint."""
    return log.agg(
        F.greatest(F.coalesce(F.max("txn_id") + 1, F.lit(next_txn_id)), F.lit(next_txn_id)).cast("long").alias("next_txn_id"),
        F.greatest(F.coalesce(F.max("lsn") + 1, F.lit(next_lsn)), F.lit(next_lsn)).cast("long").alias("next_lsn"),
    )


def committed_records(log: DataFrame) -> DataFrame:
    committed = log.where("rec_type = 'Commit'").select("txn_id").distinct()
    return log.where(~F.col("rec_type").isin(*ENDS)).join(committed, "txn_id", "left_semi")


def redo_state(log: DataFrame) -> DataFrame:
    """(k, v): the last committed record of each key, deletes dropped. A function of the log alone, so replaying twice changes nothing."""
    return latest(committed_records(log), F.col("rec_type") == "SetXMax").select("k", "v")


def from_checkpoint(state: DataFrame, log_after: DataFrame) -> DataFrame:
    """The same from a checkpoint's state (k, v, lsn) and the log from its redo point on."""
    rows = committed_records(log_after).select("k", "v", "lsn", (F.col("rec_type") == "SetXMax").alias("gone"))
    return latest(state.select("k", "v", "lsn", F.lit(False).alias("gone")).unionByName(rows), F.col("gone")).select("k", "v")


def valid_prefix(log: DataFrame, is_torn) -> DataFrame:
    """Records before the first torn one."""
    first = log.where(is_torn).agg(F.min("lsn").alias("_torn"))  # one row
    return log.join(F.broadcast(first)).where(F.col("_torn").isNull() | (F.col("lsn") < F.col("_torn"))).drop("_torn")


def segments(log: DataFrame, size: int) -> DataFrame:
    """(segment, first_lsn, last_lsn, n) of segments of ``size`` positions."""
    return log.groupBy(F.floor((F.col("lsn") - 1) / size).cast("long").alias("segment")).agg(F.min("lsn").alias("first_lsn"), F.max("lsn").alias("last_lsn"), F.count(F.lit(1)).alias("n"))


def reclaimable(parts: DataFrame, redo_point: int) -> DataFrame:
    """Segments whose next segment begins at or below the redo point; never the last. These are all before the last one that begins there."""
    holder = parts.where(F.col("first_lsn") <= redo_point).agg(F.max("segment").alias("_holder"))  # one row
    return parts.join(F.broadcast(holder)).where(F.col("segment") < F.col("_holder")).drop("_holder")
