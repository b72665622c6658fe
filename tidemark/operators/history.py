"""From a log of operations to versions, statuses and states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import following

#: Log positions for each piece of a key's history.
SPAN = 4_000_000


def operations(events: DataFrame, before: int | None = None) -> DataFrame:
    """(lsn, txn_id, k, op, v): the events as puts and deletes, four to a transaction; those of transactions below ``before`` by a filter that reaches the scan."""
    if before is not None:
        events = events.where(F.col("event_id") < 4 * (before - 1))
    return events.select(
        (F.col("event_id") + 1).alias("lsn"),
        (F.expr("event_id div 4") + 1).alias("txn_id"),
        F.col("user_id").alias("k"),
        F.when(F.col("event_type") == "error", "D").otherwise("P").alias("op"),
        F.col("value").alias("v"),
    )


def statuses(ops: DataFrame) -> DataFrame:
    """(txn_id, status): the last five are in flight, every seventh aborted, the others committed."""
    last = ops.agg(F.max("txn_id").alias("_last"))  # one row
    status = F.when(F.col("txn_id") > F.col("_last") - 5, "V").when(F.col("txn_id") % 7 == 3, "A").otherwise("C")
    return ops.select("txn_id").distinct().join(F.broadcast(last)).select("txn_id", status.alias("status"))


def versions(ops: DataFrame, clog: DataFrame, span: int = SPAN) -> DataFrame:
    """(k, v, lsn, xmin, xmax). A committed version ends at the key's next committed operation, deletes included; others stay open (an aborted deleter ends nothing)."""
    settled = ops.join(clog, "txn_id")
    committed = following(settled.where("status = 'C'"), "k", "lsn", "txn_id", span, "_next")
    closed = committed.where("op = 'P'").select("k", "v", "lsn", F.col("txn_id").alias("xmin"), F.coalesce("_next", F.lit(0)).cast("long").alias("xmax"))
    open_ = settled.where("status <> 'C' AND op = 'P'").select("k", "v", "lsn", F.col("txn_id").alias("xmin"), F.lit(0).cast("long").alias("xmax"))
    return closed.unionByName(open_)


def with_status(ops: DataFrame, last: int) -> DataFrame:
    """``ops`` with the ``status`` of their transactions, by the rule of ``statuses`` for a log whose last id is ``last``; no join."""
    status = F.when(F.col("txn_id") > last - 5, "V").when(F.col("txn_id") % 7 == 3, "A").otherwise("C")
    return ops.withColumn("status", status)


def settled_versions(ops: DataFrame, last_lsn: int | None = None, span: int = SPAN, unsettled: bool = True) -> DataFrame:
    """``versions`` of operations that carry their ``status``, with ``creator`` and ``deleter`` statuses: one pass, no joins with a status table. Without ``unsettled`` only those of committed creators."""
    committed = following(ops.where("status = 'C'"), "k", "lsn", "txn_id", span, "_next", last_lsn)
    closed = committed.where("op = 'P'").select("k", "v", "lsn", F.col("txn_id").alias("xmin"), F.coalesce("_next", F.lit(0)).cast("long").alias("xmax"), F.col("status").alias("creator"), F.when(F.col("_next").isNotNull(), "C").alias("deleter"))
    if not unsettled:
        return closed
    open_ = ops.where("status <> 'C' AND op = 'P'").select("k", "v", "lsn", F.col("txn_id").alias("xmin"), F.lit(0).cast("long").alias("xmax"), F.col("status").alias("creator"), F.lit(None).cast("string").alias("deleter"))
    return closed.unionByName(open_)


def not_committed(clog: DataFrame) -> DataFrame:
    return clog.where("status <> 'C'").select("txn_id")


def log_records(ops: DataFrame, clog: DataFrame) -> DataFrame:
    """(lsn, txn_id, rec_type, k, v): data records, and one record for each settled transaction."""
    at = (F.col("txn_id") - 1) * 5
    data = ops.select((at + (F.col("lsn") - 1) % 4 + 1).alias("lsn"), "txn_id", F.when(F.col("op") == "P", "Insert").otherwise("SetXMax").alias("rec_type"), "k", "v")
    ends = clog.where("status <> 'V'").select((at + 5).alias("lsn"), "txn_id", F.when(F.col("status") == "C", "Commit").otherwise("Abort").alias("rec_type"))
    return data.unionByName(ends, allowMissingColumns=True)


def latest(ops: DataFrame, is_delete: Column, key: str = "k", order: str = "lsn", value: str = "v") -> DataFrame:
    """(key, value, order) of the last operation on each key unless it is a delete: a grouped maximum, combined on the map side."""
    last = F.max_by(F.struct(F.col(value).alias("v"), F.col(order).alias("o"), is_delete.alias("d")), order).alias("_last")
    return ops.groupBy(key).agg(last).where(~F.col("_last.d")).select(key, F.col("_last.v").alias(value), F.col("_last.o").alias(order))
