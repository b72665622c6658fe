"""Physical facts kept as statistics: how records would pack into leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import CHAIN_BYTES, footprint
from .running import running_sum


def footprints(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.withColumn("footprint", footprint(F.octet_length(key), F.octet_length(value)))


def packed(df: DataFrame, order: list[str], leaf_bytes: int = CHAIN_BYTES) -> DataFrame:
    """Rows with ``footprint`` to the same with ``leaf``, filling leaves in ``order``."""
    rows = running_sum(df, F.col("footprint"), order, "_end")
    return rows.withColumn("leaf", F.floor(F.col("_end") / leaf_bytes).cast("long")).drop("_end")


def leaves(rows: DataFrame, key: str) -> DataFrame:
    """(leaf, n, used, first_key)"""
    return rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum("footprint").cast("long").alias("used"), F.min(key).alias("first_key"))


def routed(keys: DataFrame, key: str, separators: DataFrame, separator: str, name: str = "child") -> DataFrame:
    """Each key with the number of separators at or below it, from one ordered pass over both, not a pairing of them. Rows of one key are told apart by their hash, so many of them are cut too."""
    seps = separators.select(F.col(separator).alias(key), F.lit(0).alias("_row"), F.lit(None).cast("long").alias("_tie"))
    both = keys.withColumn("_row", F.lit(1)).withColumn("_tie", F.xxhash64(*keys.columns)).unionByName(seps, allowMissingColumns=True)
    counted = running_sum(both, 1 - F.col("_row"), [key, "_row", "_tie"], name)
    return counted.where("_row = 1").drop("_row", "_tie")


def shard_histogram(df: DataFrame, key: str, shards: int = 8) -> DataFrame:
    return df.groupBy(F.pmod(F.col(key), F.lit(shards)).cast("long").alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def numbered(df: DataFrame, order: list[str], name: str = "rn") -> DataFrame:
    """Row numbers from 1 over all rows in ``order``."""
    return running_sum(df, F.lit(1), order, name)


def checkpoint_stalls(redo: DataFrame, every: int) -> DataFrame:
    """Checkpoints, one ``every`` so many positions, whose redo point is that of the one before."""
    before = redo.select((F.col("checkpoint") + every).alias("checkpoint"), F.col("redo_point").alias("_before"))
    return redo.join(before, "checkpoint", "left").withColumn("stalled", F.coalesce(F.col("_before") == F.col("redo_point"), F.lit(False))).drop("_before")
