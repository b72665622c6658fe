"""Set-based writes and conflict rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def accepted_inserts(intents: DataFrame, visible: DataFrame, key: str = "k") -> DataFrame:
    return intents.join(visible.select(key), key, "left_anti")


def duplicate_inserts(intents: DataFrame, visible: DataFrame, key: str = "k") -> DataFrame:
    return intents.join(visible.select(key), key, "left_semi")


def applied_updates(intents: DataFrame, visible: DataFrame, key: str = "k", value: str = "v") -> DataFrame:
    """(key, old value, new value) of the updates that find their key."""
    return intents.withColumnRenamed(value, "new_value").join(visible.select(key, F.col(value).alias("old_value")), key)


def missing_keys(intents: DataFrame, visible: DataFrame, key: str = "k") -> DataFrame:
    """Updates or deletes that end in KeyNotFound."""
    return intents.join(visible.select(key), key, "left_anti")


def applied_deletes(intents: DataFrame, visible: DataFrame, key: str = "k") -> DataFrame:
    return intents.join(visible.select(key), key, "left_semi")


def insert_outcomes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(outcome, n) of inserting all rows one after another: the first of each key goes in. Counts alone need no order within a key."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.count(F.lit(1)).alias("ok"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("dup"))
    pairs = F.array(F.struct(F.lit("ok").alias("outcome"), F.col("ok").alias("n")), F.struct(F.lit("DuplicateKey").alias("outcome"), F.col("dup").alias("n")))
    return found.select(F.explode(pairs).alias("x")).select("x.*")


def write_verdict(xmax: Column, status: Column, me: int | None = None) -> Column:
    """What a writer meets on a visible version: free, ended by one in flight, by one aborted, or by one committed."""
    free = xmax == 0
    if me is not None:
        free = free | (xmax == me)
    return F.when(free, "ok").when(status == "V", "WaitFor").when(status == "A", "ok").otherwise("WriteConflict")


def wait_or_die(me: Column, blocker: Column) -> Column:
    """An older transaction (smaller id) waits, a younger one dies."""
    return F.when(me > blocker, "die").otherwise("wait")


def claim_conflicts(claims: DataFrame, life: int) -> DataFrame:
    """Pairs of claims on one key of which the second comes while the first lives: (holder, me).

    A band join: pieces of ``life`` positions meet their own and the next piece only, so a hot key is spread over its pieces.
    """
    piece = F.floor(F.col("lsn") / life)
    holders = claims.select("k", F.col("tid").alias("holder"), F.col("lsn").alias("held_at"), F.explode(F.array(piece, piece + 1)).alias("_piece"))
    comers = claims.select("k", F.col("tid").alias("me"), F.col("lsn").alias("at"), piece.alias("_piece"))
    later = (F.col("at") > F.col("held_at")) & (F.col("at") <= F.col("held_at") + life) & (F.col("me") != F.col("holder"))
    return holders.join(comers, ["k", "_piece"]).where(later).select("holder", "me")
