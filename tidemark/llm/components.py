"""Connected components of an edge table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined on the map side) and an equality join that adaptive
execution can split, so a hub never meets in one task; each round is written to the shared folder.
Links never come to the driver: only their number and a checksum do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v), without nulls; returns (node, root), the least node of its component, for each node with an edge other than the roots themselves."""

    def digest(t: DataFrame) -> tuple:
        return tuple(t.agg(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())

    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = digest(now)
    while mark[0]:
        after = written(_small_star(_large_star(now)), "edges")
        seen = digest(after)
        release(now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
