"""Running totals and neighbours without one global or one hot window.

Rows are dealt into ranges of the whole order (ties broken to the end, so a hot key is cut too) by bounds
from a sample; each range is summed on the map side, the totals of at most ``BUCKETS`` ranges are accumulated,
and windows run within ranges only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Rows that one window may hold without ranges; most ranges; sampled rows for each range.
SMALL = 10_000
BUCKETS = 4096
DRAWN = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def bucketed(df: DataFrame, order: list[str], name: str) -> DataFrame | None:
    """``df`` with the number of the range of ``order`` (nulls first) that a row falls in; None if one range will do."""
    if df.limit(SMALL + 1).count() <= SMALL:
        return None
    total = df.count()
    buckets = min(BUCKETS, max(2, total // SMALL))
    drawn = df.select(*order).sample(False, min(1.0, DRAWN * buckets / total), 7).limit(4 * DRAWN * buckets)
    rows = drawn.orderBy(*[F.col(c).asc_nulls_first() for c in order]).collect()  # at most a few MB
    bounds = [tuple(rows[len(rows) * i // buckets]) for i in range(1, buckets)] if rows else []
    if not bounds:
        return None
    kind = T.StructType([T.StructField("_bounds", T.ArrayType(drawn.schema))])
    at, step = F.lit(0), 1 << (len(bounds).bit_length() - 1)
    key = F.struct(*order)

    def moved(at: Column, step: int) -> Column:  # no second parameter in the lambda: ``transform`` would pass the index
        return let(at, lambda p: F.when(F.get("_bounds", p + (step - 1)) <= key, p + step).otherwise(p))

    while step:  # how many bounds are at or below the key, by bisection
        at = moved(at, step)
        step //= 2
    return df.join(F.broadcast(df.sparkSession.createDataFrame([(bounds,)], kind))).withColumn(name, at).drop("_bounds")


def running_sum(df: DataFrame, value: Column, order: list[str], name: str = "running") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows up to each in ``order`` (nulls first)."""
    rows = df.withColumn("_value", value)
    ordered = [F.col(c).asc_nulls_first() for c in order]
    dealt = bucketed(rows, order, "_bucket")
    if dealt is None:
        alone = Window.orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum("_value").over(alone).cast("long")).drop("_value")
    totals = dealt.groupBy("_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_bucket").orderBy(*ordered).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.join(offsets, "_bucket").withColumn(name, (F.col("_offset") + F.sum("_value").over(within)).cast("long")).drop("_bucket", "_value", "_offset")


def following(df: DataFrame, key: str, order: str, value: str, span: int, name: str, last: int | None = None) -> DataFrame:
    """``df`` with the ``value`` of the next row of the key in ``order`` (a number), null after the last.

    A key's rows are windowed in pieces of ``span`` order values; each piece also gets the first row of
    the key's next piece, so a key with a third of all rows is spread over many tasks. ``last``: the greatest order value, if known; one piece needs no guests.
    """
    if last is not None and last < span:
        return df.withColumn(name, F.lead(value).over(Window.partitionBy(key).orderBy(order)))
    rows = df.withColumn("_piece", F.floor(F.col(order) / span)).withColumn("_guest", F.lit(False))
    heads = rows.groupBy(key, "_piece").agg(F.min_by(F.struct(order, value), order).alias("_head"))
    earlier = F.lag("_piece").over(Window.partitionBy(key).orderBy("_piece"))
    guests = heads.withColumn("_piece", earlier).where(F.col("_piece").isNotNull()).select(key, "_piece", F.col("_head")[order].alias(order), F.col("_head")[value].alias(value), F.lit(True).alias("_guest"))
    window = Window.partitionBy(key, "_piece").orderBy(order)
    return rows.unionByName(guests, allowMissingColumns=True).withColumn(name, F.lead(value).over(window)).where(~F.col("_guest")).drop("_piece", "_guest")
