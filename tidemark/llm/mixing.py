"""Mixing sources to target weights by subset-sum budget fitting.

1. Count documents by exact token length within each source.
2. Targets: weights by rank of the source, capped at twice its size, the excess dealt again.
3. For each source, take lengths in proportion, then fit what is left of the budget by a bounded
   knapsack over lengths (bitset dynamic programming).
4. Select that many documents of each length in seeded order.

Everything but step 4 works on the histogram. Seeded ranks come from counts by (source, length,
slot of the seeded hash) and a rank within the slot, so a hot length of a hot source is dealt over
``slots`` window groups and never meets in one task.

Null text has size 0. A null source is a source of its own and the last. Equal rows are separate
documents. An empty table gives an empty result. A document is taken 0, 1 or 2 times, whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE_RUN, SPACES, written

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def size_of(text: Column) -> Column:
    """Words of a text, null for none, without building the words."""
    trimmed = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " "))
    gaps = F.length(trimmed) - F.length(F.translate(trimmed, " ", ""))
    return F.when(F.length(trimmed) == 0, F.lit(0)).otherwise(gaps + 1).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(_s, source_size) for each source to the same with ``target``: the level at which min(cap, level * weight) fills the share.

    Works on one row for each source; ordering these is the one global step.
    """
    ranked = sizes.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_s").startswith("n"), "_s")) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("_r", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("_w", w).withColumn("_cap", F.col("source_size") * F.lit(float(cap)))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_r").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    ) / (F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    leveled = ranked.withColumn("_level", level)
    meets = F.col("_cap") >= F.col("_level") * F.col("_w")
    open_level = F.min(F.when(meets, F.struct(F.col("_cap") / F.col("_w"), "_r", "_level"))).over(whole)["_level"]
    filled = F.least(F.col("_cap"), F.coalesce(open_level, F.lit(float("inf"))) * F.col("_w"))
    return leveled.select("_s", "source_size", filled.alias("target"))


def fit_budget(lengths: list[int], counts: list[int], budget: int, window: int = 1 << 15) -> list[int]:
    """How many documents of each length to take so that the total comes as near below ``budget`` as can be found.

    Proportional shares first, then long lengths until about ``window`` words are left, then an exact bounded knapsack on those.
    """
    total = sum(a * b for a, b in zip(lengths, counts))
    if budget >= total:
        return list(counts)
    take = [c * budget // total if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(n * k for n, k in zip(lengths, take))
    order = [i for i in np.argsort(lengths)[::-1].tolist() if lengths[i] > 0]
    for i in order:
        n = lengths[i]
        k = max(0, min(counts[i] - take[i], left // n, -(-(left - window) // n)))
        take[i], left = take[i] + k, left - k * n
    # Bit s of ``reach`` says that s words can be met; steps keep what each part of a length adds.
    reach, steps, mask = 1, [], (1 << (left + 1)) - 1
    for i in reversed(order):
        n, free, k = lengths[i], min(counts[i] - take[i], left // lengths[i]), 1
        while free > 0 and not reach >> left & 1:
            k = min(k, free)
            more = (reach | reach << (k * n)) & mask
            if more != reach:
                steps.append((i, k, reach))
                reach = more
            free, k = free - k, k * 2
    at = reach.bit_length() - 1
    for i, k, was in reversed(steps):
        if not was >> at & 1:
            take[i], at = take[i] + k, at - k * lengths[i]
    return take


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    seed: int = 17,
    slots: int = 64,
    carry: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``, as the module says; with ``carry`` also the row itself as ``_row``."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")] if carry else []
    seeded = F.xxhash64(F.lit(seed), F.col("doc_id"))
    sized = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            size_of(F.col(text_col)).alias("size"),
            F.coalesce(F.concat(F.lit("v"), F.col(source_col).cast("string")), F.lit("n")).alias("_s"),
            *kept,
        ).select("*", seeded.alias("_x"), F.pmod(seeded, F.lit(slots)).alias("_slot")),
        "sizes",
    )
    slot_counts = sized.groupBy("_s", "size", "_slot").agg(F.count(F.lit(1)).alias("n"))
    histogram = slot_counts.groupBy("_s", "size").agg(F.sum("n").alias("n"))
    goals = written(targets(histogram.groupBy("_s").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), share), "targets")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size")
        size, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
        lengths, counts = group["size"].tolist(), group["n"].tolist()
        budget = int(round(target))
        base = int(target >= size)
        take = [base * n + k for n, k in zip(counts, fit_budget(lengths, counts, budget - base * size))]
        left = budget - sum(n * k for n, k in zip(lengths, take))
        if left > 0:  # second copies may fit where no document does
            more = fit_budget(lengths, [2 * n - k for n, k in zip(counts, take)], left)
            take = [k + m for k, m in zip(take, more)]
        return pd.DataFrame({"_s": group["_s"], "size": group["size"], "source_size": size, "target": target, "_n": counts, "_take": take})

    plan = histogram.join(goals, "_s").groupBy("_s").applyInPandas(fitted, "_s string, size long, source_size long, target double, _n long, _take long")
    plan = written(plan, "mix-plan")
    earlier = Window.partitionBy("_s", "size").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_counts.withColumn("_off", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(plan, ["_s", "size"]).drop("n")
    rank = F.row_number().over(Window.partitionBy("_s", "size", "_slot").orderBy("_x", "doc_id")) + F.col("_off")
    copies = (F.col("_rank") <= F.col("_take")).cast("long") + (F.col("_rank") <= F.col("_take") - F.col("_n")).cast("long")
    return (
        sized.join(offsets, ["_s", "size", "_slot"])
        .withColumn("_rank", rank)
        .select("doc_id", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), *(["_row"] if carry else []))
    )
