"""Runs without gaps and chunks counted from the first time, for batch tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.operators.ordered import near_previous


def sessions(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap: float, slab: float = 86400.0) -> DataFrame:
    """(keys, run, n, t_first, t_last): runs whose steps are at most ``gap``; run counts from 1.

    Runs that start in a slab are numbered there and shifted by the starts in the slabs before it, so no key is one task.
    """
    time = order[0]
    stepped = near_previous(df.select(*keys, *order), keys, order, [time], gap, slab)
    begins = F.col("previous").isNull()
    marked = stepped.withColumns({"starts_": begins.cast("int"), "slab_": F.floor(F.col(time) / F.lit(slab))})
    counts = marked.groupBy(*keys, "slab_").agg(F.sum("starts_").alias("own_"))
    w = Window.partitionBy(*keys).orderBy("slab_").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, "slab_", F.coalesce(F.sum("own_").over(w), F.lit(0)).alias("shift_"))
    inside = Window.partitionBy(*keys, "slab_").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("in_", F.sum("starts_").over(inside)).join(shifts, [*keys, "slab_"])
    return numbered.groupBy(*keys, (F.col("in_") + F.col("shift_")).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("t_first"), F.max(time).alias("t_last"))


def anchored_chunks(series: DataFrame, seconds: float) -> DataFrame:
    """(baseline, chunk, n, mean): chunks of ``seconds`` from the first time of all."""
    first = series.agg(F.min("time_s").alias("anchor_"))
    placed = series.crossJoin(F.broadcast(first)).withColumn("chunk", F.floor((F.col("time_s") - F.col("anchor_")) / F.lit(seconds)).cast("long"))
    return placed.groupBy("baseline", "chunk").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
