"""Neighbours in time without one task per key: the order is cut into slabs that are sorted apart and stitched."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], slab: float, name: str = "previous") -> DataFrame:
    """``df`` with a struct of the previous row's ``values`` in ``order`` within ``keys``; null for the first row.

    order[0] is a number. Rows are partitioned by key and floor(order[0] / slab), so a key with a third of all rows is many
    tasks; the first row of a slab gets the last row of the slab before it from a table of one row per slab.
    """
    cut = df.withColumn("slab_", F.floor(F.col(order[0]) / F.lit(float(slab))))
    packed = F.struct(*values)
    inside = Window.partitionBy(*keys, "slab_").orderBy(*order)
    marked = cut.withColumns({"own_": F.lag(packed).over(inside), "turn_": F.row_number().over(inside)})
    lasts = cut.groupBy(*keys, "slab_").agg(F.max_by(packed, F.struct(*order)).alias("last_"))
    before = lasts.select(*keys, "slab_", F.lag("last_").over(Window.partitionBy(*keys).orderBy("slab_")).alias("edge_"))
    same = F.col("m.slab_") == F.col("b.slab_")
    for k in keys:
        same = same & F.col(f"m.{k}").eqNullSafe(F.col(f"b.{k}"))
    joined = marked.alias("m").join(before.alias("b"), same & (F.col("m.turn_") == 1), "left")
    return joined.select(*(F.col(f"m.{c}") for c in df.columns), F.when(F.col("m.turn_") == 1, F.col("b.edge_")).otherwise(F.col("m.own_")).alias(name))


def near_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], gap: float, slab: float, name: str = "previous") -> DataFrame:
    """``with_previous`` where a previous row more than ``gap`` (of order[0]) away counts as none; df is read once and nothing is joined.

    A row goes to its slab, and to the next one too if a row there could be within ``gap`` of it; each slab then holds all that its rows can look
    back to, and the rows that were sent ahead go again. About gap / slab of the rows are sent twice.
    """
    slab, time = max(float(slab), float(gap)), F.col(order[0])
    own, ahead = F.floor(time / F.lit(slab)), F.floor((time + F.lit(float(gap))) / F.lit(slab))
    placed = df.withColumn("own_slab_", own).withColumn("slab_", F.explode(F.when(ahead > own, F.array(own, own + 1)).otherwise(F.array(own))))
    before = F.lag(F.struct(*values, time.alias("time_of_"))).over(Window.partitionBy(*keys, "slab_").orderBy(*order))
    met = placed.withColumn("before_", before).where("slab_ = own_slab_")
    near = F.when(time - F.col("before_.time_of_") <= F.lit(float(gap)), F.struct(*(F.col(f"before_.{v}").alias(v) for v in values)))
    return met.select(*(F.col(f"`{c}`") for c in df.columns), near.alias(name))
