"""Helpers that several operators share: column clashes, lineage cuts, the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeframe import session


#: Slabs of a running sum, at most.
MOST_SLABS = 1024


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared one."""
    return f"{session.shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there, so that lost executors cost no recomputation."""
    return session.held(df)


def attach(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with result columns; an input column of the same name in any case gives way to the result."""
    taken = {c.lower() for c in columns}
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in taken]
    return df.select(*kept, *(v.alias(k) for k, v in columns.items()))


def packed(names: Sequence[str]) -> Column:
    """Columns of any name as one, to pass through tasks that address columns by name; ``unpacked`` gives them back."""
    return F.struct(*(F.col(f"`{c}`") for c in names), *([] if names else [F.lit(0).alias("none")])).alias("row")


def unpacked(df: DataFrame, names: Sequence[str], results: Sequence[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in names), *results)


def free_name(df: DataFrame, wish: str) -> str:
    """A column name near ``wish`` that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, wish
    while name.lower() in taken:
        name += "_"
    return name


def running(df: DataFrame, order: Sequence[Column], sums: dict[str, Column], slab_rows: int = 100_000) -> DataFrame:
    """``df`` in ``order`` (which has no ties) with sums over all rows before each one, without a task that sees all rows.

    Rows fall into slabs of the order; each slab is summed alone, and only one row per slab, MOST_SLABS at most, is
    summed and broadcast as a whole. A table of one slab is one window.
    """
    slab = free_name(df, "slab__")
    slabs = max(1, min(MOST_SLABS, df.count() // slab_rows))
    if slabs == 1:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.select(*(f"`{c}`" for c in df.columns), *(F.coalesce(F.sum(v).over(before), F.lit(0)).alias(k) for k, v in sums.items()))
    names = {k: f"{slab}{k}" for k in sums}
    dealt = df.withColumns({names[k]: v for k, v in sums.items()}).repartitionByRange(slabs, *order)
    dealt = cut(dealt.withColumn(slab, F.spark_partition_id()))
    whole = Window.orderBy(slab).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(slab).agg(*(F.sum(n).alias(n) for n in names.values())).select(F.col(slab).alias(f"{slab}at"), *(F.coalesce(F.sum(n).over(whole), F.lit(0)).alias(f"{n}_base") for n in names.values()))
    inner = Window.partitionBy(slab).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = dealt.join(F.broadcast(bases), F.col(slab) == F.col(f"{slab}at"))
    return joined.select(*(f"`{c}`" for c in df.columns), *((F.col(f"{n}_base") + F.coalesce(F.sum(n).over(inner), F.lit(0))).alias(k) for k, n in names.items()))


def numbered(df: DataFrame, marks: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0 for a row whose ``marks`` no other row has, else its number, from 0, among the rows of equal marks.

    Which of them has which number is left open. Rows with marks of their own don't move. The others are written down with the task
    that holds them and numbered there, then shifted by what other tasks hold of the same marks, so that rows of
    which a third are equal are still many tasks.
    """
    again = cut(df.groupBy(*marks).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*marks))
    many = again.count()
    if not many:
        return df.withColumn(name, F.lit(0).cast("long"))
    part, rank = free_name(df, "part__"), free_name(df, "rank__")
    known = F.broadcast(again) if many <= MOST_SLABS else again
    same = lambda other: reduce(and_, (F.col(f"d.{m}").eqNullSafe(F.col(f"{other}.{m}")) for m in marks))
    once = df.alias("d").join(known.alias("a"), same("a"), "left_anti").withColumn(name, F.lit(0).cast("long"))
    twice = cut(df.alias("d").join(known.alias("a"), same("a"), "left_semi").withColumn(part, F.spark_partition_id()))
    held = twice.groupBy(*marks, part).agg(F.count(F.lit(1)).alias(rank))
    before = cut(held.select(*marks, part, F.coalesce(F.sum(rank).over(Window.partitionBy(*marks).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(rank)))
    inside = twice.withColumn(name, F.row_number().over(Window.partitionBy(*marks, part).orderBy(F.lit(0))))
    shifted = inside.alias("d").join(before.alias("b"), same("b") & (F.col(f"d.{part}") == F.col(f"b.{part}")))
    return once.unionByName(shifted.select(*(F.col(f"d.`{c}`") for c in df.columns), (F.col(f"d.{name}") - 1 + F.col(f"b.{rank}")).alias(name)))


def split_hot(rows: DataFrame, keys: Sequence[str], salt: str, limit: int) -> DataFrame:
    """Deal the rows of each key to units that one task can compare.

    A key of up to ``limit`` rows is one unit (part_a = part_b = 0). A larger one is cut by ``salt`` into
    parts of about ``limit`` rows, and each unordered pair of parts is a unit, so that every pair of rows
    meets in exactly one unit and no task holds more than two parts. Adds own (the row's part), part_a, part_b.
    """
    hot = cut(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key")).where(F.col("rows_of_key") > limit).select(*keys, F.ceil(F.col("rows_of_key") / limit).cast("int").alias("parts"))
    )
    dealt = rows.join(hot, list(keys), "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(F.col(salt), F.lit(17)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumns({"part_a": F.least("own", "other"), "part_b": F.greatest("own", "other")}).drop("parts", "other")
