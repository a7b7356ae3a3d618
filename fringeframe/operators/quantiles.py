"""Exact quantiles with bounded state: sketches bracket the ranks, values inside the brackets are counted and ranked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.session import held

#: Inverse of the sketch's rank error; a bracket is a few of these wide on either side.
ACCURACY, REACH = 10_000, 4
#: Values of a key up to which all of them are ranked: a sketch's reach is less than a rank there.
FEW = 10_000
#: Values of a key up to which one aggregation may hold all of them, and values in a bracket that one task puts in order.
BOUND = 1_000_000
#: Equal parts into which a bracket with more values is counted.
PARTS = 4096


def quantiles(df: DataFrame, value: Column, qs: Sequence[float], keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """(keys, n, q0, q1, ...): linearly interpolated quantiles of ``value`` where it is neither null nor NaN.

    A first pass gives each key's count and, from a sketch of fixed size, two values that enclose each wanted rank. A
    second pass counts what lies below and each distinct value between, map-side first; only that share of a key's
    distinct values (a thousandth, or up to FEW) is put in order, so no task holds a key's or the table's values. Where that share
    may exceed BOUND, the brackets are counted in PARTS first and narrowed to those that hold the ranks. Without keys
    and rows the counts are 0 and the quantiles null; keys without values give no row. ``most``: a number of values that no
    key exceeds, where the caller has counted; up to BOUND of them one aggregation gives the same.
    """
    rows = df.select(*keys, value.cast("double").alias("v_")).where("v_ is not null and not isnan(v_)")
    if most is not None and most <= BOUND:
        return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.percentile("v_", F.lit(float(q))).alias(f"q{k}") for k, q in enumerate(qs)))
    reach = REACH / ACCURACY
    ends = F.array(*(F.lit(float(x)) for q in qs for x in (max(q - reach, 0.0), min(q + reach, 1.0))))
    brackets = held(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_"), F.percentile_approx("v_", ends, ACCURACY).alias("p_"), F.min("v_").alias("low_"), F.max("v_").alias("high_")))
    low, high = (lambda k, s=s, end=end: F.when(F.col("n_") <= FEW, F.col(end)).otherwise(F.col("p_")[2 * k + s]) for s, end in ((0, "low_"), (1, "high_")))
    brackets = brackets.select(*keys, "n_", F.array(*(F.struct(low(k).alias("low"), high(k).alias("high")) for k in range(len(qs)))).alias("b_"))
    while (brackets.agg(F.max("n_")).first()[0] or 0) * 4 * reach > BOUND:
        brackets, reach = held(narrowed(rows, brackets, qs, keys)), reach / PARTS
    met = rows.join(brackets, list(keys)) if keys else rows.crossJoin(F.broadcast(brackets))  # one row
    low, high = (lambda k, end=end: F.col("b_")[k][end] for end in ("low", "high"))
    each = F.array(*(F.when(F.col("v_") <= high(k), F.struct(F.lit(k).alias("which_"), F.when(F.col("v_") >= low(k), F.col("v_")).alias("at_"))) for k in range(len(qs))))
    counted = met.select(*keys, F.explode(each).alias("e_")).where("e_ is not null").groupBy(*keys, "e_.which_", "e_.at_").agg(F.count(F.lit(1)).alias("c_"))
    order = Window.partitionBy(*keys, "which_").orderBy(F.col("at_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("through_", F.sum("c_").over(order))
    with_n = ranked.join(brackets.select(*keys, "n_"), list(keys)) if keys else ranked.crossJoin(F.broadcast(brackets.select(*keys, "n_")))
    rank = rank_of(qs)
    at = lambda r: F.min(F.when(F.col("at_").isNotNull() & (F.col("through_") > r), F.col("at_")))
    below = F.coalesce(F.max(F.when(F.col("at_").isNull(), F.col("through_"))), F.lit(0))
    placed = with_n.withColumn("r_", rank).groupBy(*keys, "which_").agg(F.first("r_").alias("r_"), at(F.floor("r_")).alias("x_"), at(F.ceil("r_")).alias("y_"), below.alias("below_"))
    inside = (F.col("below_") <= F.floor("r_")) & F.col("x_").isNotNull() & F.col("y_").isNotNull()
    part = F.col("r_") - F.floor("r_")
    found = F.when(inside, F.col("x_") * (1 - part) + F.col("y_") * part).otherwise(F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))
    wide = placed.withColumn("q_", found).groupBy(*keys).agg(*(F.max(F.when(F.col("which_") == k, F.col("q_"))).alias(f"q{k}") for k in range(len(qs))))
    counts = brackets.select(*keys, F.col("n_").alias("n"))
    return counts.join(wide, list(keys), "left") if keys else counts.crossJoin(F.broadcast(wide))


def rank_of(qs: Sequence[float]) -> Column:
    """The place, from 0, of quantile ``which_`` among ``n_`` values."""
    rank = F.element_at(F.array(*(F.lit(float(q)) for q in qs)), F.col("which_") + 1) * (F.col("n_") - 1)
    return F.when(F.abs(rank - F.rint(rank)) < 1e-9 * (rank + 1), F.rint(rank)).otherwise(rank)  # a whole rank stays whole


def narrowed(rows: DataFrame, brackets: DataFrame, qs: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """``brackets`` (keys, n_, b_) each cut down to the values of those of its PARTS that hold its ranks; PARTS numbers a bracket are put in order."""
    met = rows.join(brackets, list(keys)) if keys else rows.crossJoin(F.broadcast(brackets))  # one row
    v = F.col("v_")
    part = lambda b: F.when(v >= b["low"], F.when(b["high"] > b["low"], F.least(F.floor((v - b["low"]) / (b["high"] - b["low"]) * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0)))
    each = F.array(*(F.when(v <= F.col("b_")[k]["high"], F.struct(F.lit(k).alias("which_"), part(F.col("b_")[k]).alias("part_"))) for k in range(len(qs))))
    counted = met.select(*keys, "v_", F.explode(each).alias("e_")).where("e_ is not null").groupBy(*keys, "e_.which_", "e_.part_").agg(F.count(F.lit(1)).alias("c_"), F.min("v_").alias("least_"), F.max("v_").alias("most_"))
    order = Window.partitionBy(*keys, "which_").orderBy(F.col("part_").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("through_", F.sum("c_").over(order))
    ranked = ranked.join(brackets.select(*keys, "n_"), list(keys)) if keys else ranked.crossJoin(F.broadcast(brackets.select("n_")))
    first = lambda r, c: F.min(F.when(F.col("part_").isNotNull() & (F.col("through_") > r), F.struct("part_", c)))[c]
    ends = ranked.withColumn("r_", rank_of(qs)).groupBy(*keys, "which_").agg(first(F.floor("r_"), "least_").alias("low"), first(F.ceil("r_"), "most_").alias("high"))
    wide = ends.groupBy(*keys).agg(*(F.max(F.when(F.col("which_") == k, F.struct("low", "high"))).alias(f"new_{k}") for k in range(len(qs))))
    both = brackets.join(wide, list(keys), "left") if keys else brackets.crossJoin(F.broadcast(wide))
    new = F.array(*(F.struct(*(F.coalesce(F.col(f"new_{k}")[end], F.col("b_")[k][end]).alias(end) for end in ("low", "high"))) for k in range(len(qs))))
    return both.select(*keys, "n_", new.alias("b_"))
