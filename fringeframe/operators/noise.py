"""Noise from differences of neighbouring samples, per baseline, channel, chunk or everywhere."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.operators.ordered import near_previous, with_previous
from fringeframe.operators.quantiles import quantiles
from fringeframe.session import held
from fringeframe.sources.adapter import ROW_KEY

#: Differences that a baseline needs for a noise of its own, and values that a pooled cell needs.
LEAST_DIFFERENCES, LEAST_VALUES = 4, 8
#: A pair may be this many median steps apart.
GAP_STEPS = 3.0
#: Width of a slab of the time order, seconds.
SLAB = 30 * 86400.0
BASELINE = ("ant1", "ant2")


def max_gap(rows: DataFrame, steps: float = GAP_STEPS, slab: float = SLAB) -> DataFrame:
    """One row, max_gap: ``steps`` times the median positive step between distinct times, infinite for fewer than three times."""
    times = held(rows.select("time_s").where(F.col("time_s").isNotNull()).distinct())
    stepped = with_previous(times, [], ["time_s"], ["time_s"], slab)
    step = F.col("time_s") - F.col("previous.time_s")
    middle = quantiles(stepped, F.when(step > 0, step), [0.5], most=times.count())
    return middle.select(F.when(F.col("n") >= 2, F.lit(steps) * F.col("q0")).otherwise(F.lit(math.inf)).alias("max_gap"))


def usable(vis: DataFrame) -> DataFrame:
    """Values of flagged or non-finite samples as null: they break a chain of neighbours and are never bridged."""
    good = ~F.coalesce(F.col("flag"), F.lit(False)) & ~F.isnan("re") & ~F.isnan("im")
    return vis.withColumns({"re": F.when(good, F.col("re")), "im": F.when(good, F.col("im"))})


def adjacent_pairs(vis: DataFrame, keys: Sequence[str] = (*BASELINE, "chan"), order: Sequence[str] = ("time_s", *ROW_KEY), extra: Sequence[str] = (), slab: float = SLAB, gap: float | None = None) -> DataFrame:
    """Each sample with the one before it on its baseline: t0, t1, d_re, d_im, and ``extra`` of both as x0, x1.

    Pairs further apart than ``gap`` seconds go; unless given it is found first, by a job that gives one number. d_re and
    d_im are null where an end is unusable.
    """
    most = max_gap(vis, slab=slab).first()["max_gap"] if gap is None else gap
    values = usable(vis).select(*keys, *order, "re", "im", *extra)
    held_ = ["time_s", "re", "im", *extra]
    if most is None or math.isinf(most):  # too few times to tell what is near
        near = with_previous(values, keys, order, held_, slab).where("previous is not null")
    else:
        near = near_previous(values, keys, order, held_, most, slab).where("previous is not null")
    return near.select(
        *keys, F.col("previous.time_s").alias("t0"), F.col("time_s").alias("t1"), (F.col("re") - F.col("previous.re")).alias("d_re"), (F.col("im") - F.col("previous.im")).alias("d_im"), *(F.col(f"previous.{x}").alias(f"{x}0") for x in extra), *(F.col(x).alias(f"{x}1") for x in extra)
    )


def difference_sigma(column: str | Column) -> Column:
    """Population deviation of differences over the root of two."""
    return F.stddev_pop(column) / F.sqrt(F.lit(2.0))


def baseline_sigma(pairs: DataFrame, keys: Sequence[str] = BASELINE, least: int = LEAST_DIFFERENCES) -> DataFrame:
    """n, sig_re, sig_im of each key; null noise below ``least`` usable differences."""
    found = pairs.groupBy(*keys).agg(F.count("d_re").alias("n"), difference_sigma("d_re").alias("sig_re"), difference_sigma("d_im").alias("sig_im"))
    enough = F.col("n") >= least
    return found.withColumns({"sig_re": F.when(enough, F.col("sig_re")), "sig_im": F.when(enough, F.col("sig_im"))})


def pooled_sigma(pairs: DataFrame) -> DataFrame:
    """One row over all pairs, those of short baselines too."""
    return pairs.agg(F.count("d_re").alias("n"), difference_sigma("d_re").alias("sig_re"), difference_sigma("d_im").alias("sig_im"))


def grouped_sigma(pairs: DataFrame, groupings: Sequence[Sequence[str]]) -> DataFrame:
    """Several groupings in one sweep: rows of each, with grouping_id telling them apart."""
    columns = list(dict.fromkeys(c for g in groupings for c in g))
    # The pairs are summed once by all columns; only those sums meet each grouping.
    sums = moments_of(pairs, columns).groupingSets([[F.col(c) for c in g] for g in groupings], *columns).agg(F.grouping_id().cast("long").alias("grouping"), *(F.sum(c).alias(c) for c in MOMENTS))
    return sums.select(*columns, "grouping", "n", *(c.alias(k) for k, c in parts_of(sums).items()))


def moments_of(pairs: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """(keys, n, s_re, ss_re, s_im, ss_im): counts and sums of the differences, which add up to those of any coarser key."""
    square = lambda c: F.sum(F.col(c) * F.col(c))
    return pairs.groupBy(*keys).agg(F.count("d_re").alias("n"), F.sum("d_re").alias("s_re"), square("d_re").alias("ss_re"), F.sum("d_im").alias("s_im"), square("d_im").alias("ss_im"))


MOMENTS = ("n", "s_re", "ss_re", "s_im", "ss_im")


def rolled_up(moments: DataFrame, *keys: str) -> DataFrame:
    return moments.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in MOMENTS))


def spread(n: Column, s: Column, ss: Column) -> Column:
    """Noise of one sample from the count, sum and sum of squares of differences; what rounding leaves of no spread is 0."""
    square = ss / n
    rest = square - (s / n) * (s / n)
    return F.when(n > 0, F.sqrt(F.when(rest > 1e-12 * square, rest).otherwise(F.lit(0.0)) / 2.0))


def parts_of(moments: DataFrame, least: int = 1) -> dict[str, Column]:
    """sig_re and sig_im of rows of moments with ``least`` differences or more."""
    return {f"sig_{p}": F.when(F.col("n") >= least, spread(F.col("n"), F.col(f"s_{p}"), F.col(f"ss_{p}"))) for p in ("re", "im")}


def mapped(vis: DataFrame, own: DataFrame, pool_re: Column, pool_im: Column, keys: Sequence[str] = BASELINE) -> DataFrame:
    """Each sample with est_re, est_im: its key's noise where both parts are positive, else the pool's."""
    named = own.select(*keys, F.col("sig_re").alias("own_re"), F.col("sig_im").alias("own_im"))
    joined = vis.join(named, list(keys), "left")
    good = (F.col("own_re") > 0) & (F.col("own_im") > 0)
    return joined.withColumns({"est_re": F.when(good, F.col("own_re")).otherwise(pool_re), "est_im": F.when(good, F.col("own_im")).otherwise(pool_im)}).drop("own_re", "own_im")


def sigma_map(vis: DataFrame, pairs: DataFrame) -> DataFrame:
    """Each sample with the noise of its baseline, or the pool's where a part of that is missing or zero.

    One pass over the pairs leaves a row of moments per baseline, from which both come.
    """
    moments = held(moments_of(pairs, BASELINE))
    own = moments.select(*BASELINE, *(c.alias(k) for k, c in parts_of(moments, LEAST_DIFFERENCES).items()))
    pool = rolled_up(moments)
    level = pool.select(*(c.alias(k.replace("sig", "pool")) for k, c in parts_of(pool).items()))
    return mapped(vis.crossJoin(F.broadcast(level)), own, F.col("pool_re"), F.col("pool_im")).drop("pool_re", "pool_im")  # one row


def one_or_both(re: float | None, im: float | None) -> tuple[float, float]:
    """Both levels; where just one of them is a positive number, it is taken for both."""
    good = [x for x in (re, im) if x is not None and math.isfinite(x) and x > 0]
    if not good:
        raise ValueError("nothing to measure noise by: every sample is flagged, alone in time or not a number; pass a level instead")
    return tuple(x if x is not None and math.isfinite(x) and x > 0 else good[0] for x in (re, im))


def scatter(vis: DataFrame) -> tuple[float | None, float | None]:
    """Robust noise of the real and imaginary parts themselves, sky and all."""
    rows = usable(vis)
    return tuple(robust_sigma(rows, p).first()["sigma"] for p in ("re", "im"))


def estimated_sigma(vis: DataFrame, per_channel: bool = False, slab: float = SLAB) -> DataFrame:
    """``sigma_map`` that always finds a level: est_re and est_im of every sample.

    Where the gap leaves no usable real differences they are taken again without a gap; where there are still none,
    the pool is the robust scatter of the data; one usable part stands in for the other; with neither it refuses.
    The branch is taken by a job that gives one row.
    """
    keys = (*BASELINE, "chan") if per_channel else BASELINE
    gap = max_gap(vis, slab=slab).first()["max_gap"]
    level: dict[str, float | None] = {}
    for most in dict.fromkeys((gap, math.inf)):
        moments = held(moments_of(adjacent_pairs(vis, slab=slab, gap=most), keys))
        pool = rolled_up(moments)
        level = pool.select(*(c.alias(k) for k, c in parts_of(pool).items())).first().asDict()
        if level["sig_re"]:
            break
    if not level["sig_re"] and not level["sig_im"]:
        level = dict(zip(("sig_re", "sig_im"), scatter(vis), strict=True))
    re, im = one_or_both(level["sig_re"], level["sig_im"])
    own = moments.select(*keys, *(c.alias(k) for k, c in parts_of(moments, LEAST_DIFFERENCES).items()))
    return mapped(vis, own, F.lit(re), F.lit(im), keys)


def constant_sigma(series: DataFrame, order: Sequence[str], value: str = "value", slab: float = 86400.0) -> DataFrame:
    """One noise from consecutive rows, without baselines or gaps."""
    stepped = with_previous(series.select(*order, value), [], list(order), [value], slab)
    d = F.col(value) - F.col(f"previous.{value}")
    return stepped.select(d.alias("d")).agg(F.count("d").alias("n"), difference_sigma("d").alias("sigma"))


def constant_level(vis: DataFrame, order: Sequence[str] = ("time_s", *ROW_KEY), slab: float = SLAB) -> tuple[float, float]:
    """(real, imaginary) noise of rows without baselines: from consecutive rows, or from the scatter where differences are too few or none is positive."""
    rows = usable(vis)
    found = [constant_sigma(rows, order, p, slab).first() for p in ("re", "im")]
    level = [r["sigma"] if r["n"] >= LEAST_DIFFERENCES else None for r in found]
    return one_or_both(*(level if any(level) else scatter(vis)))


def robust_sigma(df: DataFrame, value: str, keys: Sequence[str] = (), most: int | None = None) -> DataFrame:
    """1.4826 times the median distance from the median of finite values; null for fewer than two. ``most``: values that no key exceeds, where that is known."""
    finite = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    middle = quantiles(finite, F.col(value), [0.5], keys, most).select(*keys, F.col("q0").alias("middle_"))
    middle = middle if most is not None else held(middle)
    joined = finite.join(middle, list(keys)) if keys else finite.crossJoin(F.broadcast(middle))
    off = quantiles(joined, F.abs(F.col(value) - F.col("middle_")), [0.5], keys, most)
    return off.select(*keys, "n", F.when(F.col("n") >= 2, F.lit(1.4826) * F.col("q0")).alias("sigma"))


def relative_scale(vis: DataFrame, relative: Column) -> DataFrame:
    """k_re, k_im: what relative noises are multiplied by. Differences come first, whitening after."""
    marked = vis.withColumn("rel_", F.when(~F.coalesce(F.col("flag"), F.lit(False)), relative))
    pairs = adjacent_pairs(marked, extra=("rel_",))
    whole = F.sqrt((F.col("rel_0") * F.col("rel_0") + F.col("rel_1") * F.col("rel_1")) / 2.0)
    return pairs.select((F.col("d_re") / whole).alias("w_re"), (F.col("d_im") / whole).alias("w_im")).agg(F.count("w_re").alias("n"), difference_sigma("w_re").alias("k_re"), difference_sigma("w_im").alias("k_im"))


def time_bins(df: DataFrame, time: str, bins: int) -> DataFrame:
    """``df`` with bin_: equal widths from the first to the last time, the last one closed."""
    span = df.agg(F.min(time).alias("first_"), F.max(time).alias("last_"))
    placed = df.crossJoin(F.broadcast(span))
    part = F.floor((F.col(time) - F.col("first_")) / F.when(F.col("last_") > F.col("first_"), (F.col("last_") - F.col("first_")) / F.lit(float(bins))).otherwise(F.lit(1.0)))
    return placed.withColumn("bin_", F.least(part, F.lit(bins - 1))).drop("first_", "last_")


def time_variation(pairs: DataFrame, bins: int = 8) -> DataFrame:
    """n and noise of the real part in each bin of the pairs' first times."""
    return time_bins(pairs.where("d_re is not null"), "t0", bins).groupBy(F.col("bin_").cast("long").alias("bin")).agg(F.count("d_re").alias("n"), difference_sigma("d_re").alias("sigma"))


def time_variation_ratio(vis: DataFrame, pairs: DataFrame, bins: int = 3) -> DataFrame:
    """One row: how many of equal blocks of the track have a noise, and the largest over the smallest of those.

    Blocks run from the first to the last time of ``vis``; one counts from LEAST_DIFFERENCES differences on, and the
    ratio needs two.
    """
    span = vis.agg(F.min("time_s").alias("first_"), F.max("time_s").alias("last_"))
    placed = pairs.where("d_re is not null").crossJoin(F.broadcast(span)).where("last_ > first_")  # one row
    block = F.greatest(F.least(F.floor((F.col("t0") - F.col("first_")) / ((F.col("last_") - F.col("first_")) / F.lit(float(bins)))), F.lit(bins - 1)), F.lit(0))
    levels = placed.groupBy(block.alias("block")).agg(F.count("d_re").alias("n"), difference_sigma("d_re").alias("sigma")).where((F.col("n") >= LEAST_DIFFERENCES) & (F.col("sigma") > 0))
    return levels.agg(F.count(F.lit(1)).alias("blocks"), F.when(F.count(F.lit(1)) >= 2, F.max("sigma") / F.min("sigma")).alias("ratio"))


def time_profile(vis: DataFrame, relative: Column) -> DataFrame:
    """(time_s, profile): how the claimed noise varies in time, mean square 1 over distinct times.

    Per baseline and time the mean square over usable channels, divided by its baseline's mean (two rows at least), averaged over
    baselines, missing times filled with the median, root taken. The table per baseline and time and the one per time are
    written once.
    """
    square = vis.groupBy(*BASELINE, "time_s").agg(F.avg(F.when(~F.coalesce(F.col("flag"), F.lit(False)), relative * relative)).alias("sq"))
    square = held(square)
    own = square.where("sq is not null").groupBy(*BASELINE).agg(F.avg("sq").alias("mean_sq"), F.count(F.lit(1)).alias("rows_")).where("rows_ >= 2")
    shape = square.join(own, list(BASELINE), "left").groupBy("time_s").agg(F.avg(F.col("sq") / F.col("mean_sq")).alias("p"))
    shape = held(shape)
    middle = quantiles(shape, F.col("p"), [0.5], most=shape.count()).select(F.col("q0").alias("mid"))
    level = shape.crossJoin(F.broadcast(middle)).withColumn("p", F.coalesce("p", "mid")).drop("mid")  # one row
    mean = level.agg(F.avg("p").alias("mean_p"))
    return level.crossJoin(F.broadcast(mean)).select("time_s", F.sqrt(F.col("p") / F.col("mean_p")).alias("profile"))


def hybrid_sigma(vis: DataFrame, pairs: DataFrame, relative: Column) -> DataFrame:
    """Samples with hyb_re, hyb_im: the baseline's level times the profile of its time."""
    return sigma_map(vis, pairs).join(time_profile(vis, relative), "time_s").withColumns({"hyb_re": F.col("est_re") * F.col("profile"), "hyb_im": F.col("est_im") * F.col("profile")})


def repaired(vis: DataFrame, columns: Sequence[str] = ("sig_re", "sig_im")) -> DataFrame:
    """``vis`` where a noise that is missing, not finite or not above zero is the median of the good ones of its part among live samples.

    Medians are exact and one row, which goes to every task. Without a good one a bad one fails the job; where all are good nothing changes.
    """
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < math.inf) & (F.col(c) > 0)
    live = vis.where(~F.coalesce(F.col("flag"), F.lit(False))) if "flag" in vis.columns else vis
    middle = None
    for k, c in enumerate(columns):
        own = quantiles(live, F.when(good(c), F.col(c)), [0.5]).select(F.col("q0").alias(f"middle_{k}_"))
        middle = own if middle is None else middle.crossJoin(own)  # a row each
    met = vis.crossJoin(F.broadcast(middle))
    put = {c: F.when(good(c), F.col(c)).otherwise(F.coalesce(F.col(f"middle_{k}_"), F.raise_error(F.lit(f"no sample has a usable {c}")).cast("double"))) for k, c in enumerate(columns)}
    return met.withColumns(put).select(vis.columns)


def weight_disagreement(vis: DataFrame, pairs: DataFrame, relative: Column) -> DataFrame:
    """One row: mean of measured over claimed noise on the shortest and on the longest quarter of the rows, and their ratio.

    A row is a window's baseline at a time with its place; its ratio is the mean over its channels whose both noises are positive. Rows without
    such a channel or a baseline length don't count; fewer than LEAST_VALUES rows give nulls.
    """
    length, row = F.sqrt(F.col("u_m") * F.col("u_m") + F.col("v_m") * F.col("v_m")), ("spw", "ant1", "ant2", "time_s", "u_m", "v_m")
    rows = sigma_map(vis, pairs).where(~F.coalesce(F.col("flag"), F.lit(False))).select(*row, (F.col("est_re") / relative).alias("ratio"), length.alias("length"))
    rows = rows.where("ratio > 0 and length > 0").groupBy(*row).agg(F.avg("ratio").alias("ratio"), F.first("length").alias("length"))
    rows = held(rows)
    ends = quantiles(rows, F.col("length"), [0.25, 0.75]).select(F.col("q0").alias("low"), F.col("q1").alias("high"))
    found = rows.crossJoin(F.broadcast(ends)).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("length") <= F.col("low"), F.col("ratio"))).alias("short_ratio"), F.avg(F.when(F.col("length") >= F.col("high"), F.col("ratio"))).alias("long_ratio"))
    enough = F.col("n") >= LEAST_VALUES
    return found.select("n", F.when(enough, F.col("short_ratio")).alias("short_ratio"), F.when(enough, F.col("long_ratio")).alias("long_ratio"), F.when(enough, F.col("long_ratio") / F.col("short_ratio")).alias("ratio"))


def chunk_sigma(vis: DataFrame, pairs: DataFrame, chunk_seconds: float) -> DataFrame:
    """(ant1, ant2, chunk, n, sigma, own): noise of each cell, real and imaginary differences pooled about their joint mean.

    Chunks count from the first time; pairs across two of them count for the whole track only. A cell of fewer than
    LEAST_VALUES values takes its baseline's (or the pool's) noise times the chunk's level relative to all levels.
    One pass over the pairs leaves a row of moments per baseline and chunk; everything else is rolled up from those.
    """
    first, last_time = vis.agg(F.min("time_s"), F.max("time_s")).first()
    first = first if first is not None else 0.0
    last = max(math.ceil(((last_time if last_time is not None else first) - first) / chunk_seconds) - 1, 0)
    chunk = lambda t: F.least(F.floor((F.col(t) - F.lit(first)) / F.lit(float(chunk_seconds))), F.lit(last)).cast("long")
    inside = F.when(chunk("t0") == chunk("t1"), chunk("t0"))
    moments = held(moments_of(pairs.withColumn("chunk", inside), (*BASELINE, "chunk")))
    both = moments.select(*BASELINE, "chunk", (2 * F.col("n")).alias("n"), (F.col("s_re") + F.col("s_im")).alias("s"), (F.col("ss_re") + F.col("ss_im")).alias("ss"))
    add = lambda df, *keys: df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss")))
    level = spread(F.col("n"), F.col("s"), F.col("ss"))
    cells = both.where("chunk is not null")
    levels = add(cells, "chunk").where(F.col("n") >= LEAST_VALUES).select("chunk", level.alias("level"))
    mean = levels.agg(F.sqrt(F.avg(F.col("level") * F.col("level"))).alias("root"))
    shape = levels.crossJoin(F.broadcast(mean)).select("chunk", (F.col("level") / F.col("root")).alias("g"))
    whole = add(both, *BASELINE).select(*BASELINE, F.when(F.col("n") >= 2 * LEAST_DIFFERENCES, level).alias("own_whole"))
    pool = add(both).select(level.alias("pool"))
    joined = cells.withColumn("cell", level).join(shape, "chunk", "left").join(whole, list(BASELINE), "left").crossJoin(F.broadcast(pool))
    enough = (F.col("n") >= LEAST_VALUES) & (F.col("cell") > 0)
    fallback = F.coalesce(F.when(F.col("own_whole") > 0, F.col("own_whole")), F.col("pool")) * F.coalesce("g", F.lit(1.0))
    return joined.select(*BASELINE, "chunk", "n", F.when(enough, F.col("cell")).otherwise(fallback).alias("sigma"), F.coalesce(enough, F.lit(False)).alias("own"))
