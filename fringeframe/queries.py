"""The registered queries: each operator on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.functions import sky
from fringeframe.operators import imaging, matrix, noise, regions, selection
from fringeframe.operators.quantiles import quantiles
from fringeframe.session import held
from fringeframe.sources.adapter import FREQUENCY_SQL, ROW_KEY, SERIES_SQL, VIS_SQL, frequency, series, table, visibilities

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Image side and field of the registered images, chunk of the registered noise cells, thinning, dish in metres.
SIDE, FOV, CHUNK, ONE_IN, DISH = 16, 0.3, 5.184e7, 7, 12.0
KEY = ", ".join(ROW_KEY)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can express it, its oracle."""

    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def rounded(df: DataFrame, digits: int = 8, **other: int) -> DataFrame:
    """Doubles rounded, so that the order of sums doesn't show."""
    return df.select(*(F.round(F.col(c), other.get(c, digits)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.cross_correlations(visibilities(spark, sf_dir))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.samples(cross(spark, sf_dir), frequency())


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise.adjacent_pairs(cross(spark, sf_dir))


def sized_pixels(spark: SparkSession) -> DataFrame:
    return imaging.pixels(spark, SIDE, FOV)


def image(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imaging.dirty_image(points(spark, sf_dir), SIDE, FOV)


C = sky.LIGHT
STEP = FOV / SIDE
UV_SQL = f"(u_m * f / {C!r}) u, (-v_m * f / {C!r}) v"
CROSS_SQL = VIS_SQL + f", crossed as (select *, {FREQUENCY_SQL} f from vis where ant1 <> ant2)"
POINTS_SQL = CROSS_SQL + f", points as (select spw, chan, {KEY}, {UV_SQL}, re, im, sig_re, sig_im, 1e0 / (5e-1 * (sig_re * sig_re + sig_im * sig_im)) w from crossed where not flag)"
GAP_SQL = CROSS_SQL + ", steps as (select time_s - lag(time_s) over (order by time_s) step from (select distinct time_s from crossed)), gap as (select 3e0 * quantile_cont(step, 5e-1) max_gap from steps where step > 0)"
PAIRS_SQL = (
    GAP_SQL
    + f""", chained as (
  select ant1, ant2, chan, lag(time_s) over w t0, time_s t1, r - lag(r) over w d_re, i - lag(i) over w d_im, rel rel1, lag(rel) over w rel0
  from (select *, case when not flag then re end r, case when not flag then im end i, case when not flag then 1e0 / sqrt(weight) end rel from crossed)
  window w as (partition by ant1, ant2, chan order by time_s, {KEY})
), pairs as (select chained.* from chained, gap where t0 is not null and t1 - t0 <= max_gap)"""
)
BASE_SQL = PAIRS_SQL + ", base as (select ant1, ant2, count(d_re) n, case when count(d_re) >= 4 then stddev_pop(d_re) / sqrt(2e0) end sig_re, case when count(d_re) >= 4 then stddev_pop(d_im) / sqrt(2e0) end sig_im from pairs group by all), pool as (select count(d_re) n, stddev_pop(d_re) / sqrt(2e0) p_re, stddev_pop(d_im) / sqrt(2e0) p_im from pairs)"
MAP_SQL = BASE_SQL + ", mapped as (select c.*, case when b.sig_re > 0 and b.sig_im > 0 then b.sig_re else p_re end est_re, case when b.sig_re > 0 and b.sig_im > 0 then b.sig_im else p_im end est_im from crossed c left join base b using (ant1, ant2), pool)"
PROFILE_SQL = """, sq as (select ant1, ant2, time_s, avg(1e0 / weight) sq from crossed where not flag group by all),
 own as (select ant1, ant2, avg(sq) m from sq group by all having count(*) >= 2),
 shape as (select time_s, avg(sq / m) p from sq join own using (ant1, ant2) group by all),
 filled as (select time_s, coalesce(p, (select quantile_cont(p, 5e-1) from shape)) p from (select distinct time_s from crossed) left join shape using (time_s)),
 profile as (select time_s, sqrt(p / (select avg(p) from filled)) profile from filled)"""
GRID_SQL = f"grid as (select cast(id // {SIDE} as integer) pix_y, cast(id % {SIDE} as integer) pix_x, (id % {SIDE} - {(SIDE - 1) / 2}) * {STEP!r} x_as, -(id // {SIDE} - {(SIDE - 1) / 2}) * {STEP!r} y_as from range({SIDE * SIDE}) t(id))"
TURN = f"{2 * math.pi * sky.ARCSEC!r} * (u * -x_as + v * y_as)"
IMAGE_SQL = POINTS_SQL + ", " + GRID_SQL + f", image as (select pix_y, pix_x, any_value(x_as) x_as, any_value(y_as) y_as, sum(w * (re * cos({TURN}) - im * sin({TURN}))) / sum(w) dirty, sum(w * cos({TURN})) / sum(w) beam from points, grid group by pix_y, pix_x)"


# --- selection ---------------------------------------------------------------------------------------------------------


@query("q_rows_selected", f"with {CROSS_SQL} select ant1, ant2, spw, chan, count(*) n from crossed group by all")
def rows_selected(spark, sf_dir):
    return cross(spark, sf_dir).groupBy("ant1", "ant2", "spw", "chan").agg(F.count(F.lit(1)).alias("n"))


@query("q_flatten_uv", f"with {POINTS_SQL} select spw, chan, {KEY}, round(u, 6) u, round(v, 6) v, re, round(im, 8) im from points")
def flatten_uv(spark, sf_dir):
    flat = selection.flattened(cross(spark, sf_dir), frequency())
    return flat.select("spw", "chan", *ROW_KEY, F.round("u", 6).alias("u"), F.round("v", 6).alias("v"), "re", F.round("im", 8).alias("im"))


@query("q_channel_rank", f"with {CROSS_SQL} select spw, chan, f freq_hz, row_number() over (order by f, spw, chan) rank from (select distinct spw, chan, f from crossed)")
def channel_rank(spark, sf_dir):
    return selection.channel_rank(cross(spark, sf_dir), frequency())


@query("q_channel_spacing", f"with {CROSS_SQL}, steps as (select spw, f - lag(f) over (partition by spw order by f) step from (select distinct spw, chan, f from crossed)) select spw, count(step) steps, max(step) - min(step) <= 1e-6 * max(step) even from steps group by spw")
def channel_spacing(spark, sf_dir):
    return selection.even_spacing(selection.channel_rank(cross(spark, sf_dir), frequency()))


@query("q_validate_noise", f"with {VIS_SQL} select spw, count(*) n, count(*) filter (not flag) n_live, count(*) filter (not flag and (sig_re <= 0 or sig_im <= 0)) bad_noise, count(*) filter (u_m is null or v_m is null) bad_place from vis group by spw")
def validate_noise(spark, sf_dir):
    return selection.invalid_samples(visibilities(spark, sf_dir))


@query(
    "q_stokes_i",
    f"with {VIS_SQL}, sums as (select ok, chan, sum(case when flag then 0e0 else weight end) sw, sum(case when not flag then weight * re end) r, sum(case when not flag then weight * im end) i from vis group by all) select ok, chan, case when sw > 0 then round(r / sw + 17e-11, 8) end re, case when sw > 0 then round(i / sw + 17e-11, 8) end im, case when sw > 0 then round(1e0 / sqrt(sw), 8) end rel_sigma, not sw > 0 flag from sums",
)
def stokes_i(spark, sf_dir):
    found = selection.stokes_i(visibilities(spark, sf_dir), ("ok", "chan"))
    # Means of a few decimals often end in an exact 5; the shift keeps rounding off such ties.
    return rounded(found.withColumns({"re": F.col("re") + 17e-11, "im": F.col("im") + 17e-11}))


@query("q_pooled_noise", f"with {POINTS_SQL} select spw, chan, count(*) n, round(avg(sqrt((sig_re * sig_re + sig_im * sig_im) / 2e0)), 8) sigma from points group by all")
def pooled_noise(spark, sf_dir):
    pooled = selection.with_pooled_noise(points(spark, sf_dir))
    return rounded(pooled.groupBy("spw", "chan").agg(F.count(F.lit(1)).alias("n"), F.avg("sig_re").alias("sigma")))


@query("q_noise_asymmetry", f"with {POINTS_SQL} select spw, round(quantile_cont(abs(sig_re - sig_im) / (5e-1 * (sig_re + sig_im)), 5e-1), 8) asymmetry from points where sig_re > 0 and sig_im > 0 group by spw")
def noise_asymmetry(spark, sf_dir):
    return rounded(selection.noise_asymmetry(cross(spark, sf_dir)))


@query("q_phase_shift", f"with {POINTS_SQL}, turned as (select *, {2 * math.pi * sky.ARCSEC!r} * (u * 5e-2 + v * -3e-2) t from points) select spw, chan, {KEY}, round(re * cos(t) - im * sin(t), 7) re, round(re * sin(t) + im * cos(t), 7) im from turned")
def phase_shift(spark, sf_dir):
    moved = selection.recentred(selection.flattened(cross(spark, sf_dir), frequency()), 0.05, -0.03)
    return rounded(moved.select("spw", "chan", *ROW_KEY, F.round("re", 7).alias("re"), F.round("im", 7).alias("im")), px=2)


@query("q_thin_hash", f"with {VIS_SQL} select {KEY}, re from vis where (ok * 7919 + ln * 104729 + pk * 1299709 + sk * 15485863) % {ONE_IN} = 0")
def thin_hash(spark, sf_dir):
    return selection.thinned(visibilities(spark, sf_dir), ONE_IN).select(*ROW_KEY, "re")


@query("q_row_keep", f"with {VIS_SQL} select spw, ok, ln, count(*) n, round(max(sqrt(u_m * u_m + v_m * v_m)), 8) length_m, not bool_and(flag) keep from vis group by all")
def row_keep(spark, sf_dir):
    return rounded(selection.kept_rows(visibilities(spark, sf_dir), ("spw", "ok", "ln")))


@query(
    "q_baseline_percentile",
    f"with {VIS_SQL}, top as (select spw, max({FREQUENCY_SQL}) f from vis group by spw), kept as (select spw, ok, ln, max(sqrt(u_m * u_m + v_m * v_m)) l, not bool_and(flag) keep from vis group by all) select count(*) filter (keep) rows_kept, round(quantile_cont(l * f / {C!r}, 95e-2) filter (keep), 4) b_percentile, round(max(l * f / {C!r}), 4) b_max from kept join top using (spw)",
)
def baseline_percentile(spark, sf_dir):
    return rounded(selection.baseline_percentile(visibilities(spark, sf_dir), frequency(), ("ok", "ln")), 4)


@query(
    "q_bandwidth",
    f"with {VIS_SQL}, live as (select spw, count(*) filter (not flag) n_samples from vis group by spw), ch as (select distinct spw, {FREQUENCY_SQL} f from vis) select spw, avg(f) central_hz, round((max(f) - min(f)) / ((max(f) + min(f)) / 2e0), 10) fractional_bandwidth, any_value(n_samples) n_samples from ch join live using (spw) group by spw",
)
def bandwidth(spark, sf_dir):
    return rounded(selection.band(visibilities(spark, sf_dir), frequency()), 10)


BINS_SQL = POINTS_SQL + ", binned as (select cast(least(floor(q / (select max(sqrt(u * u + v * v)) from points) * 24), 23) as bigint) bin, avg(q) q, avg(amp) amplitude, count(*) n from (select sqrt(u * u + v * v) q, sqrt(re * re + im * im) amp from points) group by 1)"


@query("q_amplitude_bins", f"with {BINS_SQL} select bin, round(q, 4) q, round(amplitude, 8) amplitude, n from binned")
def amplitude_bins(spark, sf_dir):
    return rounded(selection.amplitude_bins(points(spark, sf_dir), 24), q=4)


@query(
    "q_visibility_null",
    f"with {BINS_SQL}, around as (select *, lag(amplitude) over (order by bin) l, lead(amplitude) over (order by bin) r from binned), low as (select bin, q from around where amplitude <= l and amplitude <= r order by bin limit 1) select bin, round(q, 4) q, round({3.8317 / (2 * math.pi) * 648000.0 / math.pi!r} / q, 8) radius_arcsec from (select max(bin) bin, max(q) q from low)",
)
def visibility_null(spark, sf_dir):
    return rounded(selection.first_null(selection.amplitude_bins(points(spark, sf_dir), 24)), q=4)


@query(
    "q_shortest_baselines",
    f"""with {POINTS_SQL}, lengths as (select re, sqrt(u * u + v * v) q from points), k as (select greatest(8, count(*) // 50) k from lengths),
 ordered as (select q, row_number() over (order by q) r from lengths), edge as (select q e from ordered, k where r = k)
 select any_value(k) n, round((coalesce(sum(re) filter (q < e), 0e0) + (any_value(k) - count(*) filter (q < e)) * avg(re) filter (q = e)) / any_value(k), 8) mean_re, round(max(e), 4) q_max from lengths, k, edge""",
)
def shortest_baselines(spark, sf_dir):
    return rounded(selection.shortest(selection.flattened(cross(spark, sf_dir), frequency())), q_max=4)


# --- noise -------------------------------------------------------------------------------------------------------------


@query("q_max_gap", f"with {GAP_SQL} select max_gap from gap")
def max_gap(spark, sf_dir):
    return noise.max_gap(cross(spark, sf_dir))


@query("q_adjacent_pairs", f"with {PAIRS_SQL} select ant1, ant2, chan, t0, t1, round(d_re, 8) d_re, round(d_im, 8) d_im from pairs")
def adjacent_pairs(spark, sf_dir):
    return rounded(pairs(spark, sf_dir))


@query("q_baseline_sigma", f"with {BASE_SQL} select ant1, ant2, n, round(sig_re, 8) sig_re, round(sig_im, 8) sig_im from base")
def baseline_sigma(spark, sf_dir):
    return rounded(noise.baseline_sigma(pairs(spark, sf_dir)))


@query("q_baseline_sigma_per_channel", f"with {PAIRS_SQL} select ant1, ant2, chan, count(d_re) n, case when count(d_re) >= 4 then round(stddev_pop(d_re) / sqrt(2e0), 8) end sig_re, case when count(d_re) >= 4 then round(stddev_pop(d_im) / sqrt(2e0), 8) end sig_im from pairs group by all")
def baseline_sigma_per_channel(spark, sf_dir):
    return rounded(noise.baseline_sigma(pairs(spark, sf_dir), ("ant1", "ant2", "chan")))


@query("q_pool_sigma", f"with {BASE_SQL} select n, round(p_re, 8) sig_re, round(p_im, 8) sig_im from pool")
def pool_sigma(spark, sf_dir):
    return rounded(noise.pooled_sigma(pairs(spark, sf_dir)))


@query("q_grouped_std", f"with {PAIRS_SQL} select ant1, ant2, chan, cast(grouping(ant1, ant2, chan) as bigint) grouping, count(d_re) n, round(stddev_pop(d_re) / sqrt(2e0), 8) sig_re, round(stddev_pop(d_im) / sqrt(2e0), 8) sig_im from pairs group by grouping sets ((ant1, ant2), (chan), ())")
def grouped_std(spark, sf_dir):
    return rounded(noise.grouped_sigma(pairs(spark, sf_dir), [("ant1", "ant2"), ("chan",), ()]).select("ant1", "ant2", "chan", "grouping", "n", "sig_re", "sig_im"))


@query("q_sigma_map", f"with {MAP_SQL} select {KEY}, round(est_re, 8) est_re, round(est_im, 8) est_im from mapped")
def sigma_map(spark, sf_dir):
    return rounded(noise.sigma_map(cross(spark, sf_dir), pairs(spark, sf_dir)).select(*ROW_KEY, "est_re", "est_im"))


@query("q_sigma_constant", f"with {SERIES_SQL}, d as (select value - lag(value) over (order by time_s, event_id) d from series) select count(d) n, round(stddev_pop(d) / sqrt(2e0), 8) sigma from d")
def sigma_constant(spark, sf_dir):
    return rounded(noise.constant_sigma(series(spark, sf_dir), ("time_s", "event_id")))


@query("q_mad_sigma", f"with {SERIES_SQL} select baseline, count(value) n, round(14826e-4 * mad(value), 8) sigma from series group by all")
def mad_sigma(spark, sf_dir):
    return rounded(noise.robust_sigma(series(spark, sf_dir), "value", ("baseline",)))


@query("q_scale_relative", f"with {PAIRS_SQL}, w as (select d_re / sqrt((rel0 * rel0 + rel1 * rel1) / 2e0) a, d_im / sqrt((rel0 * rel0 + rel1 * rel1) / 2e0) b from pairs) select count(a) n, round(stddev_pop(a) / sqrt(2e0), 8) k_re, round(stddev_pop(b) / sqrt(2e0), 8) k_im from w")
def scale_relative(spark, sf_dir):
    return rounded(noise.relative_scale(cross(spark, sf_dir), F.lit(1.0) / F.sqrt("weight")))


@query(
    "q_time_variation",
    f"with {PAIRS_SQL}, p as (select t0, d_re from pairs where d_re is not null), s as (select min(t0) a, max(t0) b from p) select cast(least(floor((t0 - a) / case when b > a then (b - a) / 8e0 else 1e0 end), 7) as bigint) bin, count(d_re) n, round(stddev_pop(d_re) / sqrt(2e0), 8) sigma from p, s group by 1",
)
def time_variation(spark, sf_dir):
    return rounded(noise.time_variation(pairs(spark, sf_dir)))


@query("q_time_profile", f"with {CROSS_SQL}{PROFILE_SQL} select time_s, round(profile, 8) profile from profile")
def time_profile(spark, sf_dir):
    return rounded(noise.time_profile(cross(spark, sf_dir), F.lit(1.0) / F.sqrt("weight")))


@query("q_hybrid_sigma", f"with {MAP_SQL}{PROFILE_SQL} select {KEY}, round(est_re * profile, 8) hyb_re, round(est_im * profile, 8) hyb_im from mapped join profile using (time_s)")
def hybrid_sigma(spark, sf_dir):
    return rounded(noise.hybrid_sigma(cross(spark, sf_dir), pairs(spark, sf_dir), F.lit(1.0) / F.sqrt("weight")).select(*ROW_KEY, "hyb_re", "hyb_im"))


@query(
    "q_baseline_disagreement",
    f"with {MAP_SQL}, r as (select avg(est_re * sqrt(weight)) ratio, sqrt(u_m * u_m + v_m * v_m) l from mapped where not flag and est_re > 0 and u_m * u_m + v_m * v_m > 0 group by spw, ant1, ant2, time_s, u_m, v_m), e as (select quantile_cont(l, 25e-2) lo, quantile_cont(l, 75e-2) hi from r), m as (select count(*) n, avg(ratio) filter (l <= lo) s, avg(ratio) filter (l >= hi) g from r, e) select n, case when n >= 8 then round(s, 8) end short_ratio, case when n >= 8 then round(g, 8) end long_ratio, case when n >= 8 then round(g / s, 8) end ratio from m",
)
def baseline_disagreement(spark, sf_dir):
    return rounded(noise.weight_disagreement(cross(spark, sf_dir), pairs(spark, sf_dir), F.lit(1.0) / F.sqrt("weight")))


@query(
    "q_sigma_chunks",
    f"""with {PAIRS_SQL}, span as (select min(time_s) a, greatest(ceil((max(time_s) - min(time_s)) / {CHUNK!r}) - 1, 0) l from crossed),
 cut as (select *, least(floor((t0 - a) / {CHUNK!r}), l) c0, least(floor((t1 - a) / {CHUNK!r}), l) c1 from pairs, span),
 val as (select ant1, ant2, cast(c0 as bigint) chunk, d_re d from cut where c0 = c1 union all select ant1, ant2, cast(c0 as bigint), d_im from cut where c0 = c1),
 cells as (select ant1, ant2, chunk, count(d) n, stddev_pop(d) / sqrt(2e0) cell from val group by all),
 lev as (select chunk, stddev_pop(d) / sqrt(2e0) level from val group by all having count(d) >= 8),
 shape as (select chunk, level / (select sqrt(avg(level * level)) from lev) g from lev),
 track as (select ant1, ant2, d_re d from pairs union all select ant1, ant2, d_im from pairs),
 whole as (select ant1, ant2, case when count(d) >= 8 then stddev_pop(d) / sqrt(2e0) end o from track group by all)
 select ant1, ant2, chunk, n, round(case when n >= 8 and cell > 0 then cell else coalesce(case when o > 0 then o end, (select stddev_pop(d) / sqrt(2e0) from track)) * coalesce(g, 1e0) end, 8) sigma, n >= 8 and cell > 0 own
 from cells left join shape using (chunk) left join whole using (ant1, ant2)""",
)
def sigma_chunks(spark, sf_dir):
    return rounded(noise.chunk_sigma(cross(spark, sf_dir), pairs(spark, sf_dir), CHUNK))


#: Each baseline's first sample alone: nothing to take differences of.
FIRST_SQL = CROSS_SQL + f", single as (select * from (select *, row_number() over (partition by ant1, ant2 order by time_s, {KEY}) turn from crossed where not flag) where turn = 1)"


def single_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = cross(spark, sf_dir).where("not flag")
    key = F.struct("time_s", *ROW_KEY)
    return live.groupBy("ant1", "ant2").agg(F.min_by(F.struct(*(c for c in live.columns if c not in ("ant1", "ant2"))), key).alias("s")).select("ant1", "ant2", "s.*")


@query("q_sigma_scatter", f"with {FIRST_SQL} select {KEY}, round((select 14826e-4 * mad(re) from single), 8) est_re, round((select 14826e-4 * mad(im) from single), 8) est_im from single")
def sigma_scatter(spark, sf_dir):
    """One integration per baseline: the noise falls back to the scatter of the data."""
    return rounded(noise.estimated_sigma(held(single_samples(spark, sf_dir))).select(*ROW_KEY, "est_re", "est_im"))


#: A baseline for each user, and times a day apart wherever an hour holds several: hardly a step is within the gap.
SPARSE_SQL = SERIES_SQL + """, sparse as (select event_id, user_id % 3 ant1, 5 + user_id % 2 ant2, floor(time_s / 864e2) * 864e2 + case when event_id % 50 = 0 then 1e0 else 0e0 end time_s, value re, value * value im from series),
 near as (select time_s - lag(time_s) over (order by time_s) step from (select distinct time_s from sparse)), gap as (select 3e0 * quantile_cont(step, 5e-1) g from near where step > 0),
 chained as (select ant1, ant2, lag(time_s) over w t0, time_s t1, re - lag(re) over w d_re, im - lag(im) over w d_im from sparse window w as (partition by ant1, ant2 order by time_s, event_id)),
 kept as (select chained.* from chained, gap where t1 - t0 <= g),
 base as (select ant1, ant2, case when count(*) >= 4 then stddev_pop(d_re) / sqrt(2e0) end s_re, case when count(*) >= 4 then stddev_pop(d_im) / sqrt(2e0) end s_im from kept group by all),
 pool as (select stddev_pop(d_re) / sqrt(2e0) p_re, stddev_pop(d_im) / sqrt(2e0) p_im from kept)"""


@query("q_sigma_fallback", f"with {SPARSE_SQL} select ant1, ant2, count(*) n, round(any_value(case when s_re > 0 and s_im > 0 then s_re else p_re end), 6) est_re, round(any_value(case when s_re > 0 and s_im > 0 then s_im else p_im end), 6) est_im from sparse left join base using (ant1, ant2), pool group by all")
def sigma_fallback(spark, sf_dir):
    """The whole ladder on the events: baselines without differences of their own take the pool's level."""
    day = F.floor(F.col("time_s") / 86400.0) * 86400.0 + F.when(F.col("event_id") % 50 == 0, 1.0).otherwise(0.0)
    sparse = series(spark, sf_dir).select((F.col("user_id") % 3).alias("ant1"), (5 + F.col("user_id") % 2).alias("ant2"), F.lit(0).alias("chan"), day.alias("time_s"), F.col("event_id").alias("ok"), *(F.lit(0).alias(k) for k in ROW_KEY[1:]), F.col("value").alias("re"), (F.col("value") * F.col("value")).alias("im"), F.lit(False).alias("flag"))
    found = noise.estimated_sigma(sparse, slab=7 * 86400.0)
    return rounded(found.groupBy("ant1", "ant2").agg(F.count(F.lit(1)).alias("n"), F.max("est_re").alias("est_re"), F.max("est_im").alias("est_im")), 6)


@query(
    "q_time_variation_ratio",
    f"with {PAIRS_SQL}, s as (select min(time_s) a, max(time_s) b from crossed), lev as (select greatest(least(floor((t0 - a) / ((b - a) / 3e0)), 2), 0) block, count(d_re) n, stddev_pop(d_re) / sqrt(2e0) sigma from pairs, s where d_re is not null group by 1) select count(*) blocks, case when count(*) >= 2 then round(max(sigma) / min(sigma), 8) end ratio from lev where n >= 4 and sigma > 0",
)
def time_variation_ratio(spark, sf_dir):
    return rounded(noise.time_variation_ratio(cross(spark, sf_dir), pairs(spark, sf_dir)))


# --- images and terms ----------------------------------------------------------------------------------------------------


@query("q_dirty_image", f"with {IMAGE_SQL} select pix_y, pix_x, round(dirty, 8) dirty from image")
def dirty_image(spark, sf_dir):
    return rounded(image(spark, sf_dir).select("pix_y", "pix_x", "dirty"))


@query("q_dirty_beam", f"with {IMAGE_SQL} select pix_y, pix_x, round(beam, 8) beam from image")
def dirty_beam(spark, sf_dir):
    return rounded(image(spark, sf_dir).select("pix_y", "pix_x", "beam"))


@query(
    "q_wtilde_kernel",
    f"with {POINTS_SQL}, lags as (select cast(id // {2 * SIDE} - {SIDE} as integer) lag_y, cast(id % {2 * SIDE} - {SIDE} as integer) lag_x from range({4 * SIDE * SIDE}) t(id)) select lag_y, lag_x, round(sum(w * cos({2 * math.pi * sky.ARCSEC!r} * (u * -lag_x * {STEP!r} + v * -lag_y * {STEP!r}))), 2) kernel from points, lags group by all",
)
def wtilde_kernel(spark, sf_dir):
    return rounded(imaging.kernel(points(spark, sf_dir), SIDE, FOV), 2)


TERMS = "count(*) n_vis, round(sum(w), 4) sum_w, round(sum(re * re / (sig_re * sig_re) + im * im / (sig_im * sig_im)), 4) data_term, round(sum(ln(%r * sig_re * sig_re) + ln(%r * sig_im * sig_im)), 4) noise_norm" % (2 * math.pi, 2 * math.pi)


@query("q_chi2_constants", f"with {POINTS_SQL} select {TERMS} from points")
def chi2_constants(spark, sf_dir):
    return rounded(imaging.scalar_terms(points(spark, sf_dir)), 4)


@query("q_channel_terms", f"with {POINTS_SQL} select spw, chan, {TERMS} from points group by all")
def channel_terms(spark, sf_dir):
    return rounded(imaging.scalar_terms(points(spark, sf_dir), ("spw", "chan")), 4)


@query("q_channel_terms_merged", f"with {POINTS_SQL} select {TERMS} from points")
def channel_terms_merged(spark, sf_dir):
    return rounded(imaging.combine(imaging.scalar_terms(points(spark, sf_dir), ("spw", "chan"))), 4)


CHANNEL_IMAGE_SQL = POINTS_SQL + ", " + GRID_SQL + f", channel_image as (select spw, chan, pix_y, pix_x, sum(w * (re * cos({TURN}) - im * sin({TURN}))) dirty, sum(re / (sig_re * sig_re) * cos({TURN}) - im / (sig_im * sig_im) * sin({TURN})) as data from points, grid group by all)"


@query("q_channel_images", f"with {CHANNEL_IMAGE_SQL} select spw, chan, pix_y, pix_x, round(dirty, 4) dirty, round(data, 4) as data from channel_image")
def channel_images(spark, sf_dir):
    """Kernel, images and scalars of every channel in one scan; the two images are shown."""
    long = imaging.terms(points(spark, sf_dir), SIDE, FOV, ("spw", "chan"))
    shown = long.where("plane in ('dirty', 'data')").groupBy("spw", "chan", "pix_y", "pix_x").agg(*(F.sum(F.when(F.col("plane") == p, F.col("value"))).alias(p) for p in ("dirty", "data")))
    return rounded(shown, 4)


@query("q_channel_images_added", f"with {CHANNEL_IMAGE_SQL} select pix_y, pix_x, round(sum(dirty), 4) dirty, round(sum(data), 4) as data from channel_image group by all")
def channel_images_added(spark, sf_dir):
    """The continuum as the sum of the channels' terms."""
    whole = imaging.added_terms(imaging.terms(points(spark, sf_dir), SIDE, FOV, ("spw", "chan"))).where("plane in ('dirty', 'data')")
    return rounded(whole.groupBy("pix_y", "pix_x").agg(*(F.sum(F.when(F.col("plane") == p, F.col("value"))).alias(p) for p in ("dirty", "data"))), 4)


@query(
    "q_matched_filter",
    f"with {IMAGE_SQL}, placed as (select {2 * math.pi * sky.ARCSEC!r} * (u * -5e-2 + v * -3e-2) t, u, v, w, re, im from points), own as (select sum(w) c, sum(w * (re * cos(t) - im * sin(t))) / sum(w) a from placed), sums as (select pix_y, pix_x, sum(w * (re * cos({TURN}) - im * sin({TURN}))) d, sum(w * cos({TURN} - t)) b from placed, grid group by all) select pix_y, pix_x, case when c - b * b / c > 1e-9 * c then round((d - b * a) / (c - b * b / c), 6) end amplitude, case when c - b * b / c > 1e-9 * c then round(abs(d - b * a) / sqrt(c - b * b / c), 4) end significance from sums, own",
)
def matched_filter(spark, sf_dir):
    """A further point's flux and significance at every pixel, beside one that is accepted."""
    from fringeframe.plans.pointfit import Component, scan

    return rounded(scan(points(spark, sf_dir), [Component(0.05, -0.03)], SIDE, FOV), 6, significance=4)


WIDE, WIDE_FOV = 32, 3.0
WIDE_SQL = POINTS_SQL + f", {GRID_SQL.replace(f'{SIDE * SIDE})', f'{WIDE * WIDE})').replace(f'// {SIDE}', f'// {WIDE}').replace(f'% {SIDE}', f'% {WIDE}').replace(str((SIDE - 1) / 2), str((WIDE - 1) / 2)).replace(repr(STEP), repr(WIDE_FOV / WIDE))}, wide as (select pix_y, pix_x, any_value(x_as) x_as, any_value(y_as) y_as, sum(w * (re * cos({TURN}) - im * sin({TURN}))) / sum(w) dirty, 1e0 / sqrt(sum(w)) rms from points, grid group by pix_y, pix_x)"


@query("q_wide_field_peak", f"with {WIDE_SQL} select round(x_as, 6) x_as, round(y_as, 6) y_as, round(dirty / rms, 4) significance from wide order by dirty desc, pix_y, pix_x limit 1")
def wide_field_peak(spark, sf_dir):
    """Where the emission is in a field much wider than the one to be imaged, and how many rms it stands out."""
    from fringeframe.plans.pointfit import scan

    found = scan(points(spark, sf_dir), [], WIDE, WIDE_FOV).join(imaging.pixels(spark, WIDE, WIDE_FOV), ["pix_y", "pix_x"])
    top = found.orderBy(F.col("amplitude").desc(), "pix_y", "pix_x").limit(1)
    return rounded(top.select(F.round("x_as", 6).alias("x_as"), F.round("y_as", 6).alias("y_as"), F.round("significance", 4).alias("significance")))


@query(
    "q_injection_difference",
    f"with {IMAGE_SQL}, t as (select u, v, w, {2 * math.pi * sky.ARCSEC!r} * (u * -5e-2 + v * 2e-2) t from points) select pix_y, pix_x, round(sum(w * 3e-1 * (cos(t) * cos({TURN}) + sin(t) * sin({TURN}))) / sum(w), 8) difference from t, grid group by all",
)
def injection_difference(spark, sf_dir):
    """A point put into the data: image with less image without."""
    from fringeframe.plans.pointfit import Component, residual

    given = points(spark, sf_dir)
    with_point = residual(given, [Component(0.05, 0.02, -0.3)])
    return rounded(regions.image_difference(imaging.dirty_image(with_point, SIDE, FOV), imaging.dirty_image(given, SIDE, FOV), "dirty"))


@query("q_peak_top1", f"with {IMAGE_SQL} select pix_y, pix_x, round(dirty, 8) peak from image order by dirty desc, pix_y, pix_x limit 1")
def peak_top1(spark, sf_dir):
    return rounded(regions.peak(image(spark, sf_dir), "dirty"))


def located(spark, sf_dir):
    return image(spark, sf_dir).join(sized_pixels(spark), ["pix_y", "pix_x"])


@query(
    "q_peaks_excluded",
    f"with {IMAGE_SQL}, top as (select x_as cx, y_as cy from image order by dirty desc, pix_y, pix_x limit 1), apart as (select image.* from image, top where not ((x_as - cx) ** 2 + (y_as - cy) ** 2 <= 25e-4)) select pix_y, pix_x, round(dirty, 8) peak from apart order by dirty desc, pix_y, pix_x limit 1",
)
def peaks_excluded(spark, sf_dir):
    pixels = located(spark, sf_dir)
    top = pixels.orderBy(F.col("dirty").desc(), "pix_y", "pix_x").limit(1)
    return rounded(regions.peak(regions.excluding(pixels, top, 0.05), "dirty"))


@query(
    "q_envelope_moment",
    f"with {IMAGE_SQL}, top as (select dirty t, x_as cx, y_as cy from image order by dirty desc, pix_y, pix_x limit 1), s as (select count(*) n, sum(dirty * ((x_as - cx) ** 2 + (y_as - cy) ** 2)) / sum(dirty) / 2e0 r from image, top where dirty > greatest(1e-3, 2e-1 * t)) select n, round(cx, 7) x_as, round(cy, 7) y_as, round(least(case when n >= 4 then greatest(sqrt(greatest(r, 0e0)), 1e-2) else 1e-2 end, 12e-2), 7) sigma_as from s, top",
)
def envelope_moment(spark, sf_dir):
    return rounded(regions.envelope(located(spark, sf_dir), "dirty", 2e-4, floor=1e-2, most=0.12), 7)


@query("q_ring_average", f"with {IMAGE_SQL} select cast(round_even(sqrt((pix_y - 75e-1) ** 2 + (pix_x - 75e-1) ** 2), 0) as bigint) ring, count(*) n, round(avg(beam), 8) mean from image group by 1")
def ring_average(spark, sf_dir):
    return rounded(regions.ring_average(image(spark, sf_dir), "beam", SIDE))


@query(
    "q_block_contrast",
    f"with {IMAGE_SQL}, b as (select (max(beam) - min(beam)) / nullif(avg(beam), 0e0) c from image group by pix_y // 4, pix_x // 4) select count(*) blocks, round(quantile_cont(c, 5e-1), 6) contrast from b",
)
def block_contrast(spark, sf_dir):
    return rounded(regions.block_contrast(image(spark, sf_dir), "beam", 4), 6)


@query("q_structure_ratio", f"with {IMAGE_SQL} select count(*) n, round(stddev_pop(dirty / 1e-3) / {math.sqrt(1.2)!r}, 6) ratio from image")
def structure_ratio(spark, sf_dir):
    return rounded(regions.structure_ratio(image(spark, sf_dir), "dirty", 1e-3, 1.2), 6)


@query(
    "q_sliding_smooth",
    f"""with {IMAGE_SQL}, o as (select a dy, b dx from range(-1, 2) y(a), range(-1, 2) x(b)),
 high as (select i.pix_y, i.pix_x, max(j.dirty) m from image i, o join image j on j.pix_y = least(greatest(i.pix_y + dy, 0), {SIDE - 1}) and j.pix_x = least(greatest(i.pix_x + dx, 0), {SIDE - 1}) group by all)
 select i.pix_y, i.pix_x, round(avg(j.m), 8) smooth from high i, o join high j on j.pix_y = least(greatest(i.pix_y + dy, 0), {SIDE - 1}) and j.pix_x = least(greatest(i.pix_x + dx, 0), {SIDE - 1}) group by all""",
)
def sliding_smooth(spark, sf_dir):
    return rounded(regions.sliding(image(spark, sf_dir), "dirty", 3, SIDE))


FWHM = f"({1.13 * C / DISH / sky.ARCSEC!r} / f)"


@query(
    "q_primary_beam_correct",
    f"with {VIS_SQL}, {GRID_SQL.replace(repr(STEP), '1e1')}, ch as (select distinct spw, chan, {FREQUENCY_SQL} f from vis) select spw, chan, pix_y, pix_x, round(p, 8) pb, case when p >= 1e-1 then round(1e0 / p, 6) end gain from (select *, exp(-(x_as * x_as + y_as * y_as) / (2e0 * ({FWHM} / {2 * math.sqrt(2 * math.log(2))!r}) * ({FWHM} / {2 * math.sqrt(2 * math.log(2))!r}))) p from ch, grid)",
)
def primary_beam_correct(spark, sf_dir):
    channels = visibilities(spark, sf_dir).select("spw", "chan").distinct().withColumn("f", frequency())
    grid = imaging.pixels(spark, SIDE, 10.0 * SIDE)  # a pixel grid, of fixed size
    beam = sky.primary_beam(F.col("x_as"), F.col("y_as"), sky.primary_beam_fwhm(F.col("f"), DISH))
    made = channels.crossJoin(F.broadcast(grid)).withColumn("pb", beam)
    return rounded(made.select("spw", "chan", "pix_y", "pix_x", "pb", F.round(sky.corrected(F.lit(1.0), F.col("pb")), 6).alias("gain")))


@query(
    "q_component_visibilities",
    f"with {POINTS_SQL}, m as (select *, {2 * math.pi * sky.ARCSEC!r} * (u * 2e-2 + v * 4e-2) t, exp({-2 * math.pi**2 * sky.ARCSEC**2!r} * (25e-4 * (v * {math.cos(0.5)!r} - u * {math.sin(0.5)!r}) ** 2 + 9e-4 * (u * {math.cos(0.5)!r} + v * {math.sin(0.5)!r}) ** 2)) g from points) select spw, chan, {KEY}, round(g * cos(t), 7) re, round(-g * sin(t), 7) im from m",
)
def component_visibilities(spark, sf_dir):
    flat = selection.flattened(cross(spark, sf_dir), frequency())
    turn = sky.phase(F.col("u"), F.col("v"), F.lit(0.02), F.lit(0.04))
    taper = sky.gaussian_taper(F.col("u"), F.col("v"), 0.05, 0.03, 0.5)
    return flat.select("spw", "chan", *ROW_KEY, F.round(taper * F.cos(turn), 7).alias("re"), F.round(-taper * F.sin(turn), 7).alias("im"))


@query(
    "q_binned_misfit",
    f"with {POINTS_SQL}, r as (select sqrt(u * u + v * v) q, 5e-1 * ((re - 3e-1) ** 2 / (sig_re * sig_re) + im * im / (sig_im * sig_im)) m from points), t as (select max(q) t from r) select cast(least(floor(q / t * 10), 9) as bigint) bin, count(*) n, round(avg(m), 4) misfit, round(1e0 / sqrt(count(*)), 8) error from r, t group by 1",
)
def binned_misfit(spark, sf_dir):
    rows = points(spark, sf_dir).select(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("q"), (0.5 * (F.pow(F.col("re") - 0.3, 2) / (F.col("sig_re") * F.col("sig_re")) + F.col("im") * F.col("im") / (F.col("sig_im") * F.col("sig_im")))).alias("m"))
    top = rows.agg(F.max("q").alias("t"))
    placed = rows.crossJoin(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.col("q") / F.col("t") * 10), F.lit(9)).cast("long"))
    return rounded(placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("misfit"), (F.lit(1.0) / F.sqrt(F.count(F.lit(1)))).alias("error")), misfit=4)


# --- matrices, cubes, sets, dimensions -------------------------------------------------------------------------------------


@query("q_gram_matrix", "with a as (select i, j, sum(cast(embedding[i + 1] as double) * cast(embedding[j + 1] as double)) f from embeddings, range(64) x(i), range(64) y(j) where i <= j group by all) select cast(i as integer) i, cast(j as integer) j, round(f, 6) f from a")
def gram_matrix(spark, sf_dir):
    return rounded(matrix.gram_of_arrays(table(spark, sf_dir, "embeddings"), "embedding"), 6)


MESH = 6
MAPPING_SQL = f"""{GRID_SQL}, placed as (select pix_y, pix_x, greatest(least((pix_y + 5e-1) * {MESH / SIDE!r} - 5e-1, {MESH - 1.0!r}), 0e0) my, greatest(least((pix_x + 5e-1) * {MESH / SIDE!r} - 5e-1, {MESH - 1.0!r}), 0e0) mx from grid),
 base as (select *, least(floor(my), {MESH - 2}) y0, least(floor(mx), {MESH - 2}) x0 from placed),
 mapping as (select pix_y, pix_x, cast((y0 + dy) * {MESH} + x0 + dx as bigint) mesh_id, (case when dy = 0 then 1 - (my - y0) else my - y0 end) * (case when dx = 0 then 1 - (mx - x0) else mx - x0 end) weight from base, range(2) a(dy), range(2) b(dx))"""


@query("q_mapping_apply", f"with {MAPPING_SQL}, mesh as (select vec_id % {MESH * MESH} mesh_id, sum(list_sum(list_transform(embedding, lambda x: cast(x as double)))) value from embeddings group by 1) select pix_y, pix_x, round(sum(weight * value), 6) value from mapping join mesh using (mesh_id) where weight > 0 group by all")
def mapping_apply(spark, sf_dir):
    mesh = table(spark, sf_dir, "embeddings").groupBy((F.col("vec_id") % (MESH * MESH)).alias("mesh_id")).agg(F.sum(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))).alias("value"))
    return rounded(regions.apply_mapping(regions.bilinear_mapping(sized_pixels(spark), MESH, SIDE), mesh), 6)


@query("q_mapping_transpose", f"with {IMAGE_SQL}, {MAPPING_SQL.replace(GRID_SQL + ',', '')} select mesh_id, round(sum(weight * beam), 7) value from mapping join image using (pix_y, pix_x) where weight > 0 group by all")
def mapping_transpose(spark, sf_dir):
    return rounded(regions.transpose_mapping(regions.bilinear_mapping(sized_pixels(spark), MESH, SIDE), image(spark, sf_dir), "beam"), 7)


CUBE_SQL = f"{SERIES_SQL}, span as (select min(time_s) a, max(time_s) b from series), cube as (select baseline pixel, cast(least(floor((time_s - a) / ((b - a) / 32e0)), 31) as bigint) channel, sum(value) value from series, span group by all), widths as (select channel, abs(case when lag(v) over w is null then lead(v) over w - v when lead(v) over w is null then v - lag(v) over w else (lead(v) over w - lag(v) over w) / 2e0 end) width, v velocity from (select distinct channel, channel * 25e-1 - 40e0 v from cube) window w as (order by channel)), sigma as (select pixel, 14826e-4 * mad(value) noise from cube group by all), bright as (select pixel, count(*) filter (value >= 5e-1 * noise) c from cube join sigma using (pixel) group by all), cells as (select cube.*, width, velocity, value >= 5e-1 * noise and c >= 3 keep from cube join widths using (channel) join sigma using (pixel) join bright using (pixel))"


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small cube: event types as pixels, 32 time bins as channels."""
    binned = noise.time_bins(series(spark, sf_dir), "time_s", 32)
    cube = binned.groupBy(F.col("baseline").alias("pixel"), F.col("bin_").cast("long").alias("channel")).agg(F.sum("value").alias("value"))
    channels = regions.channel_widths(cube.select("channel").distinct().withColumn("velocity", F.col("channel") * 2.5 - 40.0), "velocity", "channel")
    sigma = noise.robust_sigma(cube, "value", ("pixel",), most=32).select("pixel", F.col("sigma").alias("noise"))
    return regions.snr_mask(cube.join(channels, "channel").join(sigma, "pixel"), 0.5, 3, ("pixel",))


@query("q_snr_mask", f"with {CUBE_SQL} select pixel, channel, round(value, 6) as value, keep from cells")
def snr_mask(spark, sf_dir):
    return rounded(cells(spark, sf_dir).select("pixel", "channel", "value", "keep"), 6)


@query(
    "q_residual_mask",
    f"with {CUBE_SQL}, level as (select channel, avg(value) m from cube group by all), rest as (select pixel, channel, value, value - m r from cube join level using (channel)), noise as (select channel, 14826e-4 * mad(r) s from rest group by all), b as (select pixel, channel, value, value >= 2e0 * 5e-1 * s bright from rest join noise using (channel)), many as (select pixel, count(*) filter (bright) c from b group by all) select pixel, channel, round(value, 6) as value, bright and c >= 3 keep from b join many using (pixel)",
)
def residual_mask(spark, sf_dir):
    """Cells at twice the noise that each channel's residual shows, in pixels with three of them; half a unit of the cube is one of the residual."""
    cube = cells(spark, sf_dir).select("pixel", "channel", "value")
    rest = cube.join(cube.groupBy("channel").agg(F.avg("value").alias("m")), "channel").withColumn("rest", F.col("value") - F.col("m"))
    return rounded(regions.residual_mask(rest, "value", "rest", "channel", 2.0, 0.5, 3, ("pixel",)).select("pixel", "channel", "value", "keep"), 6)


@query(
    "q_moments",
    f"with {CUBE_SQL}, k as (select pixel, case when keep then value end v, velocity x, width from cells), s as (select pixel, sum(v * width) m0, sum(v) s, sum(v * x) sx, sum(v * x * x) sxx, max(v) peak from k group by all) select pixel, round(m0, 5) mom0, case when s > 0 then round(sx / s, 6) end mom1, case when s > 0 then round(sqrt(greatest(sxx / s - (sx / s) * (sx / s), 0e0)), 6) end mom2, round(peak, 6) peak from s",
)
def moments(spark, sf_dir):
    return rounded(regions.moments(cells(spark, sf_dir), ("pixel",)), 6, mom0=5)


def masks(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    parts = table(spark, sf_dir, "part").select((F.col("p_partkey") % 64).alias("pix_y"), (F.floor(F.col("p_partkey") / 64) % 64).alias("pix_x"), "p_size")
    return {"include": parts.where("p_size <= 20").select("pix_y", "pix_x"), "exclude": parts.where("p_size % 3 = 0").select("pix_y", "pix_x"), "extra": parts.where("p_size >= 45").select("pix_y", "pix_x")}


MASK_SQL = "p as (select p_partkey % 64 pix_y, (p_partkey // 64) % 64 pix_x, p_size from part), inc as (select pix_y, pix_x from p where p_size <= 20), exc as (select pix_y, pix_x from p where p_size % 3 = 0), ext as (select pix_y, pix_x from p where p_size >= 45)"


@query("q_mask_setops", f"with {MASK_SQL} select 'difference' op, * from (select * from inc except select * from exc) union all select 'union', * from (select * from inc union select * from ext) union all select 'common', * from (select * from inc intersect select * from exc)")
def mask_setops(spark, sf_dir):
    m = masks(spark, sf_dir)
    made = {"difference": regions.mask_difference(m["include"], m["exclude"]), "union": regions.mask_union(m["include"], m["extra"]), "common": regions.mask_common(m["include"], m["exclude"])}
    out = None
    for name, df in made.items():
        df = df.select(F.lit(name).alias("op"), "pix_y", "pix_x")
        out = df if out is None else out.unionByName(df)
    return out


@query("q_mask_dilate", f"with {MASK_SQL}, d as (select y, x from range(-2, 3) a(y), range(-2, 3) b(x) where abs(y) + abs(x) <= 2) select distinct pix_y + y pix_y, pix_x + x pix_x from ext, d")
def mask_dilate(spark, sf_dir):
    return regions.dilated(masks(spark, sf_dir)["extra"], 2)


@query("q_dim_lookup", "select r_name, n_name, count(*) n, round(avg(s_acctbal), 6) mean_balance from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all")
def dim_lookup(spark, sf_dir):
    """Dimension lookups; the planner broadcasts what is small."""
    supplier, nation, region = (table(spark, sf_dir, n) for n in ("supplier", "nation", "region"))
    joined = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rounded(joined.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"), F.avg("s_acctbal").alias("mean_balance")), 6)


@query("q_ring_offsets", "with r as (select id ring, greatest(1, cast(round_even(6.283185307179586 * (id + 5e-1), 0) as bigint)) cells from range(24) t(id)), o as (select ring, cells, cast(coalesce(sum(cells) over (order by ring rows between unbounded preceding and 1 preceding), 0) as bigint) first_cell, 2e0 / 3e0 * ((ring + 1) ** 3 - ring ** 3) / ((ring + 1) ** 2 - ring ** 2) centroid from r), p as (select cast(floor(sqrt((p_partkey % 31 - 15) ** 2 + (p_size - 25) ** 2)) as bigint) ring, p_retailprice v from part) select ring, cells, first_cell, round(centroid, 8) centroid, count(v) n, round(coalesce(sum(v), 0) / cells, 6) per_cell from o left join p using (ring) group by ring, cells, first_cell, centroid")
def ring_offsets(spark, sf_dir):
    """Parts in the rings about a centre: how the rings' cells are numbered and what each ring's cells hold."""
    from fringeframe.operators.disc import rings

    parts = table(spark, sf_dir, "part").select(F.floor(F.sqrt(F.pow(F.col("p_partkey") % 31 - 15, 2) + F.pow(F.col("p_size") - 25, 2))).cast("long").alias("ring"), F.col("p_retailprice").alias("v"))
    held_in = parts.groupBy("ring").agg(F.count("v").alias("n"), F.sum("v").alias("s"))
    met = rings(spark, 24, 24.0).join(held_in, "ring", "left").na.fill(0, ["n", "s"])
    return rounded(met.select("ring", "cells", "first_cell", "centroid", "n", (F.col("s") / F.col("cells")).alias("per_cell")), 8, per_cell=6)


@query(
    "q_session_gaps",
    f"with {SERIES_SQL}, steps as (select baseline, time_s, event_id, time_s - lag(time_s) over (partition by baseline order by time_s, event_id) step from series), runs as (select baseline, time_s, sum(case when step is null or step > 36e2 then 1 else 0 end) over (partition by baseline order by time_s, event_id) run from steps) select baseline, cast(run as bigint) run, count(*) n, min(time_s) t_first, max(time_s) t_last from runs group by all",
)
def session_gaps(spark, sf_dir):
    from fringeframe.operators.sessions import sessions

    return sessions(series(spark, sf_dir), ("baseline",), ("time_s", "event_id"), 3600.0)


@query("q_tumbling_chunks", f"with {SERIES_SQL}, a as (select min(time_s) t from series) select baseline, cast(floor((time_s - t) / 864e2) as bigint) chunk, count(*) n, round(avg(value), 8) mean from series, a group by all")
def tumbling_chunks(spark, sf_dir):
    from fringeframe.operators.sessions import anchored_chunks

    return rounded(anchored_chunks(series(spark, sf_dir), 86400.0))


@query("q_coverage", f"with {POINTS_SQL} select spw, round(sqrt(avg((re - 5e-1) ** 2)), 8) rms_error, round(quantile_cont(sig_re, 5e-1), 8) median_sigma, round(avg(case when abs(re - 5e-1) <= 5e0 * sig_re then 1e0 else 0e0 end), 8) covered from points group by spw")
def coverage(spark, sf_dir):
    rows = points(spark, sf_dir)
    off = F.col("re") - 0.5
    middle = quantiles(rows, F.col("sig_re"), [0.5], ("spw",)).select("spw", F.col("q0").alias("median_sigma"))
    return rounded(rows.groupBy("spw").agg(F.sqrt(F.avg(F.pow(off, 2))).alias("rms_error"), F.avg(F.when(F.abs(off) <= 5.0 * F.col("sig_re"), 1.0).otherwise(0.0)).alias("covered")).join(middle, "spw"))


@query("q_image_agreement", f"with {IMAGE_SQL} select count(*) n, round(corr(dirty, beam), 8) correlation, round(sqrt(avg((dirty - beam) ** 2)) / max(abs(beam)), 8) rms_over_peak from image")
def image_agreement(spark, sf_dir):
    rows = image(spark, sf_dir)
    return rounded(rows.agg(F.count(F.lit(1)).alias("n"), F.corr("dirty", "beam").alias("correlation"), (F.sqrt(F.avg(F.pow(F.col("dirty") - F.col("beam"), 2))) / F.max(F.abs("beam"))).alias("rms_over_peak")))


# --- smaller operators ---------------------------------------------------------------------------------------------------


@query("q_baseline_ids", f"with {CROSS_SQL} select ant1, ant2, dense_rank() over (order by ant1, ant2) - 1 baseline from (select distinct ant1, ant2 from crossed)")
def baseline_ids(spark, sf_dir):
    return selection.baseline_ids(cross(spark, sf_dir))


@query("q_parse_windows", f"with {VIS_SQL} select cast(chan as integer) spw, count(*) n, sum(case when flag then 0 else 1 end) n_live from vis where chan in (0, 1, 4, 6) group by 1")
def parse_windows(spark, sf_dir):
    """Samples of the windows that a text names; line numbers stand for windows."""
    from fringeframe.sources.measurement import windows_of

    named = windows_of(spark, "6, 0-1, 4, 12-14")
    return visibilities(spark, sf_dir).withColumn("spw", F.col("chan").cast("int")).join(named, "spw", "left_semi").groupBy("spw").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("flag")).alias("n_live"))


@query(
    "q_repaired_sigma",
    f"with {VIS_SQL}, bad as (select *, sig_re - 1e-2 a, case when sig_im <= 3e-2 then null else sig_im end b from vis), m as (select (select quantile_cont(a, 5e-1) from bad where not flag and a > 0) ma, (select quantile_cont(b, 5e-1) from bad where not flag and b > 0) mb) select {KEY}, round(case when a > 0 then a else ma end, 9) sig_re, round(coalesce(b, mb), 9) sig_im from bad, m",
)
def repaired_sigma(spark, sf_dir):
    """Noise that is zero or missing in some samples, replaced by the median of the rest."""
    broken = visibilities(spark, sf_dir).withColumns({"sig_re": F.col("sig_re") - 1e-2, "sig_im": F.when(F.col("sig_im") > 3e-2, F.col("sig_im"))})
    return rounded(noise.repaired(broken).select(*ROW_KEY, "sig_re", "sig_im"), 9)


@query("q_field_mask", f"with {IMAGE_SQL}, c as (select s_acctbal, (s_suppkey % 7 - 3) * 45e-3 cx, (s_suppkey % 5 - 2) * 6e-2 cy from supplier where s_acctbal > 9e3) select pix_y, pix_x from image where x_as * x_as + y_as * y_as <= 64e-4 union select pix_y, pix_x from image, c where (y_as - cy) ** 2 + (x_as - cx) ** 2 <= 4e-4")
def field_mask(spark, sf_dir):
    """The round field of an image and discs about bright suppliers."""
    centres = table(spark, sf_dir, "supplier").where("s_acctbal > 9e3").select(((F.col("s_suppkey") % 7 - 3) * 0.045).alias("x_as"), ((F.col("s_suppkey") % 5 - 2) * 0.06).alias("y_as"))
    grid = sized_pixels(spark)
    return regions.with_discs(grid, regions.circle(grid, 0.08), centres, 0.02)


@query(
    "q_legacy_hands",
    f"with {VIS_SQL} select ok, chan, round(avg(re) + 17e-11, 8) re, round(avg(im) + 17e-11, 8) im, round(sqrt(sum(sig_re * sig_re)) / count(*) * sqrt(count(*) / cast(count(distinct (re, im)) as double)), 8) sigma from vis group by all",
)
def legacy_hands(spark, sf_dir):
    from fringeframe.sources.measurement import from_hands

    found = from_hands(visibilities(spark, sf_dir).withColumn("sigma", F.col("sig_re")), ("ok", "chan"))
    return rounded(found.withColumns({"re": F.col("re") + 17e-11, "im": F.col("im") + 17e-11}))


@query("q_missing_channels", f"with {VIS_SQL} select spw, chan from (select cast(a as integer) spw, cast(b as integer) chan from range(3) x(a), range(8) y(b)) except select spw, chan from vis where ant1 <> ant2")
def missing_channels(spark, sf_dir):
    asked = spark.range(24).select(F.floor(F.col("id") / 8).cast("int").alias("spw"), (F.col("id") % 8).cast("int").alias("chan"))
    return selection.missing_channels(asked, cross(spark, sf_dir))


@query(
    "q_even_rows",
    f"with {CROSS_SQL}, c as (select f, row_number() over (order by f) - 1 k, count(*) over () n from (select distinct f from crossed)) select f from c where round_even(round_even(k / greatest((n - 1) / 5e0, 1e0), 0) * greatest((n - 1) / 5e0, 1e0), 0) = k",
)
def even_rows(spark, sf_dir):
    return selection.even_rows(cross(spark, sf_dir).select(frequency().alias("f")).distinct(), "f", 6)


@query("q_position_join", f"with {GRID_SQL}, p as (select p_partkey id, (p_partkey % 40 - 20) * 5e-1 * {STEP!r} x_as, (p_size - 25) * 5e-1 * {STEP!r} y_as from part) select id, pix_y, pix_x from p join grid g on abs(p.x_as - g.x_as) <= 1e-9 and abs(p.y_as - g.y_as) <= 1e-9")
def position_join(spark, sf_dir):
    at = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_partkey") % 40 - 20) * 0.5 * STEP).alias("x_as"), ((F.col("p_size") - 25) * 0.5 * STEP).alias("y_as"))
    return regions.at_pixel_centres(at, sized_pixels(spark), STEP)


@query("q_add_points", f"with {IMAGE_SQL}, p as (select cast(round_even(75e-1 - (p_size % 7 - 3) * 1e-2 / {STEP!r}, 0) as integer) pix_y, cast(round_even((p_partkey % 9 - 4) * 1e-2 / {STEP!r} + 75e-1, 0) as integer) pix_x, p_retailprice / 1e3 v from part) select pix_y, pix_x, round(sum(v), 6) as value from (select pix_y, pix_x, beam v from image union all select * from p) group by all")
def add_points(spark, sf_dir):
    from fringeframe.plans.products import with_points

    at = table(spark, sf_dir, "part").select(((F.col("p_partkey") % 9 - 4) * 0.01).alias("x_as"), ((F.col("p_size") % 7 - 3) * 0.01).alias("y_as"), (F.col("p_retailprice") / 1e3).alias("flux"))
    return rounded(with_points(image(spark, sf_dir).select("pix_y", "pix_x", F.col("beam").alias("value")), at, STEP, SIDE), 6)


@query(
    "q_upsample",
    f"""with {IMAGE_SQL}, fine as (select cast(a as integer) y, cast(b as integer) x, least(greatest((a + 5e-1) / 2e0 - 5e-1, 0e0), {SIDE - 1.0!r}) cy, least(greatest((b + 5e-1) / 2e0 - 5e-1, 0e0), {SIDE - 1.0!r}) cx from range({2 * SIDE}) p(a), range({2 * SIDE}) q(b)),
 four as (select y, x, cy, cx, least(floor(cy) + dy, {SIDE - 1}) iy, least(floor(cx) + dx, {SIDE - 1}) ix, (case dy when 0 then 1 - (cy - floor(cy)) else cy - floor(cy) end) * (case dx when 0 then 1 - (cx - floor(cx)) else cx - floor(cx) end) s from fine, range(2) d(dy), range(2) e(dx)),
 made as (select y, x, sum(s * beam) b from four join image on pix_y = iy and pix_x = ix group by all)
 select y pix_y, x pix_x, round(b * (select sum(beam) from image) / (select sum(b) from made), 8) beam from made""",
)
def upsample(spark, sf_dir):
    return rounded(regions.upsampled(image(spark, sf_dir).select("pix_y", "pix_x", "beam"), "beam", 2, SIDE))


@query("q_apertures", f"with {IMAGE_SQL} select r radius, count(*) n, round(sum(beam), 7) total from image, (select unnest([5e-2, 1e-1, 2e-1]) r) where x_as * x_as + y_as * y_as <= r * r group by r")
def apertures(spark, sf_dir):
    return rounded(regions.apertures(located(spark, sf_dir), "beam", [0.05, 0.1, 0.2]), 7)


@query("q_beam_scatter", f"with {IMAGE_SQL} select count(*) n, round(sqrt(sum(beam * beam) / (2e0 * count(*))), 8) scatter from image")
def beam_scatter(spark, sf_dir):
    return rounded(regions.beam_scatter(image(spark, sf_dir), "beam"))


@query("q_region_flux", f"with {IMAGE_SQL} select count(*) n, round(sum(beam), 7) flux from image where beam >= 95e-2")
def region_flux(spark, sf_dir):
    return rounded(regions.region_flux(image(spark, sf_dir), "beam", 0.19, 5.0), 7)


@query("q_weakest_component", "select p_partkey id, round(p_retailprice / (1e0 + p_size), 8) snr from part order by p_retailprice / (1e0 + p_size), p_partkey limit 1")
def weakest_component(spark, sf_dir):
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("flux"), (F.col("p_size") + 1.0).alias("error"))
    return rounded(selection.weakest(found, "flux", "error").select("id", "snr"))


@query(
    "q_moment_errors",
    f"with {SERIES_SQL}, d as (select baseline, user_id % 7 draw, sum(value) mom0, sum(value * event_id) / sum(value) mom1 from series group by all) select baseline, count(*) draws, round((quantile_cont(mom0, 84e-2) - quantile_cont(mom0, 16e-2)) / 2e0, 6) mom0_error, round((quantile_cont(mom1, 84e-2) - quantile_cont(mom1, 16e-2)) / 2e0, 5) mom1_error from d group by all",
)
def moment_errors(spark, sf_dir):
    draws = series(spark, sf_dir).groupBy("baseline", (F.col("user_id") % 7).alias("draw")).agg(F.sum("value").alias("mom0"), (F.sum(F.col("value") * F.col("event_id")) / F.sum("value")).alias("mom1"))
    return rounded(regions.moment_errors(draws, ("baseline",)), 6, mom1_error=5)


#: Parts as detections, suppliers as truths; detections are taken one after the other.
MATCH_SQL = """recursive found as (select p_partkey id, p_partkey % 97 * 1e0 x, p_size * 2e0 y, p_retailprice flux, row_number() over (order by abs(p_retailprice) desc, p_partkey) turn from part),
 truth as (select s_suppkey id, s_suppkey % 89 * 1e0 x, s_suppkey % 53 * 2e0 y from supplier),
 near as (select f.id found_id, f.turn, t.id truth_id, (f.x - t.x) ** 2 + (f.y - t.y) ** 2 d2, f.flux / 1e3 ratio from found f join truth t on (f.x - t.x) ** 2 + (f.y - t.y) ** 2 < 16e0),
 turns as (select turn, row_number() over (order by turn) k, list(truth_id order by d2, truth_id) wish from near group by turn),
 walk as (
  select cast(0 as bigint) k, cast(null as bigint) turn, cast(null as bigint) truth_id, cast([] as bigint[]) used
  union all
  select t.k, t.turn, list_filter(t.wish, lambda x: not list_contains(w.used, x))[1], list_append(w.used, coalesce(list_filter(t.wish, lambda x: not list_contains(w.used, x))[1], -1))
  from walk w join turns t on t.k = w.k + 1
 ), matched as (select found_id, near.truth_id, ratio, d2 from walk join near on near.turn = walk.turn and near.truth_id = walk.truth_id)"""


@query(
    "q_match_components",
    f"with {MATCH_SQL} select 'matched' kind, found_id, truth_id, round(ratio, 8) ratio, round(sqrt(d2), 8) distance from matched union all select 'missed', null, id, null, null from truth where id not in (select truth_id from matched) union all select 'false', id, null, null, null from found where id not in (select found_id from matched)",
)
def match_components(spark, sf_dir):
    """Parts near a grid of suppliers, brightest part first: one-to-one nearest matches, what is missed and what is false."""
    found = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 97 * 1.0).alias("x_as"), (F.col("p_size") * 2.0).alias("y_as"), F.col("p_retailprice").alias("flux"))
    truth = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), (F.col("s_suppkey") % 89 * 1.0).alias("x_as"), (F.col("s_suppkey") % 53 * 2.0).alias("y_as"), F.lit(1000.0).alias("flux"))
    return rounded(regions.match_report(found, truth, 4.0))


@query(
    "q_mask_boundary",
    f"with {MASK_SQL}, o as (select y, x from range(-4, 5) a(y), range(-4, 5) b(x) where y * y + x * x between 1 and 16), out as (select pix_y + y pix_y, pix_x + x pix_x from ext, o except select pix_y, pix_x from ext), edge as (select pix_y + y pix_y, pix_x + x pix_x from ext, o where abs(y) + abs(x) = 1 except select pix_y, pix_x from ext), kept as (select * from out where pix_y % 2 = 0 and pix_x % 2 = 0 union select * from edge where (cast(floor(pix_y / 2e0) + floor(pix_x / 2e0) as bigint)) % 2 = 0) select pix_y, pix_x from kept where pix_y between 0 and 63 and pix_x between 0 and 63",
)
def mask_boundary(spark, sf_dir):
    return regions.mask_boundary(masks(spark, sf_dir)["extra"].distinct(), 2, 64)


@query(
    "q_boundary_points",
    f"with {MASK_SQL}, o as (select y, x from range(-4, 5) a(y), range(-4, 5) b(x) where y * y + x * x between 1 and 16), out as (select pix_y + y pix_y, pix_x + x pix_x from ext, o except select pix_y, pix_x from ext), edge as (select pix_y + y pix_y, pix_x + x pix_x from ext, o where abs(y) + abs(x) = 1 except select pix_y, pix_x from ext), kept as (select * from out where pix_y % 2 = 0 and pix_x % 2 = 0 union select * from edge where (cast(floor(pix_y / 2e0) + floor(pix_x / 2e0) as bigint)) % 2 = 0), t as (select -65e-1 + i * 4e-1 t from range(33) r(i) where -65e-1 + i * 4e-1 < 65e-1), ring as (select 65e-1 y, t x from t union all select t, -65e-1 from t union all select -65e-1, -t from t union all select -t, 65e-1 from t) select round((315e-1 - pix_y) * 2e-1, 9) + 0 y_as, round((pix_x - 315e-1) * 2e-1, 9) + 0 x_as from kept where pix_y between 0 and 63 and pix_x between 0 and 63 union select round(y, 9) + 0, round(x, 9) + 0 from ring",
)
def boundary_points(spark, sf_dir):
    """Zero points of a mesh over a mask: round the mask, and on a square just outside the field."""
    return regions.boundary_points(masks(spark, sf_dir)["extra"].distinct(), 2, 64, 0.2)


@query("q_points_union", "with p as (select p_partkey % 64 * 1e-1 y_as, p_size * 3e-1 x_as from part union all select s_suppkey % 64 * 1e-1 + 1e-12, s_suppkey % 50 * 3e-1 from supplier) select distinct round(y_as, 9) y_as, round(x_as, 9) x_as from p")
def points_union(spark, sf_dir):
    a = table(spark, sf_dir, "part").select((F.col("p_partkey") % 64 * 0.1).alias("y_as"), (F.col("p_size") * 0.3).alias("x_as"))
    b = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 64 * 0.1 + 1e-12).alias("y_as"), (F.col("s_suppkey") % 50 * 0.3).alias("x_as"))
    return regions.distinct_points(a, b)


@query(
    "q_dynamic_range",
    f"with {IMAGE_SQL}, r as (select dirty, dirty - 5e-1 * beam res, (select 1e0 / sqrt(sum(w)) from points) rms from image), s as (select max(dirty) / max(rms) p, max(abs(res)) / max(rms) m, stddev_pop(res / rms) / {math.sqrt(1.2)!r} q from r) select round(p, 4) peak_sigma, round(m, 4) residual_sigma, round(p / m, 6) dynamic_range, round(q, 6) ratio, case when q < 85e-2 then 'over-fitted' when q <= 125e-2 then 'noise' when q <= 15e-1 then 'some structure' else 'structure' end verdict from s",
)
def dynamic_range(spark, sf_dir):
    """The data against half the beam: how the residual stands to the peak and to noise."""
    planes = image(spark, sf_dir).withColumn("residual", F.col("dirty") - 0.5 * F.col("beam"))
    total = imaging.scalar_terms(points(spark, sf_dir)).first()["sum_w"]
    return rounded(regions.dynamic_range(planes, "dirty", "residual", 1 / math.sqrt(total), 1.2), 6, peak_sigma=4, residual_sigma=4)


@query(
    "q_fit_scores",
    f"with {IMAGE_SQL}, c as (select 2e0 * count(*) n, sum((re - 5e-1) ** 2 / (sig_re * sig_re) + im * im / (sig_im * sig_im)) x, 1e0 / sqrt(sum(w)) rms from points), i as (select stddev_pop((dirty - 5e-1 * beam) / (select rms from c)) / sqrt((select x / n from c)) ratio, sqrt(sum(beam * beam) / (2e0 * count(*))) scatter from image) select round(x / n, 6) chi2_per_datum, round((x / n - 1e0) / sqrt(2e0 / n), 4) chi2_sigma, round(ratio, 6) ratio, round((ratio - 1e0) / scatter, 6) ratio_sigma from c, i",
)
def fit_scores(spark, sf_dir):
    """A point of half a jansky at the centre, scored by chi square and by the structure of its residual image."""
    given = points(spark, sf_dir).withColumn("re", F.col("re") - 0.5)
    scalars = imaging.scalar_terms(given).first()
    planes = held(image(spark, sf_dir).withColumn("residual", F.col("dirty") - 0.5 * F.col("beam")))
    n, rms = 2.0 * scalars["n_vis"], 1 / math.sqrt(scalars["sum_w"])
    ratio = regions.structure_ratio(planes, "residual", rms, scalars["data_term"] / n).first()["ratio"]
    scored = regions.fit_scores(n, scalars["data_term"], ratio, regions.beam_scatter(planes, "beam").first()["scatter"])
    return rounded(spark.createDataFrame([tuple(scored.values())], ", ".join(f"{k} double" for k in scored)), 6, chi2_sigma=4)


@query("q_empty_channel_rms", f"with {CUBE_SQL} select count(*) n, round(sqrt(avg(value * value)), 8) rms from cube where channel in (0, 1, 30, 31) and value <> 0e0")
def empty_channel_rms(spark, sf_dir):
    return rounded(regions.empty_channel_rms(cells(spark, sf_dir), "value", "channel", [0, 1, 30, 31]))


# --- fits and streams: no SQL, tests hold them against plain loops -----------------------------------------------------------------------------------


def in_task(spark: SparkSession, work: Callable[[], pd.DataFrame], schema: str) -> DataFrame:
    """The rows of a solve of mesh size, done in one task; what ``work`` closes over are arrays of mesh size."""
    return spark.range(1, numPartitions=1).mapInPandas(lambda frames: (work() for _ in frames), schema)


@query("q_solve_map")
def solve_map(spark, sf_dir):
    """The image of largest evidence of all samples, with its posterior deviation."""
    from fringeframe.plans import inversion

    terms = inversion.collect_terms(points(spark, sf_dir), SIDE, FOV)

    def work() -> pd.DataFrame:
        system = inversion.System(terms, FOV / SIDE, 0.05)
        best = inversion.search_evidence(system)[-1]
        k = np.arange(SIDE * SIDE)
        return pd.DataFrame({"pix_y": k // SIDE, "pix_x": k % SIDE, "value": best.image, "sigma": system.posterior(best.log_strength)})

    return in_task(spark, work, "pix_y int, pix_x int, value double, sigma double")


@query("q_evidence_scan")
def evidence_scan(spark, sf_dir):
    """The trials of both searches of the prior's strength."""
    from fringeframe.plans import inversion

    terms = inversion.collect_terms(points(spark, sf_dir), SIDE, FOV)

    def work() -> pd.DataFrame:
        system = inversion.System(terms, FOV / SIDE, 0.05)
        searches = {"evidence": inversion.search_evidence, "discrepancy": inversion.search_discrepancy}
        rows = [(name, *r) for name, search in searches.items() for r in inversion.trial_rows(search(system), terms.n_vis)]
        return pd.DataFrame(rows, columns=["criterion", "trial", "log_strength", "chi2_per_datum", "log_evidence"])

    return in_task(spark, work, "criterion string, trial int, log_strength double, chi2_per_datum double, log_evidence double")


@query("q_posterior_draws")
def posterior_draws(spark, sf_dir):
    """Draws around the solution as a table, and what they say of the total flux: 16, 50 and 84 in a hundred."""
    from fringeframe.plans import inversion

    terms = inversion.collect_terms(points(spark, sf_dir), SIDE, FOV)

    def work() -> pd.DataFrame:
        system = inversion.System(terms, FOV / SIDE, 0.05)
        best = inversion.search_evidence(system)[-1]
        values = best.image + system.draws(best.log_strength, 64)
        draw, param = (a.reshape(-1) for a in np.indices(values.shape))
        return pd.DataFrame({"draw": draw, "param": param, "value": values.reshape(-1)})

    flux = in_task(spark, work, "draw int, param int, value double").groupBy("draw").agg(F.sum("value").alias("flux"))
    return flux.agg(F.count(F.lit(1)).alias("draws"), *(F.percentile("flux", F.lit(q / 100)).alias(f"flux_{q}") for q in (16, 50, 84)))  # 64 draws


@query("q_point_fit")
def point_fit(spark, sf_dir):
    """The points that all samples show, placed and measured."""
    from fringeframe.plans.pointfit import detect

    found = detect(points(spark, sf_dir), SIDE, FOV, most=2, apart=0.03)
    return spark.createDataFrame([(c.x_as, c.y_as, c.flux, c.error) for c in found], "x_as double, y_as double, flux double, error double")


@query("q_cube_fit")
def cube_fit(spark, sf_dir):
    """Every channel of all samples solved in a task of its own under one prior."""
    from fringeframe.plans.inversion import solve_channels

    return solve_channels(points(spark, sf_dir), 12, FOV, 4.0, 0.05)


@query("q_source_region")
def source_region(spark, sf_dir):
    """The connected pixels above a third of the peak that hold it."""
    pixels = held(image(spark, sf_dir))
    top = pixels.orderBy(F.col("beam").desc(), "pix_y", "pix_x").first()
    return regions.connected_region(pixels.where(F.col("beam") >= top["beam"] / 3), top["pix_y"], top["pix_x"], tile=4)


@query("q_running_stream", f"with {SERIES_SQL} select baseline, count(value) n, round(sum(value), 6) s, round(sum(value * value), 6) ss from series group by all")
def running_stream(spark, sf_dir):
    """Running sums of the events files read as a stream until they are used up."""
    import uuid

    from fringeframe.session import shared_folder
    from fringeframe.streaming.terms import drain, event_stream, running_terms

    name = f"terms_{uuid.uuid4().hex}"
    stream = running_terms(event_stream(spark, f"{sf_dir}/events.parquet*"))
    return rounded(drain(stream, name, f"{shared_folder(spark)}/{name}"), 6)


@query(
    "q_stream_pairs",
    f"with {SERIES_SQL}, steps as (select baseline, lag(time_s) over w t0, time_s t1, value - lag(value) over w d from series window w as (partition by baseline order by time_s, event_id)) select baseline, t0, t1, round(d, 8) d from steps where t1 - t0 <= 6e2",
)
def stream_pairs(spark, sf_dir):
    """Neighbours' differences from the events files read as a stream: closed slabs, and those that the end leaves open."""
    import uuid

    from fringeframe.session import shared_folder
    from fringeframe.streaming import terms

    folder = f"{shared_folder(spark)}/pairs_{uuid.uuid4().hex}"
    stream = terms.stream_pairs(terms.event_stream(spark, f"{sf_dir}/events.parquet*"), 600.0)
    closed = terms.landed(stream, f"{folder}/rows", f"{folder}/state")
    return rounded(closed.unionByName(terms.open_pairs(spark, f"{folder}/state", 600.0)))


from fringeframe import queries_sky  # noqa: E402, F401  registers its own
