"""Row selection, Stokes I, validation, channel order, row bookkeeping, baseline statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions.sky import LIGHT, asymmetry, phase, pooled_sigma, u_lambda, v_lambda
from fringeframe.operators.quantiles import quantiles
from fringeframe.session import held
from fringeframe.sources.adapter import ROW_KEY


def cross_correlations(rows: DataFrame, window: int | None = None) -> DataFrame:
    """Rows of two different antennas, of one window where it is named."""
    found = rows.where("ant1 <> ant2")
    return found if window is None else found.where(F.col("spw") == window)


def flattened(vis: DataFrame, hz: Column) -> DataFrame:
    """Unflagged samples with u and v in wavelengths and the key that orders them: window, channel, row."""
    kept = vis.where(~F.coalesce(F.col("flag"), F.lit(False)))
    return kept.select("spw", "chan", *ROW_KEY, u_lambda(hz).alias("u"), v_lambda(hz).alias("v"), "re", "im", "sig_re", "sig_im")


def channel_rank(vis: DataFrame, hz: Column) -> DataFrame:
    """(spw, chan, freq_hz, rank): channels of all windows by frequency. A row for each channel."""
    channels = vis.select("spw", "chan").distinct().withColumn("freq_hz", hz)
    return channels.withColumn("rank", F.row_number().over(Window.orderBy("freq_hz", "spw", "chan")).cast("long"))


def even_spacing(channels: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per window: are all steps of its channels' frequencies the same."""
    step = F.col("freq_hz") - F.lag("freq_hz").over(Window.partitionBy("spw").orderBy("freq_hz"))
    stepped = channels.withColumn("step", step)
    return stepped.groupBy("spw").agg(F.count("step").alias("steps"), (F.max("step") - F.min("step") <= F.lit(tolerance) * F.max("step")).alias("even"))


def invalid_samples(vis: DataFrame) -> DataFrame:
    """Per window: samples, unflagged ones, and those whose noise or place can't be used."""
    live = ~F.coalesce(F.col("flag"), F.lit(False))
    bad_noise = live & (F.isnan("sig_re") | F.isnan("sig_im") | (F.col("sig_re") <= 0) | (F.col("sig_im") <= 0) | F.col("sig_re").isNull() | F.col("sig_im").isNull())
    bad_place = F.col("u_m").isNull() | F.col("v_m").isNull() | F.isnan("u_m") | F.isnan("v_m")
    return vis.groupBy("spw").agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("n_live"), F.count_if(bad_noise).alias("bad_noise"), F.count_if(bad_place).alias("bad_place"))


def stokes_i(hands: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Weighted mean over the hands of a cell: re, im, relative noise 1/sqrt(sum of weights), flag where no weight is left."""
    good = ~F.coalesce(F.col("flag"), F.lit(False)) & ~F.isnan("re") & ~F.isnan("im")
    w = F.when(good, F.greatest(F.col("weight"), F.lit(0.0))).otherwise(F.lit(0.0))
    summed = hands.groupBy(*keys).agg(F.sum(w).alias("sw"), F.sum(F.when(good, w * F.col("re"))).alias("swr"), F.sum(F.when(good, w * F.col("im"))).alias("swi"))
    live = F.col("sw") > 0
    return summed.select(*keys, F.when(live, F.col("swr") / F.col("sw")).alias("re"), F.when(live, F.col("swi") / F.col("sw")).alias("im"), F.when(live, F.lit(1.0) / F.sqrt("sw")).alias("rel_sigma"), (~live).alias("flag"))


def with_pooled_noise(vis: DataFrame) -> DataFrame:
    sigma = pooled_sigma(F.col("sig_re"), F.col("sig_im"))
    return vis.withColumns({"sig_re": sigma, "sig_im": sigma})


def noise_asymmetry(vis: DataFrame) -> DataFrame:
    """Median of |sig_re - sig_im| over their mean, per window, unflagged samples of positive noise."""
    used = vis.where(~F.coalesce(F.col("flag"), F.lit(False)) & (F.col("sig_re") > 0) & (F.col("sig_im") > 0))
    return quantiles(used, asymmetry(F.col("sig_re"), F.col("sig_im")), [0.5], ("spw",)).select("spw", F.col("q0").alias("asymmetry"))


def recentred(flat: DataFrame, x0: float, y0: float) -> DataFrame:
    """The sky moved so that offset (x0, y0) arcseconds is the centre; noise pooled. A zero offset changes nothing."""
    if x0 == 0 and y0 == 0:
        return flat
    turn = phase(F.col("u"), F.col("v"), F.lit(x0), F.lit(y0))
    re = F.col("re") * F.cos(turn) - F.col("im") * F.sin(turn)
    im = F.col("re") * F.sin(turn) + F.col("im") * F.cos(turn)
    return with_pooled_noise(flat.withColumns({"re": re, "im": im}))


def thinned(vis: DataFrame, one_in: int, seed: int = 0) -> DataFrame:
    """About one sample in ``one_in``, the same ones in every run: chosen by arithmetic on the row's key."""
    mark = F.pmod(F.col("ok") * 7919 + F.col("ln") * 104729 + F.col("pk") * 1299709 + F.col("sk") * 15485863 + F.lit(seed), F.lit(one_in))
    return vis.where(mark == 0)


def kept_rows(vis: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that are not flagged in every channel, with their length in metres."""
    return vis.groupBy(*keys).agg(F.bool_and(F.coalesce(F.col("flag"), F.lit(False))).alias("all_"), F.count(F.lit(1)).alias("n"), F.max(F.sqrt(F.col("u_m") * F.col("u_m") + F.col("v_m") * F.col("v_m"))).alias("length_m")).select(*keys, "n", "length_m", (~F.col("all_")).alias("keep"))


def baseline_percentile(vis: DataFrame, hz: Column, keys: tuple[str, ...], q: float = 0.95) -> DataFrame:
    """The q-quantile of |uv| in wavelengths at each window's highest frequency over rows not flagged everywhere, and the longest of all rows."""
    top = vis.select("spw", "chan").distinct().withColumn("f", hz).groupBy("spw").agg(F.max("f").alias("f_max"))
    rows = held(kept_rows(vis, ("spw", *keys)).join(top, "spw").select("keep", (F.col("length_m") * F.col("f_max") / F.lit(LIGHT)).alias("length")))
    found = quantiles(rows.where("keep"), F.col("length"), [q]).select(F.col("q0").alias("b_percentile"))
    return rows.agg(F.count_if("keep").alias("rows_kept"), F.max("length").alias("b_max")).crossJoin(F.broadcast(found)).select("rows_kept", "b_percentile", "b_max")


def band(vis: DataFrame, hz: Column) -> DataFrame:
    """Per window: unflagged samples, central frequency, fractional bandwidth (range over midpoint)."""
    live = vis.where(~F.coalesce(F.col("flag"), F.lit(False))).groupBy("spw").agg(F.count(F.lit(1)).alias("n_samples"))
    channels = vis.select("spw", "chan").distinct().withColumn("f", hz)
    spread = channels.groupBy("spw").agg(F.avg("f").alias("central_hz"), ((F.max("f") - F.min("f")) / ((F.max("f") + F.min("f")) / 2.0)).alias("fractional_bandwidth"))
    return spread.join(live, "spw", "left").withColumn("n_samples", F.coalesce("n_samples", F.lit(0)))


def amplitude_bins(flat: DataFrame, bins: int) -> DataFrame:
    """(bin, q, amplitude, n): mean |V| and baseline length in equal bins of length."""
    q = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v"))
    rows = flat.select(q.alias("q"), F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amp"))
    top = rows.agg(F.max("q").alias("top"))
    placed = rows.crossJoin(F.broadcast(top)).withColumn("bin", F.least(F.floor(F.col("q") / F.col("top") * bins), F.lit(bins - 1)).cast("long"))
    return placed.groupBy("bin").agg(F.avg("q").alias("q"), F.avg("amp").alias("amplitude"), F.count(F.lit(1)).alias("n"))


def first_null(binned: DataFrame) -> DataFrame:
    """The first bin whose amplitude is no more than its neighbours', and the disc radius in arcseconds that has its null there."""
    order = Window.orderBy("bin")  # a row for each bin
    around = binned.withColumns({"left_": F.lag("amplitude").over(order), "right_": F.lead("amplitude").over(order)})
    low = around.where("left_ is not null and right_ is not null and amplitude <= left_ and amplitude <= right_")
    return low.agg(F.min_by(F.struct("bin", "q"), "bin").alias("b")).select(F.col("b.bin").alias("bin"), F.col("b.q").alias("q"), (F.lit(3.8317 / (2 * math.pi) * 648000.0 / math.pi) / F.col("b.q")).alias("radius_arcsec"))


def shortest(flat: DataFrame, least: int = 8, share: int = 50) -> DataFrame:
    """Mean real part over the shortest samples, one in ``share`` and ``least`` at least: about the total flux.

    Samples of the last length that counts share what is left of the number, so nothing is sorted.
    """
    rows = held(flat.select(F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("q"), "re"))
    n = rows.count()
    k = min(n, max(least, n // share))
    edge = quantiles(rows, F.col("q"), [(k - 1) / (n - 1) if n > 1 else 0.0]).select(F.col("q0").alias("edge"))
    below, at = F.col("q") < F.col("edge"), F.col("q") == F.col("edge")
    sums = rows.crossJoin(F.broadcast(edge)).agg(F.count_if(below).alias("m"), F.coalesce(F.sum(F.when(below, F.col("re"))), F.lit(0.0)).alias("s"), F.avg(F.when(at, F.col("re"))).alias("tied"), F.max("edge").alias("q_max"))  # one row
    return sums.select(F.lit(k).cast("long").alias("n"), ((F.col("s") + (F.lit(k) - F.col("m")) * F.col("tied")) / F.lit(float(max(k, 1)))).alias("mean_re"), "q_max")


def baseline_ids(vis: DataFrame) -> DataFrame:
    """(ant1, ant2, baseline): dense ids of the baselines that occur. A row for each baseline."""
    return vis.select("ant1", "ant2").distinct().withColumn("baseline", (F.dense_rank().over(Window.orderBy("ant1", "ant2")) - 1).cast("long"))


def missing_channels(requested: DataFrame, produced: DataFrame) -> DataFrame:
    """Channels asked for that have no sample."""
    return requested.join(produced.select("spw", "chan").distinct(), ["spw", "chan"], "left_anti")


def even_rows(channels: DataFrame, order: str, most: int) -> DataFrame:
    """At most ``most`` rows, evenly spread over ``order``, the first and last among them. A row for each channel."""
    turn = channels.withColumns({"k_": F.row_number().over(Window.orderBy(order)) - 1, "n_": F.count(F.lit(1)).over(Window.partitionBy())})
    step = F.greatest((F.col("n_") - 1) / F.lit(most - 1.0), F.lit(1.0))
    mine = F.rint(F.rint(F.col("k_") / step) * step) == F.col("k_")
    return turn.where(mine).drop("k_", "n_")


def weakest(components: DataFrame, value: str, error: str) -> DataFrame:
    """The component of least signal to noise."""
    return components.withColumn("snr", F.col(value) / F.col(error)).orderBy("snr", "id").limit(1)
