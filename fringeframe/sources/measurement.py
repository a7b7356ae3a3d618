"""Ingest of a measurement set landed as tables: rows, samples and the dimension tables that name windows, hands and antennas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.operators import noise, selection

#: Correlation codes of parallel hands and of Stokes I.
PARALLEL = (1, 5, 8, 9, 12)


@dataclass(frozen=True)
class MeasurementSet:
    """rows: row_id, field_id, data_desc_id, flag_row, ant1, ant2, time_s, u_m, v_m, w_m. samples: row_id, chan, corr, re, im, flag,
    weight, weight_spectrum. data_description: data_desc_id, spw_id, pol_id. spectral_window: spw_id, chan_freq array.
    polarization: pol_id, corr_type array. antenna: ant_id, dish_diameter."""

    rows: DataFrame
    samples: DataFrame
    data_description: DataFrame
    spectral_window: DataFrame
    polarization: DataFrame
    antenna: DataFrame


def windows_of(spark, text: str) -> DataFrame:
    """(spw): the sorted ids that a text such as "0-1,4" names."""
    parts = spark.range(1).select(F.explode(F.split(F.lit(text.replace(" ", "")), ",")).alias("p")).select(F.split("p", "-").alias("p"))
    low, high = F.element_at("p", 1).cast("int"), F.element_at("p", -1).cast("int")
    return parts.select(F.explode(F.sequence(low, high)).alias("spw")).distinct().orderBy("spw")


def windows_in(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("data_desc_id").alias("spw")).distinct().orderBy("spw")


def selected(ms: MeasurementSet, field_id: int, windows: DataFrame | None = None) -> DataFrame:
    """Rows of a field, between two antennas and not flagged as a whole, of the windows named."""
    rows = ms.rows.where((F.col("field_id") == field_id) & (F.col("ant1") != F.col("ant2")) & ~F.coalesce(F.col("flag_row"), F.lit(False)))
    return rows if windows is None else rows.join(windows.select(F.col("spw").alias("data_desc_id")), "data_desc_id", "left_semi")


def stokes_samples(ms: MeasurementSet, rows: DataFrame) -> DataFrame:
    """(row columns, spw, chan, freq_hz, re, im, rel_sigma, flag): the parallel hands of each cell averaged by weight.

    Dimension tables are joined for the planner to broadcast; only rows and samples are large, and they meet on row_id.
    """
    kinds = ms.data_description.join(ms.polarization, "pol_id").select("data_desc_id", F.posexplode("corr_type").alias("corr", "code")).where(F.col("code").isin(*PARALLEL))
    channels = ms.data_description.join(ms.spectral_window, "spw_id").select("data_desc_id", F.posexplode("chan_freq").alias("chan", "freq_hz"))
    cells = ms.samples.join(rows, "row_id").join(kinds.select("data_desc_id", "corr"), ["data_desc_id", "corr"])
    cells = cells.withColumn("weight", F.coalesce("weight_spectrum", "weight"))
    keys = ("row_id", "data_desc_id", "chan")
    return selection.stokes_i(cells, keys).join(rows.drop("field_id", "flag_row"), ["row_id", "data_desc_id"]).join(channels, ["data_desc_id", "chan"]).withColumnRenamed("data_desc_id", "spw")


def ingest(ms: MeasurementSet, field_id: int, windows: DataFrame | None = None, mode: str = "difference", chunk_seconds: float = 600.0) -> DataFrame:
    """Visibilities with noise: `difference` takes each baseline's level, `hybrid` that level times the weights' profile in time,
    `scaled` the relative noise times one factor."""
    vis = stokes_samples(ms, selected(ms, field_id, windows)).withColumns({"ok": F.col("row_id"), "ln": F.lit(0), "pk": F.lit(0), "sk": F.lit(0), "px": F.lit(0.0)})
    relative = F.col("rel_sigma")
    pairs = noise.adjacent_pairs(vis)
    if mode == "difference":
        out = noise.sigma_map(vis, pairs).withColumns({"sig_re": F.col("est_re"), "sig_im": F.col("est_im")})
    elif mode == "hybrid":
        out = noise.hybrid_sigma(vis, pairs, relative).withColumns({"sig_re": F.col("hyb_re"), "sig_im": F.col("hyb_im")})
    elif mode == "scaled":
        scale = noise.relative_scale(vis, relative)
        out = vis.crossJoin(F.broadcast(scale)).withColumns({"sig_re": F.col("k_re") * relative, "sig_im": F.col("k_im") * relative})  # one row
    else:
        raise ValueError(f"unknown noise mode {mode}")
    return out.select("spw", "chan", "row_id", "freq_hz", "u_m", "v_m", "w_m", "ant1", "ant2", "time_s", "re", "im", "sig_re", "sig_im", "flag")


def median_dish(ms: MeasurementSet) -> DataFrame:
    return ms.antenna.agg(F.percentile("dish_diameter", F.lit(0.5)).alias("dish_m"))


def from_hands(hands: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Cells of a legacy layout: hands (hand, re, im, sigma) averaged; a hand stored twice counts once in the noise."""
    found = hands.groupBy(*keys).agg(F.avg("re").alias("re"), F.avg("im").alias("im"), F.sum(F.col("sigma") * F.col("sigma")).alias("ss"), F.count(F.lit(1)).alias("n"), F.countDistinct("re", "im").alias("distinct_"))
    return found.select(*keys, "re", "im", (F.sqrt("ss") / F.col("n") * F.sqrt(F.col("n") / F.col("distinct_"))).alias("sigma"))
