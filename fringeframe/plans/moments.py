"""Moments of cubes: which cells count, sums over planes, maps and their record."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs

from fringeframe.operators import noise, regions
from fringeframe.sources.cubes import cube_member, read_cube, spectral_axis
from fringeframe.sources.members import place

PLACE = ("plane", "pix_y", "pix_x")
#: Files beside a cube that say which of its cells are real, in the order of preference.
BESIDE = {"snr": ("snr.fits",), "residual": ("residual.fits", "model_reconvolved.fits"), "empty": ("model_reconvolved.fits",), "self": ()}


def channels(text: str, n: int) -> list[int]:
    """Planes that a text names: "0", "0,2", "0-3", or "-1" for the last."""
    found: set[int] = set()
    for part in (p.strip() for p in text.split(",")):
        low, dash, high = part[1:].partition("-") if part.startswith("-") else part.partition("-")
        if part.startswith("-"):
            low, high = str(-int(low)), ""
        found |= {k % n for k in range(int(low), int(high) + 1)} if dash and high else {int(low) % n}
    return sorted(found)


def counted(cube: DataFrame, keep: DataFrame, least: int) -> DataFrame:
    """``cube`` with keep: the cells of ``keep`` (place, keep) in pixels with at least ``least`` of them; cells without a value don't count."""
    met = cube.join(keep, list(PLACE), "left").withColumn("keep", F.coalesce("keep", F.lit(False)) & F.col("value").isNotNull())
    if least <= 1:
        return met
    many = met.groupBy("pix_y", "pix_x").agg(F.count_if("keep").alias("many_"))
    return met.join(many, ["pix_y", "pix_x"]).withColumn("keep", F.col("keep") & (F.col("many_") >= least)).drop("many_")


def by_snr(snr: DataFrame, n_sigma: float) -> DataFrame:
    """Cells of a signal-to-noise cube at or above the cut; a cube without a single number refuses."""
    if snr.where("value is not null").isEmpty():
        raise ValueError("the signal-to-noise cube holds no number")
    return snr.select(*PLACE, (F.coalesce("value", F.lit(0.0)) >= n_sigma).alias("keep"))


def by_residual(model: DataFrame, residual: DataFrame, unit: float, n_sigma: float) -> DataFrame:
    """Cells of the model at or above the cut in its plane's noise: ``unit`` times the scaled median deviation of the residual's plane."""
    level = noise.robust_sigma(residual.where("value is not null"), "value", ("plane",)).select("plane", (F.col("sigma") * F.lit(unit * n_sigma)).alias("cut_"))
    return model.join(level, "plane").select(*PLACE, (F.coalesce("value", F.lit(0.0)) >= F.col("cut_")).alias("keep"))


def by_empty(source: DataFrame, planes: list[int], n_sigma: float) -> DataFrame:
    """Cells at or above the cut in the root mean square of planes without emission, zeros and missing cells left aside."""
    rms = regions.empty_channel_rms(source, "value", "plane", planes).first()["rms"]
    if not rms:
        raise ValueError(f"planes {planes} hold nothing but zeros: name others")
    return source.select(*PLACE, (F.coalesce("value", F.lit(0.0)) >= n_sigma * rms).alias("keep"))


def moment_maps(cells: DataFrame, axis: DataFrame) -> DataFrame:
    """(pix_y, pix_x, mom0, mom1, mom2, peak) of cells (place, value, keep) on an axis (plane, velocity)."""
    widths = regions.channel_widths(axis, "velocity", "plane")
    return regions.moments(cells.join(widths.select("plane", "velocity", "width"), "plane"), ("pix_y", "pix_x"))


@dataclass(frozen=True)
class Choice:
    mode: str
    n_sigma: float
    planes: list[int]
    least: int


def exists(path: str) -> bool:
    files, p = place(path)
    return files.get_file_info(p).type == fs.FileType.File


def run(spark: SparkSession, path: str, out: str, rest_hz: float | None = None, systemic: float = 0.0, mode: str = "auto", n_sigma: float = 5.0, empty: str = "0", least: int = 1) -> Choice:
    """Moment maps of a cube as FITS files ``out``_mom0.fits and so on, with a record ``out``_moments.json.

    ``mode`` says what tells real cells from noise, of the files beside the cube (BESIDE); auto takes the first that is there.
    """
    from fringeframe.plans.products import grid_of
    from fringeframe.sources.files import plane_bytes

    header, member = cube_member(path)
    beside = path.rsplit("/", 1)[0]
    if mode == "auto":
        mode = next(m for m, names in BESIDE.items() if all(exists(f"{beside}/{n}") for n in names))
    if mode not in BESIDE:
        raise ValueError(f"no such mask: {mode}")
    for name in BESIDE[mode]:
        if not exists(f"{beside}/{name}"):
            raise FileNotFoundError(f"{beside}/{name}")
        if cube_member(f"{beside}/{name}")[1].shape != member.shape:
            raise ValueError(f"{name} isn't as large as the cube")
    cube, planes = read_cube(spark, path), channels(empty, member.shape[0])
    other = {n: read_cube(spark, f"{beside}/{n}") for n in BESIDE[mode]}
    if mode == "snr":
        keep = by_snr(other["snr.fits"], n_sigma)
    elif mode == "residual":
        unit = next((float(h["RMS"]) for n in BESIDE[mode] if (h := cube_member(f"{beside}/{n}")[0]).get("RMS")), None)
        if unit is None:
            raise ValueError("residual.fits has no RMS card that puts it into units of the model")
        keep = by_residual(other["model_reconvolved.fits"], other["residual.fits"], unit, n_sigma)
    else:
        keep = by_empty(other.get("model_reconvolved.fits", cube), planes, n_sigma)
    maps = moment_maps(counted(cube, keep, least), spectral_axis(spark, path, rest_hz, systemic)).cache()
    files, root = place(out)
    files.create_dir(root.rsplit("/", 1)[0], recursive=True)
    unit = str(header.get("BUNIT", "")).strip()
    n_y, n_x = member.shape[1:]
    for name, kind in (("mom0", f"{unit} km/s"), ("mom1", "km/s"), ("mom2", "km/s"), ("peak", unit)):
        with files.open_output_stream(f"{root}_{name}.fits") as f:
            f.write(plane_bytes(maps, name, n_y, abs(float(header.get("CDELT2", 1.0))) * 3600, {**grid_of(header), "BUNIT": kind}, n_x))
    maps.unpersist()
    choice = Choice(mode, n_sigma, planes, least)
    with files.open_output_stream(f"{root}_moments.json") as f:
        f.write(json.dumps({"cube": path, **vars(choice)}, sort_keys=True).encode())
    return choice
