"""Emission masks from region files and FITS images: shapes become rows, pixels meet them, exclusions win."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.operators.wcs import Grid, resampled
from fringeframe.sources.files import fits_image

#: A shape, its first pair (the centre) and the numbers after it; a leading - excludes.
SHAPE = re.compile(r"^\s*(?P<sign>[-+]?)\s*(?P<kind>circle|ellipse|centerbox|rotbox)\s*\[\s*\[(?P<centre>[^\]]*)\]\s*,\s*(?P<rest>.*)\]\s*(?:coord=.*)?$", re.IGNORECASE)
NUMBER = re.compile(r"([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*(deg|arcsec|arcmin|rad|pix)?")
TO_ARCSEC = {"deg": 3600.0, "arcsec": 1.0, "arcmin": 60.0, "rad": 206264.80624709636, "pix": 1.0, "": 1.0}


def shapes(text: str) -> list[tuple[bool, str, float, float, float, float, float]]:
    """(include, kind, x_as, y_as, a, b, angle in degrees) of each line, offsets and sizes in arcseconds."""
    out = []
    for line in text.splitlines():
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        found = SHAPE.match(line)
        if not found:
            raise ValueError(f"not a region: {line!r}")
        x, y = (float(v) * TO_ARCSEC[u] for v, u in NUMBER.findall(found["centre"]))
        sizes = NUMBER.findall(found["rest"])
        kind = found["kind"].lower()
        a = float(sizes[0][0]) * TO_ARCSEC[sizes[0][1]]
        b = float(sizes[1][0]) * TO_ARCSEC[sizes[1][1]] if len(sizes) > 1 else a
        angle = float(sizes[2][0]) if len(sizes) > 2 else 0.0
        out.append((found["sign"] != "-", "circle" if kind == "circle" else "ellipse" if kind == "ellipse" else "box", x, y, a, b, angle))
    return out


def from_fits(spark: SparkSession, raw: bytes, grid: Grid, least: float = 0.5) -> DataFrame:
    """(pix_y, pix_x) of ``grid`` where the nearest pixel of a mask image (the bytes of a FITS file with a projection) is above ``least``.

    A mask on a grid of its own is carried over on the sky; further axes of length one are left aside. An empty result refuses.
    """
    header, array = fits_image(raw)
    array = array.reshape(array.shape[-2:]) if array.size == array.shape[-1] * array.shape[-2] else array
    if array.ndim != 2:
        raise ValueError(f"a mask has two axes, not {array.ndim}")
    y, x = (a.tolist() for a in np.nonzero(np.nan_to_num(array) > least))
    mask = spark.createDataFrame(list(zip(y, x)), "pix_y int, pix_x int").withColumn("in_", F.lit(True))
    kept = resampled(mask, "in_", Grid.of(header), grid).select("pix_y", "pix_x")
    if kept.isEmpty():
        raise ValueError("the mask is empty")
    return kept


def rasterised(spark: SparkSession, pixels: DataFrame, text: str) -> DataFrame:
    """(pix_y, pix_x) inside a shape and in no excluded one; an empty result refuses."""
    rows = spark.createDataFrame(shapes(text), "include boolean, kind string, cx double, cy double, a double, b double, angle double")
    dx, dy = F.col("x_as") - F.col("cx"), F.col("y_as") - F.col("cy")
    c, s = F.cos(F.radians("angle")), F.sin(F.radians("angle"))
    along, across = dx * c + dy * s, dy * c - dx * s
    round_ = F.pow(along / F.col("a"), 2) + F.pow(across / F.col("b"), 2) <= 1
    box = (F.abs(along) <= F.col("a") / 2) & (F.abs(across) <= F.col("b") / 2)
    inside = F.when(F.col("kind") == "box", box).otherwise(round_)
    met = pixels.join(F.broadcast(rows), inside).groupBy("pix_y", "pix_x").agg(F.bool_or("include").alias("in_"), F.bool_or(~F.col("include")).alias("out_"))  # the lines of a region file
    kept = met.where("in_ and not out_").select("pix_y", "pix_x")
    if kept.isEmpty():
        raise ValueError("the mask is empty")
    return kept
