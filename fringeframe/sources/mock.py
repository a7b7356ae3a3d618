"""Mock observations with known truth: every number comes from a hash of the row, so any partitioning gives the same table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.functions.sky import ARCSEC, LIGHT, gaussian_taper, phase
from fringeframe.operators.disc import uniform_disc


def uniform(seed: int, *keys: str | Column) -> Column:
    """In (0, 1), from a hash of the keys."""
    mark = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11)
    return (mark.cast("double") + 0.5) / F.lit(float(1 << 53))


def normal(seed: int, *keys: str | Column) -> Column:
    return F.sqrt(-2.0 * F.log(uniform(seed, *keys))) * F.cos(F.lit(2 * math.pi) * uniform(seed + 1, *keys))


@dataclass(frozen=True)
class Point:
    """Image-frame offsets in arcseconds (x grows to the west), flux in Jy."""

    x_as: float
    y_as: float
    flux: float


@dataclass(frozen=True)
class Gaussian(Point):
    major: float = 0.1
    minor: float = 0.1
    angle: float = 0.0


@dataclass(frozen=True)
class Disc(Point):
    radius: float = 0.1


def model(components: Sequence[Point]) -> tuple[Column, Column]:
    """Real and imaginary visibility of all components at (u, v)."""
    u, v = F.col("u"), F.col("v")
    re = im = F.lit(0.0)
    for c in components:
        turn = phase(u, v, F.lit(-c.x_as), F.lit(c.y_as))
        size = F.lit(c.flux)
        if isinstance(c, Gaussian):
            size = size * gaussian_taper(u, v, c.major, c.minor, c.angle)
        elif isinstance(c, Disc):
            size = size * uniform_disc(u, v, c.radius)
        re, im = re + size * F.cos(turn), im - size * F.sin(turn)
    return re, im


def observation(spark: SparkSession, n: int, components: Sequence[Point], sigma: float = 2e-4, longest_m: float = 500.0, hz: float = 230e9, channels: int = 1, windows: int = 1, seed: int = 0) -> DataFrame:
    """(spw, chan, u, v, re, im, sig_re, sig_im): random coverage thinning out to ``longest_m``, noise of ``sigma`` on either part."""
    rows = spark.range(n)
    radius = F.lit(longest_m) * F.pow(uniform(seed, "id"), F.lit(0.8))
    angle = F.lit(2 * math.pi) * uniform(seed + 10, "id")
    placed = rows.select("id", (radius * F.cos(angle)).alias("u_m"), (radius * F.sin(angle)).alias("v_m"))
    cells = placed.withColumn("spw", F.explode(F.sequence(F.lit(0), F.lit(windows - 1)))).withColumn("chan", F.explode(F.sequence(F.lit(0), F.lit(channels - 1))))
    f = F.lit(hz) + F.col("spw") * F.lit(2e9) + F.col("chan") * F.lit(2e8)
    uv = cells.withColumns({"u": F.col("u_m") * f / F.lit(LIGHT), "v": -F.col("v_m") * f / F.lit(LIGHT)})
    re, im = model(components)
    noisy = uv.select("spw", "chan", "id", "u", "v", (re + F.lit(sigma) * normal(seed + 20, "id", "spw", "chan")).alias("re"), (im + F.lit(sigma) * normal(seed + 30, "id", "spw", "chan")).alias("im"))
    return noisy.withColumns({"sig_re": F.lit(sigma), "sig_im": F.lit(sigma)})


def beam_arcsec(longest_m: float = 500.0, hz: float = 230e9) -> float:
    """About the width of the main lobe."""
    return 0.7 * LIGHT / hz / longest_m / ARCSEC
