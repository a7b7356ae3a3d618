"""Images on the sky: gnomonic and orthographic projections as column expressions, and values carried from one grid to another."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """n_y x n_x pixels about a reference: its place in degrees and in pixels (from 0), steps in degrees, turn in degrees, TAN or SIN."""

    ra: float
    dec: float
    ref_x: float
    ref_y: float
    step_x: float
    step_y: float
    n_x: int
    n_y: int
    turn: float = 0.0
    kind: str = "SIN"

    def __post_init__(self):
        if self.kind not in ("SIN", "TAN"):
            raise ValueError(f"no such projection: {self.kind}")

    @classmethod
    def of(cls, header: dict) -> Grid:
        """From the cards of an image; places in a header count from 1, further axes are left aside."""
        kinds = {str(header.get(f"CTYPE{k}", ""))[-3:] for k in (1, 2)}
        if len(kinds) != 1:
            raise ValueError(f"axes of different kinds: {sorted(kinds)}")
        return cls(*(float(header[k]) for k in ("CRVAL1", "CRVAL2")), float(header["CRPIX1"]) - 1, float(header["CRPIX2"]) - 1, float(header["CDELT1"]), float(header["CDELT2"]), int(header["NAXIS1"]), int(header["NAXIS2"]), float(header.get("CROTA2", 0.0)), kinds.pop())

    def cards(self) -> dict[str, object]:
        """The cards that ``of`` reads, without the sides, which belong to the array."""
        return {"CTYPE1": f"RA---{self.kind}", "CTYPE2": f"DEC--{self.kind}", "CRVAL1": self.ra, "CRVAL2": self.dec, "CRPIX1": self.ref_x + 1, "CRPIX2": self.ref_y + 1, "CDELT1": self.step_x, "CDELT2": self.step_y, **({"CROTA2": self.turn} if self.turn else {})}

    def shifted(self, x_as: float, y_as: float) -> Grid:
        """The same grid with its reference moved by offsets in arcseconds (x to the west), as recentring moves it."""
        dec = self.dec + y_as / 3600
        return Grid(self.ra - x_as / 3600 / math.cos(math.radians(self.dec)), dec, self.ref_x, self.ref_y, self.step_x, self.step_y, self.n_x, self.n_y, self.turn, self.kind)

    def sky(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Right ascension (0 to 360) and declination in degrees of pixels; null beyond the sky's edge."""
        c, s = math.cos(math.radians(self.turn)), math.sin(math.radians(self.turn))
        a, b = (x - F.lit(self.ref_x)) * F.lit(math.radians(self.step_x)), (y - F.lit(self.ref_y)) * F.lit(math.radians(self.step_y))
        along, up = a * c - b * s, a * s + b * c
        sin0, cos0 = math.sin(math.radians(self.dec)), math.cos(math.radians(self.dec))
        r2 = along * along + up * up
        toward = F.lit(1.0) / F.sqrt(r2 + 1.0) if self.kind == "TAN" else F.when(r2 <= 1.0, F.sqrt(1.0 - r2))
        scale = toward if self.kind == "TAN" else F.lit(1.0)
        east, north = along * scale, up * scale
        dec = F.asin(north * cos0 + toward * sin0)
        ra = F.atan2(east, toward * cos0 - north * sin0)
        return F.pmod(F.degrees(ra) + F.lit(self.ra), F.lit(360.0)), F.degrees(dec)

    def pixels(self, ra: Column, dec: Column) -> tuple[Column, Column]:
        """Places (x, y) of points on the sky in degrees; null behind the sky's edge."""
        t, d = F.radians(ra - F.lit(self.ra)), F.radians(dec)
        sin0, cos0 = math.sin(math.radians(self.dec)), math.cos(math.radians(self.dec))
        toward = F.sin(d) * sin0 + F.cos(d) * cos0 * F.cos(t)
        scale = F.when(toward > 0, F.lit(1.0) / toward) if self.kind == "TAN" else F.when(toward > 0, F.lit(1.0))
        along, up = F.cos(d) * F.sin(t) * scale, (F.sin(d) * cos0 - F.cos(d) * sin0 * F.cos(t)) * scale
        c, s = math.cos(math.radians(self.turn)), math.sin(math.radians(self.turn))
        a, b = along * c + up * s, up * c - along * s
        return a / F.lit(math.radians(self.step_x)) + F.lit(self.ref_x), b / F.lit(math.radians(self.step_y)) + F.lit(self.ref_y)


def resampled(image: DataFrame, value: str, source: Grid, target: Grid) -> DataFrame:
    """(pix_y, pix_x, value) of ``target``: each of its pixels takes the value of the source pixel whose centre is nearest; none, no row.

    Target pixels are made where they are needed and meet the image by whole pixel numbers, so both sides shuffle by place and
    neither is held.
    """
    made = image.sparkSession.range(target.n_x * target.n_y).select(F.floor(F.col("id") / target.n_x).cast("int").alias("pix_y"), (F.col("id") % target.n_x).cast("int").alias("pix_x"))
    x, y = source.pixels(*target.sky(F.col("pix_x"), F.col("pix_y")))
    made = made.withColumns({"sx_": F.floor(x + 0.5).cast("int"), "sy_": F.floor(y + 0.5).cast("int")})
    inside = made.where(F.col("sx_").between(0, source.n_x - 1) & F.col("sy_").between(0, source.n_y - 1))
    from_ = image.select(F.col("pix_y").alias("sy_"), F.col("pix_x").alias("sx_"), F.col(value).alias(value))
    return inside.join(from_, ["sy_", "sx_"]).select("pix_y", "pix_x", value)
