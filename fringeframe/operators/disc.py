"""Tilings of a disc by rings of cells, and the disc's own visibility."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeframe.functions.sky import ARCSEC, bessel_j1
from fringeframe.session import held

#: Nodes of a part, which a task holds (24 MB); nodes and samples that meet at once.
NODES, SOME, ROWS = 1 << 20, 1 << 12, 1 << 10


def rings(spark: SparkSession, n: int, radius: float) -> DataFrame:
    """(ring, cells, first_cell, r_in, r_out, centroid): equal widths, about square cells, numbered through. A row for each ring."""
    width = radius / n
    made = spark.range(n).select(F.col("id").alias("ring"), F.greatest(F.lit(1), F.rint(F.lit(2 * math.pi) * (F.col("id") + 0.5)).cast("long")).alias("cells"))
    before = F.coalesce(F.sum("cells").over(Window.orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    r0, r1 = F.col("ring") * F.lit(width), (F.col("ring") + 1) * F.lit(width)
    return made.withColumns({"first_cell": before, "r_in": r0, "r_out": r1, "centroid": F.lit(2 / 3) * (F.pow(r1, 3) - F.pow(r0, 3)) / (F.pow(r1, 2) - F.pow(r0, 2))})


def cells(spark: SparkSession, n: int, radius: float) -> DataFrame:
    """(cell_id, ring, r_in, r_out, th_lo, th_hi, area, x_as, y_as) of all cells."""
    each = rings(spark, n, radius).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    turn = F.lit(2 * math.pi) / F.col("cells")
    made = each.withColumns({"th_lo": F.col("k") * turn, "th_hi": (F.col("k") + 1) * turn, "cell_id": F.col("first_cell") + F.col("k")})
    middle = (F.col("th_lo") + F.col("th_hi")) / 2.0
    half = (F.col("th_hi") - F.col("th_lo")) / 2.0
    r = F.col("centroid") * F.sin(half) / half
    return made.select("cell_id", "ring", "r_in", "r_out", "th_lo", "th_hi", (half * (F.pow("r_out", 2) - F.pow("r_in", 2))).alias("area"), (r * F.cos(middle)).alias("x_as"), (r * F.sin(middle)).alias("y_as"))


def uniform_disc(u: Column, v: Column, radius_arcsec: float) -> Column:
    """2 J1(z) / z with z = 2 pi R q; 1 at the origin."""
    z = F.lit(2 * math.pi * ARCSEC * radius_arcsec) * F.sqrt(u * u + v * v)
    return F.when(z <= 1e-8, F.lit(1.0)).otherwise(F.lit(2.0) * bessel_j1(z) / F.greatest(z, F.lit(1e-8)))


def nodes(made: DataFrame, longest: float, turn: float = 0.5) -> DataFrame:
    """(cell_id, x_as, y_as, share): places in each of the cells ``made`` that stand for equal parts of its area.

    A cell is cut until a baseline of ``longest`` wavelengths sees at most ``turn`` radians of phase across a part, along the radius and along the
    arc; large cells and long baselines get more of them.
    """
    steps = lambda length: F.greatest(F.ceil(length * F.lit(2 * math.pi * ARCSEC * longest / turn)), F.lit(1)).cast("int")
    cut = made.select("cell_id", "r_in", "r_out", "th_lo", "th_hi", "area", steps(F.col("r_out") - F.col("r_in")).alias("n_r"), steps(F.col("r_out") * (F.col("th_hi") - F.col("th_lo"))).alias("n_t"))
    cut = cut.withColumn("k_r", F.explode(F.sequence(F.lit(0), F.col("n_r") - 1))).withColumn("k_t", F.explode(F.sequence(F.lit(0), F.col("n_t") - 1)))
    low, high = F.col("r_in") * F.col("r_in"), F.col("r_out") * F.col("r_out")
    r = F.sqrt(low + (high - low) * (F.col("k_r") + 0.5) / F.col("n_r"))  # rings of equal area
    t = F.col("th_lo") + (F.col("th_hi") - F.col("th_lo")) * (F.col("k_t") + 0.5) / F.col("n_t")
    return cut.select("cell_id", (r * F.cos(t)).alias("x_as"), (r * F.sin(t)).alias("y_as"), (F.col("area") / (F.col("n_r") * F.col("n_t"))).alias("share"))


def cell_visibilities(points: DataFrame, places: DataFrame, values: DataFrame) -> DataFrame:
    """``points`` (with u, v) with model_re, model_im: the disc whose cells have the brightness ``values`` (cell_id, value), seen through its nodes.

    Nodes go to the tasks NODES at a time, so what one holds is bounded however fine the disc; a part is a pass over the samples, which stay
    where they are.
    """
    lit = places.join(values, "cell_id").select((F.col("share") * F.col("value")).alias("w"), "x_as", "y_as")
    kept = [c for c in points.columns if c not in ("model_re", "model_im")]
    out = points.select(*kept, F.lit(0.0).alias("model_re"), F.lit(0.0).alias("model_im"))
    kind = "re double, im double"
    part: list[tuple[float, float, float]] = []

    def seen(own: np.ndarray):
        def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for u, v in batches:
                a, b = (x.to_numpy(zero_copy_only=False).astype(float) for x in (u, v))
                total = np.zeros(len(a), complex)
                for at in range(0, len(a), ROWS):
                    cut = slice(at, at + ROWS)
                    for first in range(0, len(own), SOME):
                        w, x, y = own[first : first + SOME].T
                        total[cut] += np.exp(-2j * math.pi * ARCSEC * (np.outer(b[cut], y) - np.outer(a[cut], x))) @ w
                yield pa.StructArray.from_arrays([pa.array(total.real), pa.array(total.imag)], ["re", "im"])

        return F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)

    def added(df: DataFrame, rows: list[tuple[float, float, float]]) -> DataFrame:
        met = df.withColumn("seen_", seen(np.array(rows, float))(F.col("u").cast("double"), F.col("v").cast("double")))
        return met.select(*kept, (F.col("model_re") + F.col("seen_.re")).alias("model_re"), (F.col("model_im") + F.col("seen_.im")).alias("model_im"))

    for row in lit.toLocalIterator():
        part.append(tuple(row))
        if len(part) == NODES:
            out, part = held(added(out, part)), []
    return added(out, part) if part else out


def rendered(pixels: DataFrame, made_rings: DataFrame, values: DataFrame, step: float, fine: int = 4) -> DataFrame:
    """(pix_y, pix_x, value): brightness of the disc on ``pixels`` (pix_y, pix_x, x_as, y_as), the mean of ``fine`` x ``fine`` places in each.

    A place finds its ring by its distance and its cell by its angle, so cells meet pixels on the cell's number; places off the disc count as dark, and
    pixels without a lit place have no row.
    """
    offset = F.array(*(F.struct(F.lit((i + 0.5) / fine - 0.5).alias("y"), F.lit((j + 0.5) / fine - 0.5).alias("x")) for i in range(fine) for j in range(fine)))
    spread = pixels.select("pix_y", "pix_x", "x_as", "y_as", F.explode(offset).alias("o")).select("pix_y", "pix_x", (F.col("x_as") + F.col("o.x") * step).alias("x"), (F.col("y_as") + F.col("o.y") * step).alias("y"))
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    width = made_rings.agg(F.max(F.col("r_out") - F.col("r_in")).alias("width"))
    placed = spread.crossJoin(F.broadcast(width)).withColumn("ring", F.floor(r / F.col("width")).cast("long"))  # one row
    angle = F.pmod(F.atan2("y", "x"), F.lit(2 * math.pi))
    met = placed.join(made_rings.select("ring", "cells", "first_cell"), "ring")
    cell = F.col("first_cell") + F.least(F.floor(angle / F.lit(2 * math.pi) * F.col("cells")), F.col("cells") - 1)
    return met.select("pix_y", "pix_x", cell.alias("cell_id")).join(values, "cell_id").groupBy("pix_y", "pix_x").agg((F.sum("value") / F.lit(float(fine * fine))).alias("value"))
