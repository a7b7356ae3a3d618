"""Points of an adaptive mesh: denser where the image is bright, in the order of the Hilbert curve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.functions.hilbert import hilbert_index
from fringeframe.session import held

#: Cells of a stretch of the curve that one task orders.
STRETCH = 1 << 16


def running_density(placed: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """``placed`` (at, density, ...) with ``to``, the density up to and with each cell along the curve, and ``all``.

    The curve is cut into stretches of ``stretch`` cells, each summed alone; only one number for each stretch is ordered as a whole.
    """
    cut = placed.withColumn("stretch_", F.floor(F.col("at") / stretch))
    whole = Window.orderBy("stretch_").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("stretch_").agg(F.sum("density").alias("own_"))
    bases = sums.select("stretch_", F.coalesce(F.sum("own_").over(whole), F.lit(0.0)).alias("base_")).crossJoin(sums.agg(F.sum("own_").alias("all")))  # one row
    inside = Window.partitionBy("stretch_").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return cut.withColumn("in_", F.sum("density").over(inside)).join(bases, "stretch_").withColumn("to", F.col("base_") + F.col("in_")).drop("stretch_", "in_", "base_")


def hilbert_points(image: DataFrame, value: str, bits: int, n: int, power: float = 2.0, floor: float = 1e-2, mask: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """(pix_y, pix_x, points): how many of ``n`` points fall on each pixel when equal steps of summed density along the curve each drop one.

    Density is max((value+ / peak)^power, floor), and 1 everywhere in an image without a positive value. With a mask (pix_y, pix_x) its pixels alone
    have density and give the peak.
    """
    if mask is not None:
        image = image.join(mask.select("pix_y", "pix_x").distinct(), ["pix_y", "pix_x"], "left_semi")
    peak = image.agg(F.max(value).alias("peak_"))
    bright = F.greatest(F.pow(F.greatest(F.col(value), F.lit(0.0)) / F.col("peak_"), F.lit(power)), F.lit(floor))
    placed = image.crossJoin(F.broadcast(peak)).select("pix_y", "pix_x", F.when(F.col("peak_") > 0, bright).otherwise(F.lit(1.0)).alias("density"), hilbert_index(F.col("pix_y"), F.col("pix_x"), bits).alias("at"))  # one row
    summed = running_density(held(placed), stretch)
    count = lambda c: F.floor(c / F.col("all") * n + F.lit(0.5 - 1e-9))
    return summed.withColumn("points", count(F.col("to")) - count(F.col("to") - F.col("density"))).where("points > 0").select("pix_y", "pix_x", "points")
