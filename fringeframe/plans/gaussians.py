"""Joint fits of points and Gaussians to all samples, and images of what was fitted."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions.sky import ARCSEC
from fringeframe.plans.products import Beam
from fringeframe.session import held

#: Samples whose model columns are held at a time.
ROWS = 8192
#: Parameters of a component in order; widths are fitted as their logarithms.
NAMES = ("flux", "x_as", "y_as", "major", "minor", "angle")


@dataclass(frozen=True)
class Source:
    """A point (major None) or a Gaussian: offsets and widths (standard deviations) in arcseconds, angle in radians.

    x grows to the west as in the images; ``held`` names the parameters that a fit leaves as they are.
    """

    flux: float
    x_as: float
    y_as: float
    major: float | None = None
    minor: float | None = None
    angle: float = 0.0
    held: tuple[str, ...] = ()
    errors: dict[str, float] = field(default_factory=dict, compare=False)

    def free(self) -> list[str]:
        return [n for n in (NAMES if self.major is not None else NAMES[:3]) if n not in self.held]


def packed(sources: Sequence[Source]) -> np.ndarray:
    """Free parameters of all sources, widths as logarithms."""
    return np.array([math.log(getattr(s, n)) if n in ("major", "minor") else getattr(s, n) for s in sources for n in s.free()])


def unpacked(sources: Sequence[Source], values: np.ndarray) -> list[Source]:
    out, at = [], 0
    for s in sources:
        names = s.free()
        own = {n: float(math.exp(v)) if n in ("major", "minor") else float(v) for n, v in zip(names, values[at : at + len(names)], strict=True)}
        out.append(replace(s, **own))
        at += len(names)
    return out


def model_columns(sources: Sequence[Source], u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(model visibility, its derivatives by the free parameters) of samples."""
    turn, spread = 2 * math.pi * ARCSEC, 2 * math.pi**2 * ARCSEC**2
    total, columns = np.zeros(len(u), complex), []
    for s in sources:
        unit = np.exp(-1j * turn * (v * s.y_as - u * s.x_as))
        by = {}
        if s.major is not None:
            c, q = math.cos(s.angle), math.sin(s.angle)
            along, across = v * c - u * q, u * c + v * q
            unit = unit * np.exp(-spread * ((s.major * along) ** 2 + (s.minor * across) ** 2))
            by = {"major": -2 * spread * (s.major * along) ** 2, "minor": -2 * spread * (s.minor * across) ** 2, "angle": -2 * spread * (s.minor**2 - s.major**2) * along * across}
        whole = s.flux * unit
        total += whole
        by |= {"x_as": 1j * turn * u, "y_as": -1j * turn * v}
        columns += [unit if n == "flux" else by[n] * whole for n in s.free()]
    return total, np.stack(columns, axis=1) if columns else np.zeros((len(u), 0), complex)


def step_sums(points: DataFrame, sources: Sequence[Source]) -> DataFrame:
    """(i, j, f), i <= j: sums over all samples of weighted products of the Jacobian's columns and, last, the residual.

    points: u, v, re, im, sig_re, sig_im. A task adds its batches to one small matrix and emits it once; only sums of them move. The block of
    the columns is J'WJ, the last column J'Wr, the corner chi square.
    """
    own = list(sources)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            every = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            every = every[:, np.isfinite(every).all(axis=0)]
            for at in range(0, every.shape[1], ROWS):
                u, v, re, im, sr, si = every[:, at : at + ROWS]
                model, columns = model_columns(own, u, v)
                whole = np.column_stack([columns, re + 1j * im - model])
                a, b = whole.real / sr[:, None], whole.imag / si[:, None]
                part = a.T @ a + b.T @ b
                total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "f"])

    kept = points.where("sig_re > 0 and sig_im > 0").select("u", "v", "re", "im", "sig_re", "sig_im")
    return kept.mapInArrow(run, "i int, j int, f double").groupBy("i", "j").agg(F.sum("f").alias("f"))


def merged(points: DataFrame) -> tuple[DataFrame, float]:
    """(samples, rest): those of one place (u, v) as their weighted mean, and the chi square that lies between them whatever the model.

    A model says the same of all samples of a place, so ``step_sums`` of the means are those of the samples, but for ``rest`` in the corner. Written
    once; a fit's rounds read places, not samples. Where every sample has a place of its own nothing is saved and nothing is lost.
    """
    values = ("u", "v", "re", "im", "sig_re", "sig_im")
    kept = points.select(*(F.col(c).cast("double").alias(c) for c in values)).where("sig_re > 0 and sig_im > 0")
    for c in values:
        kept = kept.where(F.abs(c) < float("inf"))  # NaN counts as larger
    sums, means, rest = [], [], []
    for part in ("re", "im"):
        one = F.lit(1.0) / F.col(f"sig_{part}")
        weight, value = one * one, F.col(part)
        sums += [F.sum(weight).alias(f"w_{part}"), F.sum(weight * value).alias(f"x_{part}"), F.sum(weight * value * value).alias(f"xx_{part}")]
        w, x = F.greatest(F.col(f"w_{part}"), F.lit(1e-300)), F.col(f"x_{part}")
        means += [(x / w).alias(part), (F.lit(1.0) / F.sqrt(w)).alias(f"sig_{part}")]
        rest.append(F.col(f"xx_{part}") - x * (x / w))
    found = held(kept.groupBy("u", "v").agg(*sums).select("u", "v", *means, (rest[0] + rest[1]).alias("rest")))
    return found.select(*values), float(found.agg(F.sum("rest")).first()[0] or 0.0)


def _collected(points: DataFrame, rest: float, sources: Sequence[Source]) -> tuple[np.ndarray, np.ndarray, float]:
    """J'WJ, J'Wr and chi square of merged samples; (parameters + 1)^2 numbers leave Spark."""
    n = len(packed(sources)) + 1
    m = np.zeros((n, n))
    for i, j, f in step_sums(points, sources).collect():
        m[i, j] = m[j, i] = f
    return m[:-1, :-1], m[:-1, -1], float(m[-1, -1]) + rest


@dataclass(frozen=True)
class Fit:
    sources: list[Source]
    chi2: float
    rounds: int
    settled: bool


def fit(points: DataFrame, sources: Sequence[Source], most: int = 40, accuracy: float = 1e-9) -> Fit:
    """Sources at the least chi square near the given ones, with standard errors, by damped Gauss-Newton steps.

    The samples are merged by place in one pass. Each round is one over the places, whose sums say both whether the last step was a good one and where the next one goes. It ends
    when chi square falls by less than ``accuracy`` of itself or no damping helps; after ``most`` rounds the best so far is returned,
    which ``settled`` tells.
    """
    at = packed(sources)
    places, rest = merged(points)
    f, d, chi2 = _collected(places, rest, sources)
    damping, rounds = 1e-3, 1
    wide = np.array([n in ("major", "minor") for s in sources for n in s.free()])
    while rounds < most:
        # A parameter that the data hardly feel is held by the least of damping; a width changes by a factor of e at most.
        scale = np.maximum(np.diag(f), 1e-9 * max(float(np.diag(f).max(initial=0.0)), 1e-300))
        step = np.linalg.solve(f + damping * np.diag(scale), d)
        step = np.where(wide, np.clip(step, -1.0, 1.0), step)
        trial = unpacked(sources, at + step)
        g, e, now = _collected(places, rest, trial)
        rounds += 1
        if now <= chi2:
            small = chi2 - now <= accuracy * max(chi2, 1e-300)
            at, f, d, chi2, damping = at + step, g, e, now, max(damping / 10, 1e-12)
            if small:
                break
        else:
            damping *= 10
            if damping > 1e10:
                break
    errors, out, k = np.sqrt(np.maximum(np.diag(np.linalg.pinv(f)), 0.0)), [], 0
    for s in unpacked(sources, at):
        names = s.free()
        widths = {n: getattr(s, n) if n in ("major", "minor") else 1.0 for n in names}
        out.append(replace(s, errors={n: float(x * widths[n]) for n, x in zip(names, errors[k : k + len(names)], strict=True)}))
        k += len(names)
    return Fit(out, chi2, rounds, rounds < most)


def covariance(major: Column, minor: Column, angle: Column) -> tuple[Column, Column, Column]:
    """xx, yy and xy of a Gaussian in the image."""
    s, c = F.sin(angle), F.cos(angle)
    a, b = major * major, minor * minor
    return a * s * s + b * c * c, a * c * c + b * s * s, (a - b) * s * c


def restored(sources: DataFrame, beam: Beam, n: int, step: float, reach: float = 6.0) -> DataFrame:
    """(pix_y, pix_x, value): sources (flux, x_as, y_as, major, minor, angle; widths 0 for points) seen through a beam of unit peak.

    A source goes to the pixels within ``reach`` of its widths along rows and columns, on the image of n x n pixels alone, and is added there. A
    point of flux F peaks at F; a Gaussian is its convolution with the beam. Pixels that nothing reaches have no row.
    """
    bt = math.pi - math.radians(beam.angle)
    bx, by, bxy = covariance(F.lit(beam.major), F.lit(beam.minor), F.lit(bt))
    xx, yy, xy = covariance(F.col("major"), F.col("minor"), F.col("angle"))
    put = sources.select("flux", "x_as", "y_as", (xx + bx).alias("xx"), (yy + by).alias("yy"), (xy + bxy).alias("xy"))
    middle = (n - 1) / 2
    row, col = F.lit(middle) - F.col("y_as") / step, F.col("x_as") / step + F.lit(middle)

    def span(at: Column, width: Column) -> Column:
        low, high = F.greatest(F.ceil(at - width / step), F.lit(0)), F.least(F.floor(at + width / step), F.lit(n - 1))
        return F.when(low <= high, F.sequence(low.cast("int"), high.cast("int")))

    put = put.withColumn("pix_y", F.explode(span(row, reach * F.sqrt("yy")))).withColumn("pix_x", F.explode(span(col, reach * F.sqrt("xx"))))
    dx, dy = (F.col("pix_x") - middle) * step - F.col("x_as"), (middle - F.col("pix_y")) * step - F.col("y_as")
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    far = (F.col("yy") * dx * dx - 2 * F.col("xy") * dx * dy + F.col("xx") * dy * dy) / det
    value = F.col("flux") * F.lit(beam.major * beam.minor) * F.exp(-far / 2) / F.sqrt(det)
    return put.select("pix_y", "pix_x", value.alias("value")).groupBy("pix_y", "pix_x").agg(F.sum("value").alias("value"))
