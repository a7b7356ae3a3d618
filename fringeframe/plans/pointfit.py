"""Point components: detect on the residual image, refine, solve all fluxes together from one aggregation, stop below the cut."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.functions.sky import gaussian_taper, image_weight, phase
from fringeframe.operators import imaging
from fringeframe.operators.matrix import normal_equations


@dataclass
class Component:
    """Offsets in arcseconds in the image frame (x grows to the west), flux and its standard error."""

    x_as: float
    y_as: float
    flux: float = 0.0
    error: float = 0.0


def columns(c: Component) -> tuple[Column, Column]:
    """Real and imaginary visibility of a unit point."""
    turn = phase(F.col("u"), F.col("v"), F.lit(-c.x_as), F.lit(c.y_as))
    return F.cos(turn), -F.sin(turn)


def gaussian_columns(c: Component, major: float, minor: float, angle: float) -> tuple[Column, Column]:
    re, im = columns(c)
    taper = gaussian_taper(F.col("u"), F.col("v"), major, minor, angle)
    return re * taper, im * taper


def fluxes(points: DataFrame, found: list[Component]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(fluxes, covariance, chi square, samples) of all components at fixed places."""
    pairs = [columns(c) for c in found]
    n = len(found)
    both = [points.select("u", "v", "re", "im", "sig_re", "sig_im")]
    w = image_weight(F.col("sig_re"), F.col("sig_im"))
    re = normal_equations(both[0], [p[0] for p in pairs], F.col("re"), w)
    im = normal_equations(both[0], [p[1] for p in pairs], F.col("im"), w)
    a, b = re.crossJoin(im.select(*(F.col(c).alias(f"{c}_") for c in im.columns))).first().asDict(), None  # a row each
    f = np.zeros((n, n))
    for i in range(n):
        for j in range(i, n):
            f[i, j] = f[j, i] = a[f"f_{i}_{j}"] + a[f"f_{i}_{j}_"]
    b = np.array([a[f"d_{i}"] + a[f"d_{i}_"] for i in range(n)])
    inverse = np.linalg.inv(f)
    flux = inverse @ b
    return flux, inverse, float(a["c"] + a["c_"] - b @ flux), int(a["n"])


def pruned(points: DataFrame, found: list[Component], significance: float) -> list[Component]:
    """The components that stay when the one of least signal to noise goes again and again, all fluxes solved anew each time, until
    each is ``significance`` standard errors high. Errors grow with chi square where that is above its expectation."""
    left = list(found)
    while left:
        flux, cov, chi2, samples = fluxes(points, left)
        error = np.sqrt(np.diag(cov) * max(1.0, chi2 / (2 * samples)))
        for c, a, e in zip(left, flux, error, strict=True):
            c.flux, c.error = float(a), float(e)
        least = int(np.argmin(flux / error))
        if flux[least] >= significance * error[least]:
            break
        left.pop(least)
    return left


def residual(points: DataFrame, found: list[Component]) -> DataFrame:
    re, im = F.col("re"), F.col("im")
    for c in found:
        a, b = columns(c)
        re, im = re - F.lit(c.flux) * a, im - F.lit(c.flux) * b
    return points.withColumns({"re": re, "im": im})


def scan(points: DataFrame, accepted: list[Component], n: int, fov_arcsec: float) -> DataFrame:
    """(pix_y, pix_x, amplitude, significance): matched filter of a further point at every pixel beside the ``accepted`` ones.

    At a pixel r = d - b'C^-1 d_k and s = c - b'C^-1 b, with d and d_k the data's sums at the pixel and at the accepted points, b and C
    the sums between points; all sums at pixels come from one scan. Pixels that the accepted points explain (s near 0) have
    null amplitude.
    """
    w = imaging.weighted(points)
    y, x = imaging.grid(n, fov_arcsec)
    planes = [imaging.Plane("d", y, x, "w_re", "w_im")]
    for k, c in enumerate(accepted):  # sums between a pixel and an accepted point: the beam moved there
        planes.append(imaging.Plane(f"b{k}", tuple(v - c.y_as for v in y), tuple(v + c.x_as for v in x), "sum_w"))
    long = imaging.one_pass(w, planes, ["sum_w"])
    total = float(long.where("plane = 'sum_w'").first()["value"])
    wide = long.where("plane <> 'sum_w'").groupBy("pix_y", "pix_x").agg(*(F.sum(F.when(F.col("plane") == p.name, F.col("value"))).alias(p.name) for p in planes))
    r, s = F.col("d"), F.lit(total)
    if accepted:
        _, inverse, _, _ = fluxes(points, accepted)
        own = w.select(*(F.sum(F.cos(turn) * F.col("w_re") - F.sin(turn) * F.col("w_im")).alias(f"d{k}") for k, turn in enumerate(phase(F.col("u"), F.col("v"), F.lit(-c.x_as), F.lit(c.y_as)) for c in accepted))).first()
        at = [float(v) for v in inverse @ np.array(list(own))]
        for k, a in enumerate(at):
            r = r - F.col(f"b{k}") * F.lit(a)
            for j in range(len(accepted)):
                s = s - F.col(f"b{k}") * F.col(f"b{j}") * F.lit(float(inverse[k, j]))
    free = s > 1e-9 * total
    return wide.select("pix_y", "pix_x", F.when(free, r / s).alias("amplitude"), F.when(free, F.abs(r) / F.sqrt(s)).alias("significance"))


def detect(points: DataFrame, n: int, fov_arcsec: float, significance: float = 5.0, most: int = 5, apart: float = 0.0) -> list[Component]:
    """Components of at least ``significance`` standard errors, ``apart`` arcseconds from each other, brightest first.

    Each round images the residual in one pass, takes its highest pixel, refines it by a parabola through the neighbours, and
    solves all fluxes again; it ends with the first candidate below the cut.
    """
    found: list[Component] = []
    step = fov_arcsec / n
    while len(found) < most:
        image = imaging.dirty_image(residual(points, found), n, fov_arcsec).toPandas()
        d = np.zeros((n, n))
        d[image.pix_y, image.pix_x] = image.dirty
        iy, ix = np.mgrid[0:n, 0:n]
        x, y = (ix - (n - 1) / 2) * step, -(iy - (n - 1) / 2) * step
        for c in found:
            d[np.hypot(x - c.x_as, y - c.y_as) <= apart] = -np.inf
        top = np.unravel_index(int(np.argmax(d)), d.shape)
        at = [float(k) for k in top]
        for axis in (0, 1):
            k = top[axis]
            if 0 < k < n - 1:
                near = [d[tuple(k + s if a == axis else top[a] for a in (0, 1))] for s in (-1, 0, 1)]
                bend = near[0] - 2 * near[1] + near[2]
                if np.isfinite(bend) and bend < 0:
                    at[axis] += float(np.clip(0.5 * (near[0] - near[2]) / bend, -0.5, 0.5))
        new = Component((at[1] - (n - 1) / 2) * step, -(at[0] - (n - 1) / 2) * step)
        flux, cov, chi2, samples = fluxes(points, [*found, new])
        scale = max(1.0, chi2 / (2 * samples))
        error = np.sqrt(np.diag(cov) * scale)
        if flux[-1] <= 0 or flux[-1] < significance * error[-1]:
            break
        found.append(new)
        for c, a, e in zip(found, flux, error, strict=True):
            c.flux, c.error = float(a), float(e)
    return sorted(pruned(points, found, significance), key=lambda c: -c.flux)
