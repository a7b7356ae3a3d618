"""Choices that follow from sizes alone, as plain functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from fringeframe.functions.sky import ARCSEC

#: Samples from which the statistics path is taken, mesh points beyond which the solve is matrix-free, data per mesh point for `structure`.
SPARSE_SAMPLES, DENSE_MESH, STRUCTURE_DATA = 5000, 10_000, 10


@dataclass(frozen=True)
class Geometry:
    fov_arcsec: float
    mesh: int
    image: int

    @property
    def mesh_step(self) -> float:
        return self.fov_arcsec / self.mesh

    @property
    def image_step(self) -> float:
        return self.fov_arcsec / self.image


def nyquist_step(longest_wavelengths: float) -> float:
    """Arcseconds: half a wavelength over the longest baseline."""
    return 0.5 / longest_wavelengths / ARCSEC


def geometry(fov_arcsec: float, longest: float, effective: float | None = None, step: float | str = "auto", oversample: int = 2) -> Geometry:
    """An even mesh of at least 8 points that tiles the field, ``oversample`` image pixels for each of its points."""
    wanted = {"auto": nyquist_step(effective or longest), "nyquist": nyquist_step(longest), "fine": nyquist_step(longest) / 2}.get(step, step)
    n = max(8, math.ceil(fov_arcsec / float(wanted)))
    n += n % 2
    return Geometry(fov_arcsec, n, n * oversample)


def inversion(n_samples: int, mesh_points: int) -> str:
    """dense: one column per mesh point over all samples; sparse: F from the kernel; free: products by convolution."""
    if mesh_points > DENSE_MESH:
        return "free"
    return "sparse" if n_samples >= SPARSE_SAMPLES else "dense"


def criterion(n_data: int, mesh_points: int) -> str:
    return "structure" if n_data / mesh_points >= STRUCTURE_DATA else "discrepancy"


def chi2_target(target: float, floor: float, n_data: int) -> float:
    """A target below what the weakest prior reaches is raised to just above it."""
    return max(target, floor * (1 + min(2 * math.sqrt(2 / n_data), 0.1)))
