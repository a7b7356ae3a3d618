"""Angles, phases, beams and component models as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres per second, and radians in an arcsecond.
LIGHT, ARCSEC = 299792458.0, math.pi / 648000.0


def wavelengths(metres: Column, hz: Column) -> Column:
    return metres * hz / F.lit(LIGHT)


def u_lambda(hz: Column, u: str = "u_m") -> Column:
    return wavelengths(F.col(u), hz)


def v_lambda(hz: Column, v: str = "v_m") -> Column:
    """Stored v has the opposite sign."""
    return -wavelengths(F.col(v), hz)


def phase(u: Column, v: Column, x_arcsec: Column, y_arcsec: Column) -> Column:
    """2 pi (u x + v y), angles in arcseconds."""
    return F.lit(2 * math.pi * ARCSEC) * (u * x_arcsec + v * y_arcsec)


def pooled_sigma(sig_re: Column, sig_im: Column) -> Column:
    return F.sqrt((sig_re * sig_re + sig_im * sig_im) / 2.0)


def image_weight(sig_re: Column, sig_im: Column) -> Column:
    return F.lit(1.0) / (F.lit(0.5) * (sig_re * sig_re + sig_im * sig_im))


def asymmetry(sig_re: Column, sig_im: Column) -> Column:
    return F.abs(sig_re - sig_im) / (F.lit(0.5) * (sig_re + sig_im))


def primary_beam_fwhm(hz: Column, dish_m: float, factor: float = 1.13) -> Column:
    """Arcseconds: factor * wavelength / dish."""
    return F.lit(factor * LIGHT / dish_m / ARCSEC) / hz


def primary_beam(x_arcsec: Column, y_arcsec: Column, fwhm: Column) -> Column:
    sigma = fwhm / F.lit(2 * math.sqrt(2 * math.log(2)))
    return F.exp(-(x_arcsec * x_arcsec + y_arcsec * y_arcsec) / (F.lit(2.0) * sigma * sigma))


def corrected(value: Column, beam: Column, cutoff: float = 0.1) -> Column:
    """value / beam; null below the cutoff."""
    return F.when(beam >= cutoff, value / beam)


def gaussian_taper(u: Column, v: Column, major: float, minor: float, angle: float) -> Column:
    """Visibility amplitude of an elliptical Gaussian of unit flux; sigmas in arcseconds, angle in radians."""
    c, s = math.cos(angle), math.sin(angle)
    along, across = v * c - u * s, u * c + v * s
    return F.exp(F.lit(-2 * math.pi**2 * ARCSEC**2) * (F.lit(major**2) * along * along + F.lit(minor**2) * across * across))


def velocity(hz: Column, rest_hz: float) -> Column:
    """Radio velocity in km/s."""
    return F.lit(LIGHT / 1e3) * (F.lit(1.0) - hz / F.lit(rest_hz))


def bessel_j1(z: Column, terms: int = 40) -> Column:
    """J1: the power series below 12, Hankel's asymptotic form above."""
    half = z / 2.0
    square = half * half
    total = term = half
    for k in range(1, terms):
        term = term * (-square) / F.lit(float(k * (k + 1)))
        total = total + term
    inverse = F.lit(1.0) / (F.lit(8.0) * z)
    p = F.lit(1.0) + F.lit(15 / 2) * inverse * inverse - F.lit(14175 / 24) * F.pow(inverse, F.lit(4.0))
    q = F.lit(3.0) * inverse - F.lit(315 / 6) * F.pow(inverse, F.lit(3.0))
    chi = z - F.lit(0.75 * math.pi)
    far = F.sqrt(F.lit(2 / math.pi) / z) * (p * F.cos(chi) - q * F.sin(chi))
    return F.when(z < 12.0, total).otherwise(far)


def grid_axis(index: Column, n: int, step: float) -> Column:
    """Centre of a pixel: (index - (n - 1) / 2) * step."""
    return (index - F.lit((n - 1) / 2.0)) * F.lit(step)
