"""Regularised inversion from sufficient statistics: one distributed pass gives arrays of mesh size, a small solve follows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeframe.operators import imaging

#: Mesh points up to which the dense solve is used.
MOST_MESH = 2500
#: log10 range and width of the search for the prior's strength.
DECADES, WIDTH = (0.0, 9.0), 0.1


@dataclass
class Terms:
    """kernel (2n, 2n) with zero lag at (n, n), dirty image sums (n, n) and the additive scalars."""

    kernel: np.ndarray
    dirty: np.ndarray
    n_vis: int
    sum_w: float
    data_term: float
    noise_norm: float

    @property
    def curvature(self) -> np.ndarray:
        """F between all pairs of pixels: the kernel at their lag."""
        n = len(self.dirty)
        y, x = (a.reshape(-1) for a in np.mgrid[0:n, 0:n])
        return self.kernel[y[None, :] - y[:, None] + n, x[None, :] - x[:, None] + n]


def collect_terms(points: DataFrame, n: int, fov_arcsec: float) -> Terms:
    """The arrays of an n x n mesh; their size depends on the mesh alone, not on the number of samples."""
    if n * n > MOST_MESH:
        raise ValueError(f"a dense solve takes {MOST_MESH} mesh points at most")
    found = imaging.terms(points, n, fov_arcsec).toPandas()
    own = {name: frame for name, frame in found.groupby("plane")}
    k, d = np.zeros((2 * n, 2 * n)), np.zeros((n, n))
    for name, out in (("kernel", k), ("dirty", d)):
        out[own[name].pix_y, own[name].pix_x] = own[name].value
    n_vis, sum_w, data_term, noise_norm = (float(own[s].value.iloc[0]) for s in imaging.SCALARS)
    return Terms(k, d, round(n_vis), sum_w, data_term, noise_norm)


def covariance(n: int, step: float, scale: float, kind: str = "matern", jitter: float = 1e-8) -> np.ndarray:
    """Prior covariance of an n x n mesh with unit variance: exponential, matern (nu 3/2) or gaussian."""
    y, x = (a.reshape(-1) * step for a in np.mgrid[0:n, 0:n])
    r = np.hypot(y[:, None] - y[None, :], x[:, None] - x[None, :]) / scale
    if kind == "exponential":
        c = np.exp(-r)
    elif kind == "gaussian":
        c = np.exp(-0.5 * r * r)
    elif kind == "matern":
        c = (1 + np.sqrt(3) * r) * np.exp(-np.sqrt(3) * r)
    else:
        raise ValueError(f"unknown prior {kind}")
    return c + jitter * np.eye(len(c))


def weighted(c: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Covariance of a prior whose amplitude follows ``weight``."""
    return c * np.outer(weight, weight)


def adaptive_weight(brightness: np.ndarray, power: float = 2.0, floor: float = 1e-2) -> np.ndarray:
    """floor + (1 - floor) (brightness+ / peak)^power."""
    b = np.maximum(brightness, 0)
    return floor + (1 - floor) * (b / max(b.max(), 1e-300)) ** power


def envelope_weight(r: np.ndarray, sigma: float, floor: float = 1e-2) -> np.ndarray:
    """floor + (1 - floor) exp(-r^2 / 2 sigma^2)."""
    return floor + (1 - floor) * np.exp(-0.5 * (r / sigma) ** 2)


def gibbs_covariance(n: int, step: float, lengths: np.ndarray, jitter: float = 1e-8) -> np.ndarray:
    """Covariance whose correlation length varies from point to point."""
    y, x = (a.reshape(-1) * step for a in np.mgrid[0:n, 0:n])
    d2 = (y[:, None] - y) ** 2 + (x[:, None] - x) ** 2
    both = lengths[:, None] ** 2 + lengths[None, :] ** 2
    return 2 * np.outer(lengths, lengths) / both * np.exp(-d2 / both) + jitter * np.eye(n * n)


def log_det(a: np.ndarray) -> float:
    return 2 * float(np.log(np.diag(np.linalg.cholesky(a))).sum())


def solve_positive(a: np.ndarray, b: np.ndarray, rounds: int = 500) -> np.ndarray:
    """argmin x'ax/2 - b'x for x >= 0: an active set that takes and drops whole groups, singly once it cycles."""
    n = len(b)
    free = b > 0
    x = np.zeros(n)
    best, patience = n + 1, 3
    for _ in range(rounds):
        x[:] = 0
        if free.any():
            x[free] = np.linalg.solve(a[np.ix_(free, free)], b[free])
        slope = a @ x - b
        wrong = np.flatnonzero((free & (x < -1e-12 * max(1.0, np.abs(x).max()))) | (~free & (slope < -1e-10 * np.abs(b).max())))
        if not len(wrong):
            return np.maximum(x, 0)
        if len(wrong) < best:
            best, patience = len(wrong), 3
        else:
            patience -= 1
        free[wrong if patience > 0 else wrong[-1:]] ^= True
    raise RuntimeError("the positive solve did not settle")


@dataclass
class Trial:
    log_strength: float
    chi2: float
    log_evidence: float
    image: np.ndarray


class System:
    """F, D and the prior's inverse, kept through all trials of its strength."""

    def __init__(self, terms: Terms, step: float, scale: float, kind: str = "matern", prior: np.ndarray | None = None, beam: np.ndarray | None = None):
        """``prior``: a covariance to use instead; ``beam``: primary beam of the mesh, for a prior on the true sky."""
        self.terms, self.f, self.d = terms, terms.curvature, terms.dirty.reshape(-1)
        c = covariance(len(terms.dirty), step, scale, kind) if prior is None else prior
        if beam is not None:
            c = weighted(c, np.clip(beam.reshape(-1), 0.1, 1.0))
        self.h = np.linalg.inv(c)
        self.log_h = log_det(self.h)
        # Roots of both parts, columns reversed. F is a sum of squares: eigenvalues below zero are rounding, which grows with the weights.
        size, turn = np.linalg.eigh(self.f)
        self.roots = (np.sqrt(np.maximum(size, 0.0))[:, None] * turn.T)[:, ::-1], np.linalg.cholesky(self.h).T[:, ::-1]

    def factor(self, log_strength: float) -> np.ndarray:
        """Upper R of positive diagonal with R'R = F + H, rows and columns reversed.

        It comes from the roots and never from the sum, so weak modes of the prior beside any sum of weights stay above zero. The
        inverse of R, reversed back, is the lower root of the posterior covariance.
        """
        r = np.linalg.qr(np.vstack([self.roots[0], 10.0 ** (log_strength / 2) * self.roots[1]]), mode="r")
        return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]

    def trial(self, log_strength: float, positive: bool = False) -> Trial:
        strength = 10.0**log_strength
        r = self.factor(log_strength)
        a = self.f + strength * self.h
        solve = lambda b: np.linalg.solve(r, np.linalg.solve(r.T, b[::-1]))[::-1]
        if positive:
            s = solve_positive(a, self.d)
        else:
            s = solve(self.d)
            s = s + solve(self.d - a @ s)  # takes out what the roots' rounding left
        chi2 = float(s @ self.f @ s - 2 * s @ self.d) + self.terms.data_term
        penalty = strength * float(s @ self.h @ s)
        evidence = -0.5 * (chi2 + penalty + 2 * float(np.log(np.diag(r)).sum()) - len(s) * np.log(strength) - self.log_h + self.terms.noise_norm)
        return Trial(log_strength, chi2, evidence, s)

    def gamma(self, log_strength: float) -> float:
        """Number of well-determined parameters: n - tr((F + H)^-1 H)."""
        strength = 10.0**log_strength
        return len(self.d) - float(np.trace(np.linalg.solve(self.f + strength * self.h, strength * self.h)))

    def posterior(self, log_strength: float) -> np.ndarray:
        """Standard deviation of each mesh point, widened where chi square exceeds its number of data."""
        best = self.trial(log_strength)
        variance = (np.linalg.inv(self.factor(log_strength)) ** 2).sum(axis=1)[::-1]
        return np.sqrt(variance * max(1.0, best.chi2 / (2 * self.terms.n_vis)))

    def draws(self, log_strength: float, count: int, seed: int = 0) -> np.ndarray:
        """Offsets from the solution, one row per draw."""
        unit = np.random.default_rng(seed).standard_normal((count, len(self.d)))
        return np.linalg.solve(self.factor(log_strength), unit[:, ::-1].T).T[:, ::-1]


def search_evidence(system: System, positive: bool = False) -> list[Trial]:
    """Trials at whole decades, then around the best one in tenths; the last is the best."""
    trials = [system.trial(x, positive) for x in np.arange(DECADES[0], DECADES[1] + 1)]
    top = max(trials, key=lambda t: t.log_evidence).log_strength
    trials += [system.trial(x, positive) for x in np.arange(top - 0.9, top + 0.95, 3 * WIDTH)]
    return sorted(trials, key=lambda t: t.log_evidence)


def search_discrepancy(system: System, target: float = 1.0, positive: bool = False, rounds: int = 14) -> list[Trial]:
    """Bisection of the strength at which chi square per datum reaches the target; the last trial is the answer."""
    low, high = DECADES
    goal = target * 2 * system.terms.n_vis
    trials = [system.trial(low, positive)]
    if trials[0].chi2 >= goal:
        return trials  # out of reach: the weakest prior is the closest
    for _ in range(rounds):
        trials.append(system.trial((low + high) / 2, positive))
        low, high = (trials[-1].log_strength, high) if trials[-1].chi2 < goal else (low, trials[-1].log_strength)
        if high - low < WIDTH:
            break
    return trials


def solve_channels(points: DataFrame, n: int, fov_arcsec: float, log_strength: float, scale: float, kind: str = "matern") -> DataFrame:
    """(spw, chan, pix_y, pix_x, value): every channel solved with a frozen prior, each in a task of its own from its own terms.

    The terms of all channels come from one scan; the prior's inverse, of mesh size, is made once and broadcast.
    """
    keys = ("spw", "chan")
    y, x = imaging.grid(n, fov_arcsec)
    at = imaging.lags(n, fov_arcsec)
    planes = [imaging.Plane("kernel", at, at, "sum_w"), imaging.Plane("dirty", y, x, "w_re", "w_im")]
    long = imaging.one_pass(imaging.weighted(points, keys), planes, (), keys)
    shared = points.sparkSession.sparkContext.broadcast(10.0**log_strength * np.linalg.inv(covariance(n, fov_arcsec / n, scale, kind)))

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        k, d = np.zeros((2 * n, 2 * n)), np.zeros((n, n))
        for name, out in (("kernel", k), ("dirty", d)):
            own = frame[frame.plane == name]
            out[own.pix_y, own.pix_x] = own.value
        image = np.linalg.solve(Terms(k, d, 1, 1.0, 0.0, 0.0).curvature + shared.value, d.reshape(-1))
        iy, ix = (a.reshape(-1) for a in np.mgrid[0:n, 0:n])
        return pd.DataFrame({"spw": frame.spw.iloc[0], "chan": frame.chan.iloc[0], "pix_y": iy, "pix_x": ix, "value": image})

    kinds = dict(points.dtypes)
    return long.groupBy(*keys).applyInPandas(solve, f"spw {kinds['spw']}, chan {kinds['chan']}, pix_y int, pix_x int, value double")


def trial_rows(trials: list[Trial], n_vis: int) -> Iterator[tuple[int, float, float, float]]:
    for k, t in enumerate(trials):
        yield k, float(t.log_strength), float(t.chi2 / (2 * n_vis)), float(t.log_evidence)
