"""Every registered query with SQL gives DuckDB's rows; the others those of plain loops over all samples."""

import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from __spark_entry__ import entry
from fringeframe import queries
from fringeframe.functions import sky
from fringeframe.plans import inversion
from fringeframe.queries import QUERIES, SQL
from tests.conftest import DATA

SF = DATA / "sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in SF.glob("*.parquet"):
        c.execute(f"create view {path.stem} as select * from '{path}'")
    return c


def plain(frame: pd.DataFrame) -> list[tuple]:
    cast = lambda x: None if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x
    rows = [tuple(cast(getattr(x, "item", lambda x=x: x)()) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tables, name):
    got, want = QUERIES[name](spark, str(SF)).toPandas(), tables.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    got, want = plain(got), plain(want)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isclose(x, y, rel_tol=1e-9, abs_tol=2e-7)) for x, y in zip(a, b, strict=True)), (a, b)


def samples(spark):
    return queries.points(spark, str(SF)).toPandas()


def plane(frame, column, n=queries.SIDE):
    out = np.zeros((n, n))
    out[frame.pix_y, frame.pix_x] = frame[column]
    return out


def loop_terms(p, n, fov):
    """Curvature between all pixels and the data's sums at them, sample by sample."""
    w = 1 / (0.5 * (p.sig_re**2 + p.sig_im**2)).to_numpy()
    at = -(np.arange(n) - (n - 1) / 2) * fov / n
    y, x = (a.reshape(-1) for a in np.meshgrid(at, at, indexing="ij"))
    turn = 2 * np.pi * sky.ARCSEC * (np.outer(p.u, x) + np.outer(p.v, y))
    wave = np.exp(1j * turn)
    f = ((wave.conj() * w[:, None]).T @ wave).real
    d = ((wave * (w * (p.re + 1j * p.im).to_numpy())[:, None]).sum(0)).real
    return f, d


def test_solves_equal_dense_ones(spark):
    """Map, scan and draws against one dense system of all samples."""
    p, n = samples(spark), queries.SIDE
    f, d = loop_terms(p, n, queries.FOV)
    h = np.linalg.inv(inversion.covariance(n, queries.FOV / n, 0.05))
    c = float((p.re**2 / p.sig_re**2 + p.im**2 / p.sig_im**2).sum())
    norm = float((np.log(2 * np.pi * p.sig_re**2) + np.log(2 * np.pi * p.sig_im**2)).sum())
    scan = QUERIES["q_evidence_scan"](spark, str(SF)).toPandas()
    for r in scan.itertuples():
        a = f + 10**r.log_strength * h
        s = np.linalg.solve(a, d)
        chi2 = s @ f @ s - 2 * s @ d + c
        evidence = -0.5 * (chi2 + 10**r.log_strength * s @ h @ s + np.linalg.slogdet(a)[1] - np.linalg.slogdet(10**r.log_strength * h)[1] + norm)
        assert r.chi2_per_datum == pytest.approx(chi2 / (2 * len(p)), rel=1e-6) and r.log_evidence == pytest.approx(evidence, rel=1e-6)
    best = scan[scan.criterion == "evidence"].sort_values("log_evidence").log_strength.iloc[-1]
    image = QUERIES["q_solve_map"](spark, str(SF)).toPandas()
    a = f + 10**best * h
    s = np.linalg.solve(a, d)
    assert np.allclose(plane(image, "value").reshape(-1), s, rtol=1e-5, atol=1e-7 * np.abs(s).max())
    wide = np.sqrt(np.diag(np.linalg.inv(a)) * max(1.0, (s @ f @ s - 2 * s @ d + c) / (2 * len(p))))
    assert np.allclose(plane(image, "sigma").reshape(-1), wide, rtol=1e-4)
    draws = QUERIES["q_posterior_draws"](spark, str(SF)).first()
    spread = float(np.sqrt(np.ones(n * n) @ np.linalg.inv(a) @ np.ones(n * n)))
    assert draws.draws == 64 and abs(draws.flux_50 - s.sum()) < 0.6 * spread and draws.flux_84 - draws.flux_16 == pytest.approx(2 * spread, rel=0.5)


@pytest.mark.parametrize("weight", [1e4, 1e11, 1e13])
def test_draws_and_evidence_stand_any_sum_of_weights(weight):
    """Weights of large tables beside a weak prior: the draws' covariance solves the normal equations and the evidence is finite."""
    from fringeframe.operators import imaging

    n, draw = queries.SIDE, np.random.default_rng(11)
    u, v = draw.normal(0, 80e3, (2, 300))
    at, (y, x) = np.array(imaging.lags(n, queries.FOV)), map(np.array, imaging.grid(n, queries.FOV))
    wave = lambda a, b: np.exp(2j * np.pi * sky.ARCSEC * np.outer(a, b))
    kernel, dirty = (weight * (wave(v, b).T @ wave(u, a)).real for b, a in ((at, at), (y, x)))
    system = inversion.System(inversion.Terms(kernel, dirty, 300, 300 * weight, 300 * weight, 0.0), queries.FOV / n, 0.05)
    draws = system.draws(-0.9, 64)
    assert np.isfinite(draws).all() and np.isfinite(system.posterior(-0.9)).all() and np.isfinite(system.trial(-0.9).log_evidence)
    root = np.linalg.inv(system.factor(-0.9))[::-1, ::-1]
    assert np.allclose(draws, np.random.default_rng(0).standard_normal((64, n * n)) @ root.T, rtol=1e-6, atol=1e-9 * np.abs(root).max())
    assert np.allclose(np.triu(root, 1), 0) and (np.diag(root) > 0).all()
    if weight == 1e4:  # where the covariance's own root exists, it is the same
        c = np.linalg.inv(system.f + 10.0**-0.9 * system.h)
        assert np.allclose(root, np.linalg.cholesky((c + c.T) / 2), rtol=1e-4, atol=1e-4 * np.abs(root).max())


def test_cube_fit_equals_a_solve_per_channel(spark):
    p, n = samples(spark), 12
    h = 10.0**4 * np.linalg.inv(inversion.covariance(n, queries.FOV / n, 0.05))
    found = QUERIES["q_cube_fit"](spark, str(SF)).toPandas()
    keys = sorted(set(zip(p.spw, p.chan)))
    assert sorted(set(zip(found.spw, found.chan))) == keys
    for spw, chan in keys:
        f, d = loop_terms(p[(p.spw == spw) & (p.chan == chan)], n, queries.FOV)
        s = np.linalg.solve(f + h, d)
        assert np.allclose(plane(found[(found.spw == spw) & (found.chan == chan)], "value", n).reshape(-1), s, rtol=1e-5, atol=1e-7 * np.abs(s).max())


def test_point_fit_equals_a_plain_fit(spark):
    """Fluxes and errors of the points found, from dense normal equations at their places."""
    p = samples(spark)
    found = QUERIES["q_point_fit"](spark, str(SF)).toPandas()
    assert len(found)
    w = 1 / (0.5 * (p.sig_re**2 + p.sig_im**2)).to_numpy()
    wave = np.stack([np.exp(-2j * np.pi * sky.ARCSEC * (-p.u * r.x_as + p.v * r.y_as).to_numpy()) for r in found.itertuples()], 1)
    data = (p.re + 1j * p.im).to_numpy()
    f, b = ((wave.conj() * w[:, None]).T @ wave).real, ((wave.conj() * w[:, None]).T @ data).real
    flux = np.linalg.solve(f, b)
    chi2 = float((w * np.abs(data - wave @ flux) ** 2).sum())
    error = np.sqrt(np.diag(np.linalg.inv(f)) * max(1.0, chi2 / (2 * len(p))))
    assert np.allclose(found.flux, flux, rtol=1e-5) and np.allclose(found.error, error, rtol=1e-5)


def test_source_region_equals_a_flood(spark):
    beam = plane(queries.image(spark, str(SF)).toPandas(), "beam")
    top = np.unravel_index(int(beam.argmax()), beam.shape)
    bright, todo, seen = beam >= beam.max() / 3, [top], set()
    while todo:
        y, x = todo.pop()
        if (y, x) not in seen and 0 <= y < len(beam) and 0 <= x < len(beam) and bright[y, x]:
            seen.add((y, x))
            todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    got = {(r.pix_y, r.pix_x) for r in QUERIES["q_source_region"](spark, str(SF)).collect()}
    assert got == {(int(y), int(x)) for y, x in seen}


def test_gaussian_fit_is_no_worse_than_the_dense_one(spark):
    """The registered fit's chi square on all samples, against damped steps on one array from the same start."""
    from dataclasses import replace

    from fringeframe import queries_sky
    from fringeframe.plans import gaussians

    rows = queries.points(spark, str(SF)).where("sig_re > 0 and sig_im > 0").select("u", "v", "re", "im", "sig_re", "sig_im").toPandas().to_numpy(float)
    u, v, re, im, sr, si = rows.T
    start = queries_sky.HELD

    def chi2(at):
        model, cols = gaussians.model_columns(gaussians.unpacked(start, at), u, v)
        r = np.concatenate([(re - model.real) / sr, (im - model.imag) / si])
        return float(r @ r), r, np.vstack([cols.real / sr[:, None], cols.imag / si[:, None]])

    at, damping = gaussians.packed(start), 1e-3
    best, r, a = chi2(at)
    for _ in range(60):
        f = a.T @ a
        step = np.linalg.solve(f + damping * np.diag(np.diag(f)), a.T @ r)
        now = chi2(at + np.clip(step, -1, 1))
        if now[0] <= best:
            at, (best, r, a), damping = at + np.clip(step, -1, 1), now, damping / 10
        else:
            damping *= 10
    got = {(x.source, x.parameter): x.value for x in QUERIES["q_gaussian_fit"](spark, str(SF)).collect()}
    found = [replace(s, **{n: got[k, n] for n in s.free()}) for k, s in enumerate(start)]
    assert chi2(gaussians.packed(found))[0] <= best * (1 + 1e-7)


def test_every_query_without_sql_has_a_test_above():
    assert set(QUERIES) - set(SQL) == {"q_solve_map", "q_evidence_scan", "q_posterior_draws", "q_cube_fit", "q_point_fit", "q_source_region", "q_gaussian_fit"}


def test_entry(spark):
    assert entry(spark).count() == 256


def test_registered_names():
    assert set(SQL) <= set(QUERIES)
