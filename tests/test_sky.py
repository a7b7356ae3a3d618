"""Joint fits, projections, errors of fluxes against dense NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import masks, noise, regions, wcs
from fringeframe.plans import gaussians, pointfit
from fringeframe.plans.products import Beam
from fringeframe.sources import files

G, P = gaussians.Source(1.0, 0.4, -0.3, 0.35, 0.2, 0.6), gaussians.Source(0.3, -0.8, 0.5)


def samples(spark, sources, n=1500, noise=0.02, seed=1):
    draw = np.random.default_rng(seed)
    u, v = draw.normal(0, 150e3, (2, n))
    model, _ = gaussians.model_columns(sources, u, v)
    sr, si = draw.uniform(0.5, 2, (2, n)) * noise
    rows = np.column_stack([u, v, model.real + draw.normal(0, sr), model.imag + draw.normal(0, si), sr, si])
    return spark.createDataFrame(rows.tolist(), "u double, v double, re double, im double, sig_re double, sig_im double").repartition(3), rows


def test_derivatives_are_the_differences():
    u, v = np.random.default_rng(2).normal(0, 150e3, (2, 50))
    at, (_, columns) = gaussians.packed([G, P]), gaussians.model_columns([G, P], u, v)
    for k in range(len(at)):
        step = np.zeros(len(at))
        step[k] = 1e-6
        ahead, behind = (gaussians.model_columns(gaussians.unpacked([G, P], at + s), u, v)[0] for s in (step, -step))
        assert np.allclose(columns[:, k], (ahead - behind) / 2e-6, atol=1e-7)


def dense_fit(rows, sources):
    """The same least squares on one array."""
    u, v, re, im, sr, si = rows.T
    at = gaussians.packed(sources)
    for _ in range(60):
        model, cols = gaussians.model_columns(gaussians.unpacked(sources, at), u, v)
        a = np.vstack([cols.real / sr[:, None], cols.imag / si[:, None]])
        r = np.concatenate([(re - model.real) / sr, (im - model.imag) / si])
        at = at + np.linalg.lstsq(a, r, rcond=None)[0]
    return at, float(r @ r), np.sqrt(np.diag(np.linalg.inv(a.T @ a)))


@pytest.mark.parametrize("held", [(), ("angle",), ("major", "x_as", "y_as")])
def test_joint_fit_is_the_dense_one(spark, held):
    df, rows = samples(spark, [G, P])
    start = [gaussians.Source(0.8, 0.4 if held[1:] else 0.45, -0.3 if held[1:] else -0.2, 0.35 if held[1:] else 0.3, 0.25, 0.6 if held else 0.4, held), gaussians.Source(0.2, -0.75, 0.45)]
    found = gaussians.fit(df, start)
    want, chi2, errors = dense_fit(rows, start)
    assert np.allclose(gaussians.packed(found.sources), want, rtol=1e-5, atol=1e-6) and found.chi2 == pytest.approx(chi2, rel=1e-8)
    own = [s.errors[n] / (getattr(s, n) if n in ("major", "minor") else 1) for s in found.sources for n in s.free()]
    assert np.allclose(own, errors, rtol=1e-3)
    assert all(getattr(found.sources[0], n) == getattr(start[0], n) for n in held)
    assert abs(found.sources[0].flux - 1) < 6 * found.sources[0].errors["flux"] and abs(found.chi2 / 3000 - 1) < 0.1


def test_rounds_read_places_not_samples(spark, monkeypatch):
    """Samples that share places, some unusable: the fit of all on one array, from a row for each place."""
    df, rows = samples(spark, [G, P], 60)
    draw, every = np.random.default_rng(5), np.repeat(rows, 30, axis=0)
    every[:, 4:] *= draw.uniform(0.5, 2, (len(every), 2))
    every[:, 2:4] += draw.normal(0, every[:, 4:])
    at = rows[0][:2].tolist()
    odd = [(*at, 9.0, 9.0, 0.0, 1.0), (*at, float("nan"), 9.0, 1.0, 1.0), (*at, 9.0, 9.0, 1.0, float("inf")), (None, 0.0, 9.0, 9.0, 1.0, 1.0), (*at, 9.0, 9.0, 1.0, float("nan"))]
    seen, plain = [], gaussians.step_sums
    monkeypatch.setattr(gaussians, "step_sums", lambda points, sources: seen.append(points.count()) or plain(points, sources))
    start = [gaussians.Source(0.8, 0.45, -0.2, 0.3, 0.25, 0.6), gaussians.Source(0.2, -0.75, 0.45)]
    found = gaussians.fit(spark.createDataFrame(every.tolist() + odd, df.schema).repartition(5), start)
    want, chi2, errors = dense_fit(every, start)
    assert np.allclose(gaussians.packed(found.sources), want, rtol=1e-5, atol=1e-6) and found.chi2 == pytest.approx(chi2, rel=1e-8)
    own = [s.errors[n] / (getattr(s, n) if n in ("major", "minor") else 1) for s in found.sources for n in s.free()]
    assert np.allclose(own, errors, rtol=1e-3)
    assert len(seen) == found.rounds and set(seen) == {60}


def test_a_fit_goes_back_after_a_bad_step(spark):
    df, rows = samples(spark, [G])
    found = gaussians.fit(df, [gaussians.Source(0.1, 0.1, 0.1, 1.2, 1.0, 0.0)])
    assert found.chi2 / 3000 < 1.1 and found.rounds > 5


def test_samples_without_noise_or_values_are_left_out(spark):
    df, rows = samples(spark, [P], 200)
    odd = df.unionByName(spark.createDataFrame([(1.0, 1.0, float("nan"), 0.0, 1.0, 1.0), (1.0, 1.0, None, 0.0, 1.0, 1.0), (1.0, 1.0, 9.0, 0.0, 0.0, 1.0)], df.schema))
    a, b = ({(r.i, r.j): r.f for r in gaussians.step_sums(x, [P]).collect()} for x in (df, odd))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9) for k in a)
    assert gaussians.step_sums(df.limit(0), [P]).count() == 0


def test_restored_gaussians_are_convolved(spark):
    """Against the transform of the same source seen through the beam, by its visibilities."""
    n, step, beam = 64, 0.05, Beam(0.2, 0.14, 25.0)
    df = spark.createDataFrame([(2.0, 0.1, -0.2, 0.3, 0.15, 0.7), (1.0, -0.8, 0.45, 0.0, 0.0, 0.0), (5.0, 30.0, 0.0, 0.1, 0.1, 0.0)], "flux double, x_as double, y_as double, major double, minor double, angle double")
    got = np.zeros((n, n))
    for r in gaussians.restored(df, beam, n, step).collect():
        got[r.pix_y, r.pix_x] = r.value
    x, y = (np.arange(n) - (n - 1) / 2) * step, -((np.arange(n) - (n - 1) / 2) * step)
    want = np.zeros((n, n))
    grid = np.linspace(-1.5, 1.5, 61)
    for flux, cx, cy, major, minor, angle in [(2.0, 0.1, -0.2, 0.3, 0.15, 0.7), (1.0, -0.8, 0.45, 0.0, 0.0, 0.0)]:
        parts = [(0.0, 0.0, 1.0)]
        if major:
            gx, gy = np.meshgrid(grid, grid)
            al, ac = gx * math.sin(angle) + gy * math.cos(angle), -gx * math.cos(angle) + gy * math.sin(angle)
            w = np.exp(-0.5 * ((al / major) ** 2 + (ac / minor) ** 2))
            parts = np.column_stack([gx.ravel(), gy.ravel(), w.ravel() / w.sum()])
        t = math.radians(beam.angle)
        for ox, oy, w in parts:
            row, col = -(y[:, None] - cy - oy), x[None, :] - cx - ox
            al, ac = row * math.cos(t) + col * math.sin(t), col * math.cos(t) - row * math.sin(t)
            want += flux * w * np.exp(-0.5 * ((al / beam.major) ** 2 + (ac / beam.minor) ** 2))
    assert np.abs(got - want).max() < 2e-3 * want.max()


@pytest.mark.parametrize("kind", ["SIN", "TAN"])
def test_projections_go_both_ways(spark, kind):
    g = wcs.Grid(359.99, 62.0, 30.0, 20.0, -0.01, 0.011, 64, 48, 33.0, kind)
    df = spark.range(64 * 48).select((F.col("id") % 64).alias("x"), F.floor(F.col("id") / 64).alias("y"))
    ra, dec = g.sky(F.col("x"), F.col("y"))
    bx, by = g.pixels(ra, dec)
    rows = df.select("x", "y", ra.alias("ra"), dec.alias("dec"), bx.alias("bx"), by.alias("by")).collect()
    assert max(max(abs(r.bx - r.x), abs(r.by - r.y)) for r in rows) < 1e-6 and all(0 <= r.ra < 360 for r in rows)
    at = next(r for r in rows if (r.x, r.y) == (30, 20))
    assert at.ra == pytest.approx(359.99) and at.dec == pytest.approx(62.0)
    # A pixel's distance on the sky from the reference: r = sin or tan of the angle.
    r = next(r for r in rows if (r.x, r.y) == (0, 0))
    far = math.degrees(math.acos(math.sin(math.radians(r.dec)) * math.sin(math.radians(62)) + math.cos(math.radians(r.dec)) * math.cos(math.radians(62)) * math.cos(math.radians(r.ra - 359.99))))
    plane = math.hypot(30 * 0.01, 20 * 0.011)
    assert math.degrees((math.sin if kind == "SIN" else math.tan)(math.radians(far))) == pytest.approx(plane, rel=1e-6)


def test_behind_the_sky_is_nothing(spark):
    g = wcs.Grid(10.0, 0.0, 0.0, 0.0, 1.0, 1.0, 10, 10)
    assert spark.range(1).select(g.pixels(F.lit(190.0), F.lit(0.0))[0].alias("x")).first().x is None
    assert spark.range(1).select(g.sky(F.lit(90), F.lit(90))[1].alias("d")).first().d is None
    with pytest.raises(ValueError):
        wcs.Grid(0, 0, 0, 0, 1, 1, 1, 1, 0, "CAR")


def test_masks_from_images_of_other_grids(spark):
    coarse, fine = wcs.Grid(50.0, 20.0, 4.5, 4.5, -0.02, 0.02, 10, 10), wcs.Grid(50.0, 20.0, 9.5, 9.5, -0.01, 0.01, 20, 20)
    a = np.zeros((10, 10), np.float32)
    a[2:5, 6:8] = 1
    a[0, 0] = np.nan
    raw = files.fits_bytes(a[None], coarse.cards())
    got = {(r.pix_y, r.pix_x) for r in masks.from_fits(spark, raw, fine).collect()}
    assert got == {(y, x) for y in range(4, 10) for x in range(12, 16)}
    with pytest.raises(ValueError, match="empty"):
        masks.from_fits(spark, files.fits_bytes(a * 0, coarse.cards()), fine)
    with pytest.raises(ValueError, match="axes"):
        masks.from_fits(spark, files.fits_bytes(np.zeros((2, 10, 10), np.float32), coarse.cards()), fine)
    moved = coarse.shifted(36.0, -72.0)
    assert moved.dec == pytest.approx(19.98) and moved.ra == pytest.approx(50 - 0.01 / math.cos(math.radians(20)))


def test_flux_errors_are_the_dense_ones(spark):
    n, mesh = 12, 4
    from fringeframe.operators.imaging import pixels

    draw = np.random.default_rng(4)
    a = draw.normal(size=(40, mesh * mesh))
    c = a.T @ a
    cov = spark.createDataFrame([(i, j, float(c[i, j])) for i in range(mesh * mesh) for j in range(i, mesh * mesh)], "i long, j long, c double")
    grid = pixels(spark, n, 1.0)
    mapping = regions.bilinear_mapping(grid, mesh, n)
    m = np.zeros((n * n, mesh * mesh))
    for r in mapping.collect():
        m[r.pix_y * n + r.pix_x, r.mesh_id] += r.weight
    got = {(r.pix_y, r.pix_x): r.variance for r in regions.mapped_variance(mapping, cov).collect()}
    want = np.einsum("pi,ij,pj->p", m, c, m)
    assert all(got[k // n, k % n] == pytest.approx(want[k]) for k in range(n * n))
    region = grid.where("pix_y between 3 and 6 and pix_x < 5")
    w = np.array([float(3 <= k // n <= 6 and k % n < 5) for k in range(n * n)])
    row = regions.region_flux_error(grid.withColumn("v", F.lit(2.0)), "v", region.unionByName(region), mapping, cov).first()
    assert (row.n, row.flux) == (20, 40.0) and row.error == pytest.approx(math.sqrt(w @ m @ c @ m.T @ w))


def test_weak_points_go_one_by_one(spark):
    """Against the same loop on dense arrays: the weakest goes, all others are solved again."""
    df, rows = samples(spark, [gaussians.Source(1.0, 0.4, -0.3), gaussians.Source(0.5, -0.8, 0.5)], 800, 0.2)
    places = [(0.4, -0.3), (-0.8, 0.5), (0.42, -0.28), (1.5, 1.5), (-0.2, 0.9)]
    found = pointfit.pruned(df, [pointfit.Component(x, y) for x, y in places], 5.0)
    u, v, re, im, sr, si = rows.T
    left, w = list(places), np.sqrt(2 / (sr**2 + si**2))
    while left:
        cols = gaussians.model_columns([gaussians.Source(1.0, x, y, held=("x_as", "y_as")) for x, y in left], u, v)[1]
        a = np.vstack([cols.real * w[:, None], cols.imag * w[:, None]])
        d = np.concatenate([re * w, im * w])
        cov = np.linalg.inv(a.T @ a)
        flux = cov @ a.T @ d
        chi2 = d @ d - flux @ a.T @ d
        snr = flux / np.sqrt(np.diag(cov) * max(1.0, chi2 / (2 * len(u))))
        if snr.min() >= 5:
            break
        left.pop(int(np.argmin(snr)))
    assert [(c.x_as, c.y_as) for c in found] == left and len(left) < 5
    assert np.allclose([c.flux for c in found], flux, rtol=1e-6)
    assert pointfit.pruned(df, [pointfit.Component(1.5, 1.5)], 50.0) == []


def test_bad_noise_is_the_median_of_the_good(spark):
    rows = [(1.0, 2.0, False), (3.0, None, False), (0.0, 4.0, False), (-1.0, float("inf"), True), (float("nan"), 6.0, None), (100.0, 100.0, True), (5.0, 2.0, False)]
    got = noise.repaired(spark.createDataFrame(rows, "sig_re double, sig_im double, flag boolean")).collect()
    assert [(r.sig_re, r.sig_im) for r in got] == [(1.0, 2.0), (3.0, 3.0), (3.0, 4.0), (3.0, 3.0), (3.0, 6.0), (100.0, 100.0), (5.0, 2.0)]
    with pytest.raises(Exception, match="usable sig_re"):
        noise.repaired(spark.createDataFrame([(0.0, 1.0, False)], "sig_re double, sig_im double, flag boolean")).collect()
