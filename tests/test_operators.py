"""Operators against plain loops, identities and known truth."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.functions import sky
from fringeframe.operators import disc, imaging, noise, regions, selection
from fringeframe.operators.ordered import with_previous
from fringeframe.plans import inversion, strategy
from fringeframe.plans.pointfit import detect
from fringeframe.sources import files, mock
from tests.scipy_free import airy


def vis_rows(n=600, seed=1):
    draw = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b = sorted(draw.choice(5, 2, replace=False).tolist())
        t = float(draw.integers(0, 60) * 6 + 600 * draw.integers(0, 3))
        rows.append((k, 0, 0, 0, 0.0, a, b, t, 0, int(draw.integers(0, 2)), *map(float, draw.normal(0, 100, 2)), float(draw.normal()), float(draw.normal()), 0.1, 0.2, bool(draw.random() < 0.2), float(draw.integers(1, 9))))
    return rows


VIS = "ok long, ln int, pk long, sk long, px double, ant1 int, ant2 int, time_s double, spw int, chan int, u_m double, v_m double, re double, im double, sig_re double, sig_im double, flag boolean, weight double"


def loop_pairs(rows, gap):
    chains = {}
    for r in sorted(rows, key=lambda r: (r[5], r[6], r[9], r[7], r[0])):
        chains.setdefault((r[5], r[6], r[9]), []).append(r)
    for key, chain in chains.items():
        for a, b in zip(chain, chain[1:]):
            if b[7] - a[7] <= gap:
                yield key, a[7], b[7], None if a[16] or b[16] else b[12] - a[12], None if a[16] or b[16] else b[13] - a[13]


@pytest.fixture(scope="module")
def vis(spark):
    rows = vis_rows()
    return rows, spark.createDataFrame(rows, VIS).repartition(4)


def loop_gap(rows):
    times = sorted({r[7] for r in rows})
    return 3 * float(np.median(np.diff(times)))


@pytest.mark.parametrize("slab", [10.0, 100.0, 1e9])
def test_pairs_equal_the_loop_for_any_slab(vis, slab):
    rows, df = vis
    gap = loop_gap(rows)
    got = noise.adjacent_pairs(df, slab=slab).collect()
    mine = sorted(((r.ant1, r.ant2, r.chan), r.t0, r.t1, r.d_re is None, round(r.d_re or 0, 12), round(r.d_im or 0, 12)) for r in got)
    want = sorted((k, t0, t1, d is None, round(d or 0, 12), round(e or 0, 12)) for k, t0, t1, d, e in loop_pairs(rows, gap))
    assert mine == want


def test_baseline_noise_equals_the_loop(vis):
    rows, df = vis
    found = {}
    for (a, b, _), _, _, d, _ in loop_pairs(rows, loop_gap(rows)):
        found.setdefault((a, b), []).append(d)
    for r in noise.baseline_sigma(noise.adjacent_pairs(df)).collect():
        d = [x for x in found[(r.ant1, r.ant2)] if x is not None]
        assert r.n == len(d)
        assert (r.sig_re is None) == (len(d) < 4)
        if r.sig_re is not None:
            assert math.isclose(r.sig_re, np.std(d) / math.sqrt(2), rel_tol=1e-12)


def test_previous_over_ties_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(None, 1.0, 1), ("a", 1.0, 1), ("a", 1.0, 2), ("a", 99.0, 3), (None, 5.0, 2)], "k string, t double, i int")
    got = sorted((str(r.k), r.i, r.previous and r.previous.i) for r in with_previous(df, ["k"], ["t", "i"], ["i"], 10.0).collect())
    assert got == [("None", 1, None), ("None", 2, 1), ("a", 1, None), ("a", 2, 1), ("a", 3, 2)]
    assert with_previous(df.limit(0), ["k"], ["t", "i"], ["i"], 10.0).count() == 0


def test_max_gap_of_few_times(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "time_s double")
    assert noise.max_gap(df).first().max_gap == math.inf


def test_terms_add_up_over_any_split(spark, vis):
    _, df = vis
    points = imaging.samples(df, F.lit(230e9))
    whole = imaging.scalar_terms(points).first()
    parts = imaging.scalar_terms(points, ("spw", "chan"))
    merged = imaging.combine(parts).first()
    assert all(math.isclose(whole[c], merged[c], rel_tol=1e-12) for c in ("n_vis", "sum_w", "data_term", "noise_norm"))
    a = imaging.dirty_image(points, 8, 2.0).orderBy("pix_y", "pix_x").toPandas()
    b = imaging.dirty_image(points.repartition(13), 8, 2.0).orderBy("pix_y", "pix_x").toPandas()
    assert np.allclose(a.dirty, b.dirty, atol=1e-12)


def test_image_orientation_by_a_hand_written_point(spark):
    """A point to the north-west peaks in the upper right of an image whose x grows to the west."""
    north, west = 0.5, 0.7
    draw = np.random.default_rng(3)
    uv = draw.normal(0, 8e4, (400, 2))
    turn = 2 * np.pi * sky.ARCSEC * (uv[:, 0] * -west + uv[:, 1] * north)
    rows = [(0, 0, float(u), float(v), float(math.cos(t)), float(-math.sin(t)), 1.0, 1.0) for (u, v), t in zip(uv, turn, strict=True)]
    points = spark.createDataFrame(rows, "spw int, chan int, u double, v double, re double, im double, sig_re double, sig_im double")
    top = regions.peak(imaging.dirty_image(points, 16, 3.2), "dirty").first()
    assert (top.pix_y, top.pix_x) == (5, 11)
    pixel = imaging.pixels(spark, 16, 3.2).where("pix_y = 5 and pix_x = 11").first()
    assert abs(pixel.x_as - west) < 0.11 and abs(pixel.y_as - north) < 0.11


def test_kernel_gives_the_image_of_a_model(spark):
    """The kernel applied to a one-pixel model is the dirty image of that pixel's visibilities."""
    n, fov = 8, 1.6
    grid = imaging.pixels(spark, n, fov).where("pix_y = 2 and pix_x = 5").first()
    points = mock.observation(spark, 200, [mock.Point(grid.x_as, grid.y_as, 1.0)], sigma=1e-9).withColumns({"sig_re": F.lit(1.0), "sig_im": F.lit(1.0)})
    terms = inversion.collect_terms(points, n, fov)
    model = np.zeros(n * n)
    model[2 * n + 5] = 1.0
    assert np.allclose(terms.curvature @ model, terms.dirty.reshape(-1), atol=1e-6)


def test_recentring_by_nothing_changes_nothing(vis):
    _, df = vis
    flat = selection.flattened(df, F.lit(230e9))
    assert selection.recentred(flat, 0.0, 0.0) is flat


def test_positive_solve_meets_the_conditions():
    draw = np.random.default_rng(4)
    for _ in range(20):
        m = draw.normal(size=(30, 20))
        a, b = m.T @ m + 0.01 * np.eye(20), draw.normal(size=20)
        x = inversion.solve_positive(a, b)
        slope = a @ x - b
        assert (x >= 0).all() and (slope > -1e-8).all() and abs(x @ slope) < 1e-8


def test_evidence_of_a_tiny_system_in_closed_form():
    terms = inversion.Terms(np.pad(np.array([[2.0]]), ((1, 0), (1, 0))), np.array([[3.0]]), 1, 1.0, 5.0, 0.7)
    system = inversion.System(terms, 1.0, 1.0)
    h = 1 / (1 + 1e-8)
    for x in (0.0, 1.0):
        lam = 10**x * h
        s = 3 / (2 + lam)
        chi2 = 2 * s * s - 6 * s + 5
        want = -0.5 * (chi2 + lam * s * s + math.log(2 + lam) - math.log(lam) + 0.7)
        assert math.isclose(system.trial(x).log_evidence, want, rel_tol=1e-9)


def test_mock_is_the_same_in_any_partitioning(spark):
    a = mock.observation(spark, 50, [mock.Point(0.1, 0.2, 1.0)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(a) == rows(a.repartition(7))


def test_points_are_found(spark):
    truth = [mock.Point(0.41, 0.33, 0.02), mock.Point(-0.62, -0.47, 0.008)]
    found = detect(mock.observation(spark, 3000, truth, sigma=2e-3), 48, 3.0, apart=0.3)
    assert len(found) == 2
    for t, f in zip(truth, found, strict=True):
        assert math.hypot(t.x_as - f.x_as, t.y_as - f.y_as) < 0.05 and abs(f.flux / t.flux - 1) < 0.15


def test_map_recovers_flux(spark):
    n, fov = 12, 3.0
    points = mock.observation(spark, 2000, [mock.Gaussian(0.0, 0.1, 0.04, 0.3, 0.25, 0.4)], sigma=1e-3)
    system = inversion.System(inversion.collect_terms(points, n, fov), fov / n, 0.4)
    best = inversion.search_evidence(system)[-1]
    assert abs(best.image.sum() / 0.04 - 1) < 0.25
    reached = inversion.search_discrepancy(system)
    assert reached[-1].log_strength >= 0


def test_disc_visibility_and_cells(spark):
    z = spark.range(1, 400).select((F.col("id") / 10.0).alias("z"))
    got = [(r.z, r.j) for r in z.select("z", sky.bessel_j1(F.col("z")).alias("j")).collect()]
    assert max(abs(j - airy(x)) for x, j in got) < 2e-6
    cells = disc.cells(spark, 12, 2.0).agg(F.sum("area").alias("a"), F.count(F.lit(1)).alias("n"), F.max("cell_id").alias("m")).first()
    assert math.isclose(cells.a, math.pi * 4, rel_tol=1e-12) and cells.m == cells.n - 1


def test_greedy_matches(spark):
    found = spark.createDataFrame([(1, 0.0, 0.0, 5.0), (2, 0.1, 0.0, 9.0), (3, 5.0, 5.0, 1.0)], "id int, x_as double, y_as double, flux double")
    truth = spark.createDataFrame([(10, 0.05, 0.0, 1.0), (11, 0.4, 0.0, 1.0)], "id int, x_as double, y_as double, flux double")
    assert sorted((r.found_id, r.truth_id) for r in regions.greedy_matches(found, truth, 0.5).collect()) == [(1, 11), (2, 10)]
    assert regions.greedy_matches(found.limit(0), truth, 0.5).count() == 0


def test_connected_region(spark):
    art = ["##..#", ".#..#", ".####", "....."]
    pixels = spark.createDataFrame([(y, x) for y, row in enumerate(art) for x, c in enumerate(row) if c == "#"] + [(9, 9)], "pix_y int, pix_x int")
    assert regions.connected_region(pixels, 0, 0).count() == 9


def test_mapping_conserves_constants(spark):
    mapping = regions.bilinear_mapping(imaging.pixels(spark, 16, 1.0), 6, 16)
    assert all(math.isclose(r.w, 1.0, rel_tol=1e-12) for r in mapping.groupBy("pix_y", "pix_x").agg(F.sum("weight").alias("w")).collect())


def test_strategy():
    g = strategy.geometry(3.0, 4e5)
    assert g.mesh % 2 == 0 and g.image == 2 * g.mesh and math.isclose(g.mesh_step * g.mesh, 3.0)
    assert strategy.inversion(100, 64) == "dense" and strategy.inversion(10**6, 64) == "sparse" and strategy.inversion(10**6, 10**5) == "free"
    assert strategy.criterion(1000, 64) == "structure" and strategy.criterion(100, 64) == "discrepancy"
    assert strategy.chi2_target(1.0, 2.0, 10**6) > 2.0


def dataset(draw, n_chan, n):
    return {"uvw": draw.normal(0, 100, (n, 3)), "frequencies": 230e9 + 1e8 * np.arange(n_chan), "data": draw.normal(size=(n_chan, n)) + 1j * draw.normal(size=(n_chan, n)), "noise": np.full((n_chan, n), 0.1 + 0.2j), "flags": draw.random((n_chan, n)) < 0.1, "antenna1": np.arange(n) % 5, "antenna2": np.arange(n) % 5 + 1, "time": np.arange(n) * 6.0}


def same(rows, parts):
    assert len(rows) == sum(p["data"].size for p in parts)
    for r in rows:
        p = parts[r.spw]
        assert (r.re, r.im, r.sig_im, r.flag, r.u_m, r.time_s) == (p["data"][r.chan, r.row_id].real, p["data"][r.chan, r.row_id].imag, 0.2, p["flags"][r.chan, r.row_id], p["uvw"][r.row_id, 0], p["time"][r.row_id])


def test_npz_reader(spark, tmp_path):
    draw = np.random.default_rng(5)
    one, two = dataset(draw, 2, 30), dataset(draw, 3, 20)
    np.savez_compressed(tmp_path / "one.npz", **one)
    same(files.read_visibilities(spark, str(tmp_path / "one.npz")).collect(), [one])
    np.savez(tmp_path / "many.npz", n_spw=2, **{f"spw{k:03d}_{n}": a for k, p in enumerate((one, two)) for n, a in p.items()})
    same(files.read_visibilities(spark, str(tmp_path / "many.npz")).collect(), [one, two])


def test_fits_reader_and_bytes(spark, tmp_path):
    p = dataset(np.random.default_rng(6), 2, 10)
    for name, a in p.items():
        a = np.stack([a.real, a.imag], -1) if np.iscomplexobj(a) else a.astype(np.uint8) if a.dtype == bool else a
        (tmp_path / f"{name}.fits").write_bytes(files.fits_bytes(a))
    same(files.read_visibilities(spark, str(tmp_path)).collect(), [p])
    header, back = files.fits_image(files.fits_bytes(np.arange(6.0).reshape(2, 3), {"BUNIT": "Jy", "CRVAL1": 1.5}))
    assert header["BUNIT"] == "Jy" and header["CRVAL1"] == 1.5 and back.shape == (2, 3)


def test_dataset_round_trip(spark, vis, tmp_path):
    _, df = vis
    files.write_visibilities(df, f"file://{tmp_path}/set", {"telescope": "none"})
    assert files.read_visibilities(spark, f"file://{tmp_path}/set").count() == df.count()
    raw = files.plane_bytes(imaging.pixels(spark, 4, 1.0), "x_as", 4, 0.25)
    assert files.fits_image(raw)[1].shape == (4, 4)


def test_seconds_do_not_depend_on_the_session_zone(spark):
    from fringeframe.sources.adapter import seconds

    df = spark.sql("select timestamp_ntz '2024-01-15 12:00:00.25' as t")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York", "Asia/Tokyo"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(seconds("t").alias("s")).first().s == 1705320000.25
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize(("keys", "few"), [((), 10_000), ((), 1000), (("k",), 10_000), (("k",), 1000)])
def test_quantiles_are_exact(spark, monkeypatch, keys, few):
    from fringeframe.operators import quantiles as module

    quantiles = module.quantiles
    monkeypatch.setattr(module, "FEW", few)
    draw, n = np.random.default_rng(4), 60_000
    rows = [(int(k), float(v)) for k, v in zip(draw.integers(0, 3, n), np.where(draw.random(n) < 0.4, 7.0, draw.normal(0, 5, n)))]
    rows += [(0, None), (1, float("nan")), (9, 2.5)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(7)
    qs = [0.0, 0.016, 0.25, 0.5, 0.951, 1.0]
    for r in quantiles(df, F.col("v"), qs, keys).collect():
        own = np.array([v for k, v in rows if v is not None and not math.isnan(v) and (not keys or k == r.k)])
        assert r.n == len(own)
        assert np.allclose([r[f"q{k}"] for k in range(len(qs))], np.quantile(own, qs))
    empty = quantiles(df.where("false"), F.col("v"), [0.5], keys).collect()
    assert empty == [] if keys else (empty[0].n, empty[0].q0) == (0, None)


def noisy(spark, change=lambda r: r, times=10):
    """Ten baselines in time, real noise 0.1 and imaginary 0.2."""
    draw, rows = np.random.default_rng(5), []
    for a in range(5):
        for b in range(a + 1, 5):
            for t in range(times):
                r = dict(ok=len(rows), ln=0, pk=0, sk=0, px=0.0, ant1=a, ant2=b, time_s=t * 6.0, spw=0, chan=0, u_m=1.0, v_m=1.0, re=float(draw.normal(1, 0.1)), im=float(draw.normal(0, 0.2)), sig_re=0.1, sig_im=0.1, flag=False, weight=1.0)
                rows.append(tuple(change(r).values()))
    return spark.createDataFrame(rows, VIS)


def levels(df):
    return {(r.ant1, r.ant2): (r.est_re, r.est_im) for r in df.collect()}


def test_estimated_sigma_survives_what_is_not_finite(spark):
    nan = float("nan")
    clean = levels(noise.estimated_sigma(noisy(spark)))
    one = levels(noise.estimated_sigma(noisy(spark, lambda r: {**r, "re": nan} if r["ok"] == 7 else r)))
    assert all(0.03 < re < 0.3 and 0.06 < im < 0.6 for re, im in clean.values())
    assert [k for k in clean if one[k] != clean[k]] == [(0, 1)] and 0.03 < one[0, 1][0] < 0.3
    dead = levels(noise.estimated_sigma(noisy(spark, lambda r: {**r, "re": nan, "im": nan} if r["ant1"] == 0 else r)))
    assert len({dead[0, b] for b in range(1, 5)}) == 1 and dead[0, 1][0] == pytest.approx(0.1, rel=0.3)
    with pytest.raises(ValueError, match="nothing to measure noise by"):
        noise.estimated_sigma(noisy(spark, lambda r: {**r, "re": nan, "im": nan})).collect()


def test_estimated_sigma_of_single_integrations_is_the_scatter(spark):
    found = levels(noise.estimated_sigma(noisy(spark, times=1)))
    rows = noisy(spark, times=1).collect()
    mad = lambda v: 1.4826 * float(np.median(np.abs(v - np.median(v))))
    (level,) = set(found.values())
    assert level == pytest.approx((mad(np.array([r.re for r in rows])), mad(np.array([r.im for r in rows]))))


def test_estimated_sigma_without_near_pairs_drops_the_gap(spark):
    """Baselines take turns, so neighbours of one are far apart in steps of all times."""
    apart = levels(noise.estimated_sigma(noisy(spark, lambda r: {**r, "time_s": r["time_s"] * 1000 + r["ok"]})))
    assert all(0.03 < re < 0.25 for re, _ in apart.values())


def test_a_usable_part_stands_in_for_the_other(spark):
    found = levels(noise.estimated_sigma(noisy(spark, lambda r: {**r, "im": 3.0})))
    assert all(re == im for re, im in found.values())
    assert noise.constant_level(noisy(spark, lambda r: {**r, "im": 3.0}))[1] > 0
    assert noise.one_or_both(None, 2.0) == (2.0, 2.0)


def test_terms_of_channels_add_up_to_those_of_all(spark):
    draw = np.random.default_rng(6)
    rows = [(k % 2, k % 5, *map(float, draw.normal(0, 3e5, 2)), float(draw.normal()), float(draw.normal()), 0.5, 0.7) for k in range(400)]
    points = spark.createDataFrame(rows, "spw int, chan int, u double, v double, re double, im double, sig_re double, sig_im double").repartition(6)
    whole = {(r.plane, r.pix_y, r.pix_x): r.value for r in imaging.terms(points, 4, 0.5).collect()}
    added = {(r.plane, r.pix_y, r.pix_x): r.value for r in imaging.added_terms(imaging.terms(points, 4, 0.5, ("spw", "chan"))).collect()}
    assert set(whole) == set(added) and all(added[k] == pytest.approx(whole[k], rel=1e-9, abs=1e-9) for k in whole)
    assert whole["n_vis", 0, 0] == 400


def test_greedy_matches_equal_a_loop_over_detections(spark):
    draw = np.random.default_rng(8)
    found = [(k, *map(float, draw.uniform(0, 6, 2)), float(draw.uniform(1, 9))) for k in range(60)]
    truth = [(k, *map(float, draw.uniform(0, 6, 2)), 1.0) for k in range(40)]
    free, want = {t[0]: t for t in truth}, set()
    for k, x, y, _ in sorted(found, key=lambda f: -f[3]):
        near = min(free.values(), key=lambda t: (math.hypot(t[1] - x, t[2] - y), t[0]), default=None)
        if near and math.hypot(near[1] - x, near[2] - y) < 0.7:
            want.add((k, near[0]))
            del free[near[0]]
    schema = "id long, x_as double, y_as double, flux double"
    report = regions.match_report(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), 0.7).collect()
    assert {(r.found_id, r.truth_id) for r in report if r.kind == "matched"} == want
    assert {r.truth_id for r in report if r.kind == "missed"} == set(free)
    assert {r.found_id for r in report if r.kind == "false"} == {f[0] for f in found} - {a for a, _ in want}


def test_matches_of_crowded_places_hold_no_pairs(spark, monkeypatch):
    """Many detections and truths on few places, with ties in distance and flux: as a loop, and without a row for each near pair."""
    draw, rows = np.random.default_rng(10), []
    found = [(k, float(draw.integers(0, 6)), float(draw.integers(0, 2) * 7), float(draw.integers(1, 9))) for k in range(1500)]
    truth = [(k, float(draw.integers(0, 6)), float(draw.integers(0, 2) * 7 + 1), 1.0) for k in range(300)]
    free, want = dict(enumerate(truth)), set()
    for k, x, y, _ in sorted(found, key=lambda f: (-f[3], f[0])):
        near = min(free.values(), key=lambda t: ((t[1] - x) ** 2 + (t[2] - y) ** 2, t[0]), default=None)
        if near and (near[1] - x) ** 2 + (near[2] - y) ** 2 < 6.25:
            want.add((k, near[0]))
            del free[near[0]]
    pairs = sum((x - a) ** 2 + (y - b) ** 2 < 6.25 for _, x, y, _ in found for _, a, b, _ in truth)
    plain = regions.held
    monkeypatch.setattr(regions, "held", lambda df: (lambda out: rows.append(out.count()) or out)(plain(df)))
    schema = "id long, x_as double, y_as double, flux double"
    got = regions.greedy_matches(spark.createDataFrame(found, schema), spark.createDataFrame(truth, schema), 2.5)
    assert {(r.found_id, r.truth_id) for r in got.collect()} == want
    assert max(rows) <= 2 * (len(found) + len(truth)) < pairs / 10


@pytest.mark.parametrize("tile", [2, 3, 256])
def test_regions_are_the_same_for_any_tile(spark, tile):
    picture = ["##..#", ".#.##", ".###.", ".....", "#####"]
    pixels = spark.createDataFrame([(y, x) for y, line in enumerate(picture) for x, c in enumerate(line) if c == "#"], "pix_y int, pix_x int")
    assert regions.connected_region(pixels, 0, 0, tile).count() == 9 and regions.connected_region(pixels, 4, 4, tile).count() == 5
    assert regions.connected_region(pixels, 3, 0, tile).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_excluding_by_broadcast_or_tiles(spark, monkeypatch, few):
    monkeypatch.setattr(regions, "FEW", few)
    grid = imaging.pixels(spark, 12, 3.0)
    centres = spark.createDataFrame([(0.3, 0.2), (-1.0, 1.1)], "y_as double, x_as double")
    left = {(r.pix_y, r.pix_x) for r in regions.excluding(grid, centres, 0.6).collect()}
    want = {(r.pix_y, r.pix_x) for r in grid.collect() if all(math.hypot(r.y_as - y, r.x_as - x) > 0.6 for y, x in ((0.3, 0.2), (-1.0, 1.1)))}
    assert left == want


@pytest.mark.parametrize("k", [2, 3])
def test_sliding_and_upsampling_equal_loops(spark, k):
    n = 5
    a = np.random.default_rng(9).normal(1, 1, (n, n))
    image = spark.createDataFrame([(y, x, float(a[y, x])) for y in range(n) for x in range(n)], "pix_y int, pix_x int, v double")
    inside = lambda i: min(max(i, 0), n - 1)
    frame = range(-(k // 2), (k - 1) // 2 + 1)
    high = [[max(a[inside(y + i), inside(x + j)] for i in frame for j in frame) for x in range(n)] for y in range(n)]
    for r in regions.sliding(image, "v", k, n).collect():
        assert r.smooth == pytest.approx(np.mean([high[inside(r.pix_y + i)][inside(r.pix_x + j)] for i in frame for j in frame]))
    fine = np.zeros((n * k, n * k))
    for y in range(n * k):
        for x in range(n * k):
            cy, cx = (min(max((p + 0.5) / k - 0.5, 0), n - 1) for p in (y, x))
            iy, ix = int(cy), int(cx)
            fy, fx = cy - iy, cx - ix
            fine[y, x] = sum(a[inside(iy + dy), inside(ix + dx)] * abs(1 - dy - fy) * abs(1 - dx - fx) for dy in (0, 1) for dx in (0, 1))
    fine *= a.sum() / fine.sum()
    for r in regions.upsampled(image, "v", k, n).collect():
        assert r.v == pytest.approx(fine[r.pix_y, r.pix_x])
