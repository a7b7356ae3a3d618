"""Cubes as tables, their axes, and the moment program against NumPy."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe import cli
from fringeframe.plans import moments, products
from fringeframe.sources import cubes, files, members

REST = 230.538e9


def cube_cards(hz, **more):
    return {**products.product_cards(12, 0.5, (83.6, -5.4), unit="Jy/beam", hz=hz, rest_hz=REST), **more}


@pytest.fixture
def lines(tmp_path):
    """A cube of 8 planes of 12 x 10 pixels with a line in a patch, and its noise."""
    draw = np.random.default_rng(1)
    hz = REST - 1e6 * np.arange(8)
    cube = draw.normal(0, 0.1, (8, 12, 10))
    cube[2:6, 3:7, 4:8] += np.array([1.0, 3.0, 2.0, 1.0])[:, None, None]
    cube[0, 0, 0] = np.nan
    (tmp_path / "model.fits").write_bytes(files.fits_bytes(cube.astype(np.float32)[None], cube_cards(hz)))
    return tmp_path, cube.astype(np.float32).astype(float), hz


def test_cubes_are_read_by_planes(spark, lines, monkeypatch):
    folder, cube, _ = lines
    df = cubes.read_cube(spark, f"file://{folder}/model.fits")
    got = np.full(cube.shape, np.inf)
    for r in df.collect():
        got[r.plane, 11 - r.pix_y, r.pix_x] = np.nan if r.value is None else r.value
    assert np.array_equal(got, cube, equal_nan=True)
    assert df.where("plane in (2, 5)").count() == 240 and df.where("plane >= 6 and plane < 7").count() == 120 and df.where("plane = 9").count() == 0
    monkeypatch.setattr(cubes, "PARTITION_PIXELS", 50)
    reader = cubes.CubeReader(f"file://{folder}/model.fits")
    assert [type(f).__name__ for f in reader.pushFilters([files.EqualTo(("plane",), 3), files.GreaterThan(("value",), 1.0)])] == ["GreaterThan"]
    parts = reader.partitions()
    assert [p.value for p in parts] == [(3, 0, 5), (3, 5, 10), (3, 10, 12)]
    total, plain = [0], members.Ranged.read_at
    monkeypatch.setattr(members.Ranged, "read_at", lambda self, size, at: (total.__setitem__(0, total[0] + size), plain(self, size, at))[1])
    assert sum(b.num_rows for b in reader.read(parts[0])) == 50 and total[0] == 50 * 4 + 2 * 2880


def test_axes(spark, lines, tmp_path):
    folder, _, hz = lines
    axis = cubes.spectral_axis(spark, f"file://{folder}/model.fits", systemic=2.0).orderBy("plane").collect()
    assert np.allclose([r.freq_hz for r in axis], hz) and axis[4].velocity == pytest.approx(299792.458 * 4e6 / REST - 2.0)
    uneven = REST + np.array([0.0, 1e6, 5e6])
    header = products.product_cards(4, 1.0, hz=uneven)
    assert cubes.frequencies(header, 3) == uneven.tolist()
    assert cubes.frequencies({"CTYPE3": "FREQ-LSR", "CUNIT3": "GHz", "CRVAL3": 230.0, "CRPIX3": 2.0, "CDELT3": 0.5}, 2) == [229.5e9, 230e9]
    for bad in ({"CTYPE3": "VRAD"}, {"CTYPE3": "FREQ", "CUNIT3": "m"}):
        with pytest.raises(ValueError):
            cubes.frequencies(bad, 2)
    (tmp_path / "x.fits").write_bytes(files.fits_bytes(np.zeros((2, 3, 4)), {"CTYPE3": "FREQ", "CRVAL3": 1e9, "CDELT3": 1e6}))
    with pytest.raises(ValueError, match="rest"):
        cubes.spectral_axis(spark, f"file://{tmp_path}/x.fits")
    (tmp_path / "y.fits").write_bytes(files.fits_bytes(np.zeros((2, 2, 3, 4))))
    with pytest.raises(ValueError, match="no cube"):
        cubes.cube_member(f"file://{tmp_path}/y.fits")


def plain_maps(cube, keep, velocity, width):
    v = np.where(keep & np.isfinite(cube), cube, 0.0)
    s = v.sum(0)
    with np.errstate(all="ignore"):
        m1 = (v * velocity[:, None, None]).sum(0) / s
        m2 = np.sqrt(np.maximum((v * velocity[:, None, None] ** 2).sum(0) / s - m1**2, 0))
    return (v * width[:, None, None]).sum(0), np.where(s > 0, m1, np.nan), np.where(s > 0, m2, np.nan)


@pytest.mark.parametrize("mode", ["self", "empty", "snr", "residual"])
def test_moment_program(spark, lines, mode):
    folder, cube, hz = lines
    velocity = 299792.458 * (1 - hz / REST)
    width = np.abs(np.gradient(velocity))
    draw = np.random.default_rng(2)
    residual = draw.normal(0, 1, cube.shape).astype(np.float32).astype(float)
    if mode != "self":
        (folder / "model_reconvolved.fits").write_bytes(files.fits_bytes((cube * 2).astype(np.float32), cube_cards(hz, RMS=0.2)))
    if mode in ("snr", "residual"):
        (folder / "residual.fits").write_bytes(files.fits_bytes(residual.astype(np.float32), cube_cards(hz)))
    if mode == "snr":
        (folder / "snr.fits").write_bytes(files.fits_bytes((cube * 10).astype(np.float32), cube_cards(hz)))
    out = f"file://{folder}/out/line"
    cli.main(["moments", "--dataset", f"file://{folder}/model.fits", "--out", out, "--n-sigma", "4", "--empty-planes", "0,-1", "--min-channels", "2"])
    zero = np.nan_to_num(cube)
    flat = cube[[0, 7]][np.isfinite(cube[[0, 7]])]
    deviation = np.array([1.4826 * np.median(np.abs(r - np.median(r))) for r in residual.reshape(8, -1)])
    keep = {"self": zero >= 4 * np.sqrt(np.mean(flat**2)), "empty": zero >= 4 * np.sqrt(np.mean(flat**2)), "snr": zero * 10 >= 4, "residual": zero * 2 >= 4 * 0.2 * deviation[:, None, None]}[mode]
    keep &= keep.sum(0) >= 2
    assert json.loads((folder / "out" / "line_moments.json").read_text())["mode"] == mode
    for name, want in zip(("mom0", "mom1", "mom2"), plain_maps(cube, keep, velocity, width), strict=True):
        header, got = files.fits_image((folder / "out" / f"line_{name}.fits").read_bytes())
        assert got.shape == (12, 10) and header["CRVAL1"] == pytest.approx(83.6)
        assert np.allclose(np.nan_to_num(got), np.nan_to_num(want), rtol=1e-4, atol=2e-3), name


def test_masks_that_can_t_be_made_say_so(spark, lines):
    folder, cube, hz = lines
    path = f"file://{folder}/model.fits"
    with pytest.raises(FileNotFoundError):
        moments.run(spark, path, f"file://{folder}/o", mode="snr")
    (folder / "snr.fits").write_bytes(files.fits_bytes(np.full((2, 12, 10), np.nan), cube_cards(hz[:2])))
    with pytest.raises(ValueError, match="as large"):
        moments.run(spark, path, f"file://{folder}/o", mode="snr")
    (folder / "snr.fits").write_bytes(files.fits_bytes(np.full(cube.shape, np.nan), cube_cards(hz)))
    with pytest.raises(ValueError, match="no number"):
        moments.run(spark, path, f"file://{folder}/o")
    with pytest.raises(ValueError, match="zeros"):
        moments.by_empty(cubes.read_cube(spark, path).withColumn("value", F.lit(0.0)), [0], 5.0)
    assert moments.channels("0-2, 5,-1", 8) == [0, 1, 2, 5, 7]


def test_products_lie_where_the_data_were_moved_to():
    cards = products.product_cards(16, 0.5, (10.0, 60.0), (36.0, 18.0), "Jy", products.Beam(1.0, 0.5, 20.0))
    assert cards["CRVAL2"] == pytest.approx(60.005) and cards["CRVAL1"] == pytest.approx(10.0 - 0.02) and cards["BMAJ"] == pytest.approx(2.3548 / 3600, rel=1e-4)
    assert products.median_beam([products.Beam(3, 1, 0), products.Beam(1, 1, 0), products.Beam(2, 1, 0)]).major == 2
