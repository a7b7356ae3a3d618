"""Ingest, masks, meshes, products, streams and the command line."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe import cli, config
from fringeframe.functions.hilbert import hilbert_index
from fringeframe.operators import imaging, masks, mesh
from fringeframe.plans import inversion, products
from fringeframe.sources import measurement
from fringeframe.streaming import terms as streams
from tests.conftest import DATA


@pytest.fixture(scope="module")
def ms(spark):
    draw = np.random.default_rng(1)
    rows, samples, row = [], [], 0
    for t in range(30):
        for a in range(4):
            for b in range(a, 4):
                rows.append((row, 0 if t < 28 else 1, 0, bool(row % 17 == 0), a, b, 30.0 * t, *map(float, draw.normal(0, 50, 3))))
                for chan in range(2):
                    for corr in range(2):
                        re = float(draw.normal(0, 0.5)) if row % 31 else float("nan")
                        samples.append((row, chan, corr, re, float(draw.normal(0, 0.5)), bool(draw.random() < 0.1), 4.0 + corr, None))
                row += 1
    return measurement.MeasurementSet(
        spark.createDataFrame(rows, "row_id long, field_id int, data_desc_id int, flag_row boolean, ant1 int, ant2 int, time_s double, u_m double, v_m double, w_m double"),
        spark.createDataFrame(samples, "row_id long, chan int, corr int, re double, im double, flag boolean, weight double, weight_spectrum double"),
        spark.createDataFrame([(0, 0, 0)], "data_desc_id int, spw_id int, pol_id int"),
        spark.createDataFrame([(0, [230e9, 231e9])], "spw_id int, chan_freq array<double>"),
        spark.createDataFrame([(0, [9, 12])], "pol_id int, corr_type array<int>"),
        spark.createDataFrame([(k, 12.0) for k in range(4)], "ant_id int, dish_diameter double"),
    )


@pytest.mark.parametrize("mode", ["difference", "hybrid", "scaled"])
def test_ingest(ms, mode):
    got = measurement.ingest(ms, 0, mode=mode).where("not flag").toPandas()
    assert len(got) and (got.ant1 != got.ant2).all() and got.sig_re.gt(0).all()
    # Two hands of deviation 0.5 and weights 4 and 5 leave about 0.35.
    assert abs(got.sig_re.median() / 0.355 - 1) < 0.25
    assert set(got.freq_hz) == {230e9, 231e9}


def test_windows(spark, ms):
    assert [r.spw for r in measurement.windows_of(spark, "0-1, 4").collect()] == [0, 1, 4]
    assert [r.spw for r in measurement.windows_in(ms.rows).collect()] == [0]
    assert measurement.median_dish(ms).first().dish_m == 12.0
    with pytest.raises(ValueError):
        measurement.ingest(ms, 0, mode="none")


def test_doubled_hands_count_once(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, 0.1), (1, 1.0, 2.0, 0.1), (2, 1.0, 2.0, 0.1), (2, 3.0, 2.0, 0.1)], "k int, re double, im double, sigma double")
    got = {r.k: r.sigma for r in measurement.from_hands(df, ("k",)).collect()}
    assert math.isclose(got[1], 0.1) and math.isclose(got[2], 0.1 / math.sqrt(2))


def test_hilbert_curve_steps_to_neighbours(spark):
    grid = imaging.pixels(spark, 16, 1.0).select("pix_y", "pix_x", hilbert_index(F.col("pix_y"), F.col("pix_x"), 4).alias("at"))
    path = [(r.pix_y, r.pix_x) for r in grid.orderBy("at").collect()]
    assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


def test_mesh_points_follow_the_light(spark):
    image = imaging.pixels(spark, 16, 1.6).withColumn("v", F.exp(-(F.pow("x_as", 2) + F.pow("y_as", 2)) / 0.02))
    got = mesh.hilbert_points(image, "v", 4, 120).toPandas()
    assert got.points.sum() == 120
    assert got[(got.pix_y.between(5, 10)) & (got.pix_x.between(5, 10))].points.sum() > 80


def test_masks(spark):
    pixels = imaging.pixels(spark, 32, 3.2)
    text = "#CRTF\ncircle[[0arcsec, 0arcsec], 1arcsec]\n-centerbox[[0arcsec, 0arcsec], [0.5arcsec, 0.5arcsec]]\n"
    got = masks.rasterised(spark, pixels, text).join(pixels, ["pix_y", "pix_x"]).toPandas()
    want = pixels.toPandas()
    inside = (np.hypot(want.x_as, want.y_as) <= 1) & ~((want.x_as.abs() <= 0.25) & (want.y_as.abs() <= 0.25))
    assert len(got) == inside.sum()
    with pytest.raises(ValueError):
        masks.rasterised(spark, pixels, "circle[[9arcsec, 9arcsec], 1arcsec]")
    with pytest.raises(ValueError):
        masks.shapes("hexagon[[0,0],1]")


def test_beam_restore_and_kernel():
    n, step = 32, 0.1
    y, x = (np.mgrid[0:n, 0:n] - n // 2) * step
    beam = products.fit_beam(np.exp(-0.5 * ((y / 0.4) ** 2 + (x / 0.25) ** 2)), step)
    assert math.isclose(beam.major, 0.4, rel_tol=1e-6) and math.isclose(beam.minor, 0.25, rel_tol=1e-6)
    model = np.zeros((n, n))
    model[10, 12] = 2.0
    seen = products.restore(model, np.zeros((n, n)), beam, step)
    assert np.unravel_index(seen.argmax(), seen.shape) == (10, 12) and math.isclose(seen.max(), 2.0, rel_tol=1e-9)
    kernel = np.zeros((2 * n, 2 * n))
    kernel[n + 1, n] = 1.0
    assert products.Response(kernel).to(model)[11, 12] == pytest.approx(2.0)


def test_terms_cache(spark, tmp_path):
    terms = inversion.Terms(np.arange(16.0).reshape(4, 4), np.eye(2), 3, 1.5, 2.5, 3.5)
    key = products.terms_key("a", fov=1.0)
    assert key != products.terms_key("a", fov=2.0)
    assert products.load_terms(spark, f"file://{tmp_path}", key) is None
    products.save_terms(spark, terms, f"file://{tmp_path}", key)
    back = products.load_terms(spark, f"file://{tmp_path}", key)
    assert np.array_equal(back.kernel, terms.kernel) and back.noise_norm == 3.5


def test_prior_shapes():
    c = inversion.covariance(4, 0.1, 0.3)
    w = inversion.adaptive_weight(np.arange(16.0))
    assert np.allclose(np.diag(inversion.weighted(c, w)), w**2, rtol=1e-6)
    g = inversion.gibbs_covariance(4, 0.1, np.full(16, 0.2))
    assert np.linalg.eigvalsh(g).min() > 0 and inversion.envelope_weight(np.array([0.0]), 1.0)[0] == 1.0


@pytest.fixture(scope="module")
def event_files(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("events")
    rows = spark.read.parquet(str(DATA / "sf0.001" / "events.parquet")).toPandas().sort_values("ts")
    for k, part in enumerate(np.array_split(np.arange(len(rows)), 4)):
        rows.iloc[part].to_parquet(folder / f"part-{k}.parquet", index=False, coerce_timestamps="us")
        import os

        os.utime(folder / f"part-{k}.parquet", (1e9 + 10 * k, 1e9 + 10 * k))
    return f"file://{folder}", rows


@pytest.mark.parametrize("files", [1, 2, 4])
def test_streams_equal_batches_for_any_split(spark, event_files, tmp_path, files):
    folder, rows = event_files
    stream = streams.event_stream(spark, folder, files)
    got = {r.baseline: (r.n, round(r.s, 6)) for r in streams.drain(streams.running_terms(stream), f"terms_{files}", f"{tmp_path}/a").collect()}
    assert got == {k: (len(g), round(g.value.sum(), 6)) for k, g in rows.groupby("event_type")}
    pairs = streams.drain(streams.stream_pairs(stream, 7200.0), f"pairs_{files}", f"{tmp_path}/b", "append").count()
    pairs += streams.open_pairs(spark, f"{tmp_path}/b", 7200.0).count()
    seconds = rows.ts.astype("datetime64[us]").astype("int64") / 1e6
    want = sum(int((np.diff(seconds[g.index]) <= 7200.0).sum()) for _, g in rows.groupby("event_type"))
    assert pairs == want


@pytest.mark.parametrize("seed, files", [(1, 1), (2, 1), (3, 2), (4, 5)])
def test_late_rows_take_their_place(spark, tmp_path, seed, files):
    """Rows come up to a day late, in files of any order within that; nothing is lost, and what the watermark has passed is out early."""
    import os

    rows = spark.read.parquet(str(DATA / "sf0.001" / "events.parquet")).toPandas().sort_values("ts").reset_index(drop=True)
    t = rows.ts.astype("datetime64[us]").astype("int64") / 1e6
    draw = np.random.default_rng(seed)
    arrival = np.argsort(t.to_numpy() + draw.uniform(0, 86400.0, len(rows)))
    (tmp_path / "in").mkdir()
    for k, part in enumerate(np.array_split(arrival, 7)):
        rows.iloc[draw.permutation(part)].to_parquet(tmp_path / "in" / f"{k}.parquet", index=False, coerce_timestamps="us")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1e9 + 10 * k, 1e9 + 10 * k))
    stream = streams.stream_pairs(streams.event_stream(spark, f"file://{tmp_path}/in", files), 3600.0, "1 day")
    closed = streams.drain(stream, f"late_{seed}", f"{tmp_path}/state", "append").collect()
    left = streams.open_pairs(spark, f"{tmp_path}/state", 3600.0).collect()
    want = []
    for name, g in rows.assign(t=t).sort_values(["t", "event_id"]).groupby("event_type"):
        a, b, d = g.t.to_numpy()[:-1], g.t.to_numpy()[1:], np.diff(g.value.to_numpy())
        want += [(name, x, y, z) for x, y, z in zip(a, b, d) if y - x <= 3600.0]
    assert sorted(map(tuple, [*closed, *left])) == sorted(want)
    assert len(closed) > 0.8 * len(want)


def test_a_hot_key_is_many_states(spark):
    """Slabs of a baseline are groups of their own, and few rows are there twice."""
    rows = spark.range(20_000).selectExpr("'b' as baseline", "id * 10.0D as time_s")
    counts = [r.n for r in streams.slabbed(rows, 100.0).groupBy("baseline", "slab").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(counts) == 126 and max(counts) <= 172 and sum(counts) < 1.08 * 20_000


def test_windows_and_sessions_stream(spark, event_files, tmp_path):
    stream = streams.event_stream(spark, event_files[0])
    day = streams.drain(streams.tumbling(stream, 86400), "days", f"{tmp_path}/c", "append")
    assert 0 < day.agg(F.sum("n")).first()[0] <= len(event_files[1])
    runs = streams.drain(streams.sessions(stream, "1 hour"), "runs", f"{tmp_path}/d", "append")
    assert runs.count() > 0


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"_note": "x", "fov": "2.5", "image-centre": [0.1, 0.2], "reg": "gaussian"}))
    args = cli.arguments(["fit", "--config", str(path), "--dataset", "d", "--out", "o", "--reg", "matern"])
    assert (args.fov, args.image_centre, args.reg) == (2.5, (0.1, 0.2), "matern")
    assert json.loads(config.record(args))["fov"] == 2.5
    flags = config.as_arguments({"positive": True, "scale": None, "image_centre": (-0.1, 0.2)})
    assert flags == ["--positive", "--image-centre=-0.1,0.2"]
    for bad in ({"unknown": 1}, {"reg": "none"}, {"fov": 1, "--fov": 2}, {"fov": "wide"}, {"fo": 1}):
        path.write_text(json.dumps({"fov": 1, **bad} if "--fov" not in bad else bad))
        with pytest.raises(ValueError):
            cli.arguments(["fit", "--config", str(path), "--dataset", "d", "--out", "o"])


@pytest.mark.parametrize("mode", ["difference", "scaled", "hybrid"])
def test_convert_finds_the_noise(spark, tmp_path, mode):
    """Claimed noise is off by 7; times of four baselines, real noise 0.1."""
    from fringeframe.sources import files

    draw, rows = np.random.default_rng(3), []
    for k in range(400):
        rows.append((0, k, k % 3, float(k // 4 * 6), k % 4, 4, 100.0, 50.0, 0.0, 230e9, float(draw.normal(1, 0.1)), float(draw.normal(0, 0.1)), 0.7, 0.7, False))
    schema = "spw int, row_id long, chan int, time_s double, ant1 int, ant2 int, u_m double, v_m double, w_m double, freq_hz double, re double, im double, sig_re double, sig_im double, flag boolean"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    cli.main(["convert", "--dataset", f"file://{tmp_path}/in", "--noise", mode, "--out", f"file://{tmp_path}/out"])
    found = files.read_visibilities(spark, f"file://{tmp_path}/out").agg(F.avg("sig_re").alias("re"), F.avg("sig_im").alias("im"), F.count("re").alias("n")).first()
    assert found.n == 400 and found.re == pytest.approx(0.1, rel=0.25) and found.im == pytest.approx(0.1, rel=0.25)


def test_command_line(spark, tmp_path):
    data, out = f"file://{tmp_path}/demo", f"file://{tmp_path}/out"
    cli.main(["demo", "--out", data, "--samples", "1500"])
    common = ["--dataset", data, "--fov", "3"]
    cli.main(["fit", *common, "--out", out])
    model = spark.read.parquet(f"{out}/planes").where("kind = 'model'").agg(F.sum("value")).first()[0]
    assert abs(model / 0.054 - 1) < 0.25
    assert json.loads((tmp_path / "out" / "parameters.json").read_text())["chi2_per_datum"] > 0
    cli.main(["points", *common, "--max-points", "2", "--out", f"file://{tmp_path}/points"])
    assert spark.read.parquet(f"file://{tmp_path}/points/components").count() >= 1
    cli.main(["cube", *common, "--log-strength", "4", "--out", f"file://{tmp_path}/cube"])
    assert spark.read.parquet(f"file://{tmp_path}/cube/cube").count() > 0
