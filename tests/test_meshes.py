"""Discs of cells, meshes along the curve, nested searches, identities and caches."""

import logging
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.operators import disc, imaging, mesh, search
from fringeframe.plans import inversion, products


@pytest.mark.parametrize("turn, close", [(0.5, 4e-3), (0.1, 2e-4)])
def test_cells_summed_are_the_disc(spark, turn, close):
    """Cells of equal brightness give the J1 form, to the accuracy that the phase step asks for."""
    radius, draw = 0.8, np.random.default_rng(1)
    uv = draw.normal(0, 200e3, (400, 2))
    points = spark.createDataFrame([(float(a), float(b), "x") for a, b in uv] + [(0.0, 0.0, "x")], "u double, v double, model_re string")
    made = disc.cells(spark, 5, radius)
    values = made.select("cell_id", F.lit(1 / (math.pi * radius**2)).alias("value"))
    seen = disc.cell_visibilities(points, disc.nodes(made, float(np.hypot(*uv.T).max()), turn), values)
    rows = seen.withColumn("want", disc.uniform_disc(F.col("u"), F.col("v"), radius)).collect()
    assert len(rows) == 401 and max(abs(complex(r.model_re, r.model_im) - r.want) for r in rows) < close


def test_nodes_share_their_cells_area(spark):
    made = disc.cells(spark, 4, 1.0)
    total = disc.nodes(made, 3e5, 0.3).groupBy("cell_id").agg(F.sum("share").alias("s"), F.count(F.lit(1)).alias("n")).join(made, "cell_id").collect()
    assert all(r.s == pytest.approx(r.area) for r in total) and max(r.n for r in total) > 4
    few = disc.nodes(made, 1.0, 0.3)
    assert few.count() == made.count()


def test_many_nodes_meet_in_parts(spark, monkeypatch):
    made = disc.cells(spark, 3, 0.5)
    points = spark.range(20).select((F.col("id") * 9e3).alias("u"), (F.col("id") * -4e3).alias("v"))
    values = made.select("cell_id", F.col("cell_id").cast("double").alias("value"))
    places = disc.nodes(made, 2e5, 0.2)
    want = {r.u: (r.model_re, r.model_im) for r in disc.cell_visibilities(points, places, values).collect()}
    monkeypatch.setattr(disc, "NODES", places.count() // 3)
    monkeypatch.setattr(disc, "SOME", 5)
    got = {r.u: (r.model_re, r.model_im) for r in disc.cell_visibilities(points, places, values).collect()}
    assert all(np.allclose(got[k], want[k], atol=1e-9) for k in want)
    dark = disc.cell_visibilities(points, places, values.limit(0)).agg(F.max(F.abs("model_re"))).first()[0]
    assert dark == 0.0


def test_rendered_disc_keeps_its_flux(spark):
    n, step = 40, 0.06
    made, pixels = disc.rings(spark, 4, 1.0), imaging.pixels(spark, n, n * step)
    cells = disc.cells(spark, 4, 1.0)
    values = cells.select("cell_id", (F.col("cell_id") % 3 + 1.0).alias("value"))
    total = disc.rendered(pixels, made, values, step, 8).agg(F.sum("value")).first()[0] * step**2
    want = cells.join(values, "cell_id").agg(F.sum(F.col("area") * F.col("value"))).first()[0]
    assert total == pytest.approx(want, rel=5e-3)
    # A single cell is lit where it lies.
    one = cells.where("ring = 2").first()
    lit = disc.rendered(pixels, made, spark.createDataFrame([(one.cell_id, 1.0)], "cell_id long, value double"), step).join(pixels, ["pix_y", "pix_x"]).agg(F.sum(F.col("value") * F.col("x_as")) / F.sum("value"), F.sum(F.col("value") * F.col("y_as")) / F.sum("value")).first()
    assert (lit[0], lit[1]) == (pytest.approx(one.x_as, abs=0.02), pytest.approx(one.y_as, abs=0.02))


def test_points_don_t_depend_on_the_stretches(spark):
    image = imaging.pixels(spark, 16, 1.0).withColumn("v", F.exp(-(F.pow("x_as", 2) + F.pow("y_as", 2)) * 8))
    some = [{(r.pix_y, r.pix_x): r.points for r in mesh.hilbert_points(image, "v", 4, 90, stretch=s).collect()} for s in (1, 7, 64, 1 << 16)]
    assert all(x == some[0] for x in some) and sum(some[0].values()) in (89, 90, 91)
    mask = image.where("pix_x < 5")
    kept = mesh.hilbert_points(image, "v", 4, 90, mask=mask.unionByName(mask), stretch=16).collect()
    assert sum(r.points for r in kept) in (89, 90, 91) and all(r.pix_x < 5 for r in kept)
    flat = mesh.hilbert_points(image.withColumn("v", F.lit(-1.0)), "v", 4, 256).collect()
    assert len(flat) == 256 and all(r.points == 1 for r in flat)
    assert mesh.hilbert_points(image.limit(0), "v", 4, 90).count() == 0


def test_nested_search_narrows(spark):
    stats = spark.createDataFrame([("a", 0.3137, 2.0), ("b", -0.77, 0.5), ("edge", 5.0, 1.0), ("none", None, 1.0)], "k string, at double, width double")
    score = -F.pow((F.col("x") - F.col("at")) / F.col("width"), 2) - F.pow(F.col("y") - 0.1, 2)
    got = {r.k: r for r in search.nested_argmax(stats, ["k"], {"x": (-1.0, 1.0), "y": (0.0, 4.0)}, score, steps=8, rounds=6).collect()}
    assert set(got) == {"a", "b", "edge"}
    assert got["a"].x == pytest.approx(0.3137, abs=2e-3) and got["b"].x == pytest.approx(-0.77, abs=2e-3) and got["edge"].x == 1.0
    assert got["a"].y == pytest.approx(0.1, abs=4e-3)
    tie = search.nested_argmax(stats.where("k = 'a'"), ["k"], {"x": (0.0, 1.0)}, F.lit(1.0), rounds=3).first()
    assert tie.x == 0.0


def test_content_has_no_order(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.5), (2, None, 1.5), (3, "", 0.0)], "k long, s string, v double")
    one = products.source_identity(df)
    assert one == products.source_identity(df.orderBy(F.col("k").desc()).repartition(3)) == products.source_identity(df.select("v", "k", "s"))
    for other in (df.distinct(), df.na.fill("", ["s"]), df.withColumn("v", F.col("v") + 1e-9), df.withColumnRenamed("v", "a"), df.limit(0)):
        assert products.source_identity(other) != one
    assert products.source_identity(spark.createDataFrame([("ab", "c")], "a string, b string")) != products.source_identity(spark.createDataFrame([("a", "bc")], "a string, b string"))


def test_files_are_named_by_size_and_time(spark, tmp_path):
    import os

    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_bytes(b"1")
    os.utime(tmp_path / "d" / "x", (1e9, 1e9))
    one = products.source_identity(str(tmp_path / "d"))
    assert one == products.source_identity(f"file://{tmp_path}/d") and products.source_identity(str(tmp_path / "d" / "x")).startswith("files:1:")
    os.utime(tmp_path / "d" / "x", (1e9, 2e9))
    assert products.source_identity(str(tmp_path / "d")) != one
    with pytest.raises(FileNotFoundError):
        products.source_identity(str(tmp_path / "none"))


def made_terms():
    draw = np.random.default_rng(5)
    return inversion.Terms(draw.normal(size=(8, 8)), draw.normal(size=(4, 4)), 10, 2.0, 3.0, 4.0)


@pytest.mark.parametrize("damage", ["cut", "empty", "foreign", "gone"])
def test_damaged_caches_are_built_again(spark, tmp_path, caplog, damage):
    folder, built = f"file://{tmp_path}", []
    build = lambda: (built.append(1), made_terms())[1]
    first = products.cached_terms(spark, folder, "k", build)
    assert products.cached_terms(spark, folder, "k", build).n_vis == first.n_vis and len(built) == 1
    parts = list((tmp_path / "k").glob("part-*"))
    for f in parts:
        if damage == "cut":
            f.write_bytes(f.read_bytes()[:100])
            f.with_name(f".{f.name}.crc").unlink(missing_ok=True)
        elif damage != "foreign":
            f.unlink()
    if damage == "foreign":
        products.save_terms(spark, made_terms(), folder, "other")
        (tmp_path / "k").rename(tmp_path / "old")
        (tmp_path / "other").rename(tmp_path / "k")
    if damage == "gone":
        (tmp_path / "k" / "_SUCCESS").unlink()
    with caplog.at_level(logging.WARNING):
        again = products.cached_terms(spark, folder, "k", build)
    assert len(built) == 2 and np.array_equal(again.kernel, first.kernel)
    assert products.load_terms(spark, folder, "k") is not None
    products.cached_terms(spark, folder, "k", build, renew=True)
    assert len(built) == 3


def test_a_cache_that_can_t_be_written_costs_a_warning(spark, tmp_path, caplog):
    (tmp_path / "f").write_bytes(b"")
    assert products.cached_terms(spark, f"file://{tmp_path}/f", "k", made_terms).n_vis == 10
    assert "not cached" in caplog.text


def test_few_keys_move_no_samples(spark, monkeypatch):
    """Images by key with and without dealing agree, and samples are dealt only where there are many keys."""
    points = spark.range(4000).selectExpr("cast(id % 5 as int) as spw", "cast(id % 2 as int) as chan", "(id % 41 - 20) * 3e3D as u", "(id % 37 - 18) * 3e3D as v", "sin(id) as re", "cos(id) as im", "0.1D as sig_re", "0.2D as sig_im").repartition(3)
    few = imaging.terms(points, 6, 1.0, ("spw", "chan"))
    monkeypatch.setattr(imaging, "MOST_KEYS", 4)
    many = imaging.terms(points, 6, 1.0, ("spw", "chan"))
    dealt = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("deal_")
    assert dealt(few) == 0 and dealt(many) > 0
    a, b = ({tuple(r)[:-1]: r.value for r in df.collect()} for df in (few, many))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], rel=1e-9, abs=1e-9) for k in a)


@pytest.mark.parametrize("keys", [(), ("k",)])
def test_narrowed_brackets_give_the_same_quantiles(spark, monkeypatch, keys):
    """However small what a task may order, quantiles are the exact ones; heavy ties, infinities of ranks and one value included."""
    from fringeframe.operators import quantiles as q

    draw = np.random.default_rng(9)
    values = np.concatenate([draw.lognormal(0, 3, 30_000), np.repeat(1.5, 9_000), -draw.random(1000)])
    df = spark.createDataFrame([(int(i % 3), float(v)) for i, v in enumerate(values)] + [(7, 4.0), (8, None)], "k int, v double")
    qs = [0.0, 0.013, 0.5, 0.61, 0.9999, 1.0]
    want = {tuple(r)[: len(keys)]: tuple(r)[len(keys) :] for r in q.quantiles(df, F.col("v"), qs, keys).collect()}
    monkeypatch.setattr(q, "BOUND", 20)
    monkeypatch.setattr(q, "PARTS", 64)
    monkeypatch.setattr(q, "FEW", 5)
    calls, plain = [], q.narrowed
    monkeypatch.setattr(q, "narrowed", lambda *a: (calls.append(1), plain(*a))[1])
    got = {tuple(r)[: len(keys)]: tuple(r)[len(keys) :] for r in q.quantiles(df, F.col("v"), qs, keys).collect()}
    assert got == want and len(calls) == 1
    for k in want:
        own = np.array([v for i, v in enumerate(values) if not keys or i % 3 == k[0]]) if k != (7,) else np.array([4.0])
        if not keys:
            own = np.append(own, 4.0)
        assert np.allclose(want[k][1:], np.quantile(own, qs), rtol=1e-12)
