"""Range reads, header scans and the dataset writer."""

import json
import os
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeframe.sources import dataset, files, members
from tests.test_operators import dataset as arrays
from tests.test_operators import same


@pytest.fixture
def taken(monkeypatch):
    """Bytes that files give, as a list of one number."""
    total, plain = [0], members.Ranged.read_at

    def counted(self, size, at):
        raw = plain(self, size, at)
        total[0] += len(raw)
        return raw

    monkeypatch.setattr(members.Ranged, "read_at", counted)
    return total


def split(p):
    """The layout of exports: real and imaginary parts apart."""
    return {**{k: v for k, v in p.items() if k not in ("data", "noise")}, **{f"{n}_{part}": getattr(p[n], kind) for n in ("data", "noise") for part, kind in (("re", "real"), ("im", "imag"))}}


def fits_folder(path, p):
    path.mkdir(exist_ok=True)
    for name, a in p.items():
        a = np.stack([a.real, a.imag], -1) if np.iscomplexobj(a) else a.astype(np.uint8) if a.dtype == bool else a
        (path / f"{name}.fits").write_bytes(files.fits_bytes(a))


def rows_of(reader, part):
    return sum(b.num_rows for b in reader.read(part))


@pytest.mark.parametrize("layout", ["stored", "fits"])
def test_a_slice_costs_its_own_bytes(tmp_path, taken, layout):
    p = arrays(np.random.default_rng(1), 16, 50_000)
    if layout == "stored":
        np.savez(tmp_path / "x.npz", **split(p))
        reader = files.NpzReader(str(tmp_path / "x.npz"))
    else:
        fits_folder(tmp_path / "x", p)
        reader = files.FitsReader(str(tmp_path / "x"))
    whole = sum(os.path.getsize(f) for f in tmp_path.rglob("*") if f.is_file())
    parts = reader.partitions()
    assert len(parts) == 16 and taken[0] < 40_000
    taken[0] = 0
    assert rows_of(reader, parts[3]) == 50_000
    # 4 doubles and a flag for each sample of the channel; places, antennas and times of its rows.
    assert 50_000 * (33 + 24) <= taken[0] <= 50_000 * (33 + 24 + 24) + 60_000 < whole / 5


def test_filters_leave_windows_channels_and_rows_unread(spark, tmp_path, taken):
    p = arrays(np.random.default_rng(2), 8, 20_000)
    np.savez(tmp_path / "x.npz", n_spw=2, **{f"spw{k:03d}_{n}": a for k in range(2) for n, a in split(p).items()})
    df = files.read_visibilities(spark, str(tmp_path / "x.npz"))
    kept = df.where("spw = 1 and chan in (2, 5) and row_id >= 100 and row_id < 300")
    got = kept.collect()
    assert {(r.spw, r.chan) for r in got} == {(1, 2), (1, 5)} and len(got) == 400
    assert all(r.re == p["data"][r.chan, r.row_id].real for r in got)
    assert df.where("row_id in (3, 70) and chan = 0").count() == 4 and df.where("chan > 6 and row_id <= 9").count() == 20
    assert df.where("spw = 9").count() == 0 and df.where("spw = 0 and chan = 1 and chan = 2").count() == 0
    reader = files.NpzReader(str(tmp_path / "x.npz"))
    left = list(reader.pushFilters([files.EqualTo(("spw",), 1), files.In(("chan",), (2, 5)), files.GreaterThanOrEqual(("row_id",), 100), files.LessThan(("row_id",), 300), files.GreaterThan(("re",), 0.0)]))
    assert [type(f).__name__ for f in left] == ["GreaterThan"]
    taken[0] = 0
    assert sum(rows_of(reader, part) for part in reader.partitions()) == 400
    assert taken[0] < 100_000


def test_a_deflated_window_is_one_pass(spark, tmp_path):
    p, q = arrays(np.random.default_rng(3), 3, 700), arrays(np.random.default_rng(4), 2, 50)
    np.savez_compressed(tmp_path / "x.npz", n_spw=2, **{f"spw{k:03d}_{n}": a for k, w in enumerate((p, q)) for n, a in split(w).items()})
    reader = files.NpzReader(str(tmp_path / "x.npz"))
    assert [x.value[2] for x in reader.partitions()] == [None, None]
    df = files.read_visibilities(spark, str(tmp_path / "x.npz"))
    same(df.collect(), [p, q])
    assert df.where("chan = 1 and row_id >= 690").count() == 10


@pytest.mark.parametrize("save", [np.savez, np.savez_compressed])
def test_arrays_with_their_rows_outermost(spark, tmp_path, save, monkeypatch, caplog):
    p = arrays(np.random.default_rng(5), 4, 60)
    save(tmp_path / "x.npz", **{k: np.asfortranarray(v) for k, v in split(p).items()})
    same(files.read_visibilities(spark, str(tmp_path / "x.npz")).collect(), [p])
    monkeypatch.setattr(members, "TURNED_BYTES", 100)
    with members.opened(str(tmp_path / "x.npz")) as f:
        got = np.stack(list(members.npz_members(f)["data_re"].blocks(f)))
    assert np.array_equal(got, p["data"].real) and ("C order" in caplog.text) == (save is np.savez_compressed)


def test_a_short_member_is_an_error(tmp_path):
    p = arrays(np.random.default_rng(6), 2, 40)
    np.savez_compressed(tmp_path / "x.npz", **split(p))
    with zipfile.ZipFile(tmp_path / "x.npz") as z, zipfile.ZipFile(tmp_path / "y.npz", "w", zipfile.ZIP_DEFLATED) as out:
        for n in z.namelist():
            out.writestr(n, z.read(n)[:-100] if n == "data_im.npy" else z.read(n))
    reader = files.NpzReader(str(tmp_path / "y.npz"))
    with pytest.raises(EOFError):
        [rows_of(reader, part) for part in reader.partitions()]


@pytest.mark.parametrize("layout", ["stored", "deflated", "fits"])
def test_header_scan_reads_no_samples(spark, tmp_path, taken, layout):
    p = arrays(np.random.default_rng(7), 12, 3000)
    p["flags"][:, :5] = True
    if layout == "fits":
        fits_folder(tmp_path / "x", p)
        path = str(tmp_path / "x")
    else:
        path = str(tmp_path / "x.npz")
        (np.savez if layout == "stored" else np.savez_compressed)(path, **split(p))
    rows = files.scan_rows(spark, path)
    found = {r.row_id: r for r in rows.collect()}
    live = (~p["flags"]).sum(axis=0)
    assert {k: (r.n_live, r.row_keep, r.channels) for k, r in found.items()} == {k: (int(n), bool(n), 12) for k, n in enumerate(live)}
    assert all(found[k].length == pytest.approx(np.hypot(*p["uvw"][k, :2]) * p["frequencies"].max() / 299792458.0) for k in range(0, 3000, 97))
    w = files.scan_windows(rows).first()
    assert (w.n_rows, w.n_chan, w.n_samples, w.n_kept) == (3000, 12, int(live.sum()), 2995)
    reader = files.RowReader((files.FitsReader if layout == "fits" else files.NpzReader)(path))
    taken[0] = 0
    assert sum(rows_of(reader, part) for part in reader.partitions()) == 3000
    assert taken[0] < 3000 * (12 + 24) + 60_000


def some(spark, n=500, **change):
    cols = {"spw": "cast(id % 2 as int)", "chan": "cast(id % 3 as int)", "row_id": "id", "u_m": "id * 1.5D", "v_m": "id * -0.5D", "freq_hz": "230e9D + (id % 3) * 1e8D + (id % 2) * 1e9D", "re": "id * 1.0D", "im": "0.5D", "sig_re": "0.1D", "sig_im": "0.2D", "flag": "id % 7 = 0", "time_s": "id * 6.0D", **change}
    return spark.range(n).selectExpr(*(f"{v} as {k}" for k, v in cols.items() if v), "'x' as note").repartition(4)


def files_in(path):
    return sorted(str(f.relative_to(path)) for f in path.rglob("*") if f.is_file() and not f.name.startswith("."))


def test_dataset_is_read_as_written(spark, tmp_path):
    df = some(spark)
    dataset.write_visibilities(df, f"file://{tmp_path}/set", {"telescope": "none"})
    back = files.read_visibilities(spark, f"file://{tmp_path}/set")
    names = ["spw", "chan", "row_id", "u_m", "re", "sig_im", "flag", "time_s"]
    assert sorted(map(tuple, back.select(*names).collect())) == sorted(map(tuple, df.select(*names).collect()))
    assert back.where("ant1 is not null or w_m is not null").count() == 0
    assert json.loads((tmp_path / "set" / "_meta.json").read_text()) == {"telescope": "none", "rows": {"0": 250, "1": 250}}
    assert not any("_aside" in f for f in files_in(tmp_path / "set"))
    with pytest.raises(FileExistsError):
        dataset.write_visibilities(df, f"file://{tmp_path}/set")
    dataset.write_visibilities(some(spark, 20, flag=""), f"file://{tmp_path}/set", overwrite=True)
    assert files.read_visibilities(spark, f"file://{tmp_path}/set").where("not flag").count() == 20
    plain = spark.read.parquet(f"file://{tmp_path}/set")
    assert not {"flag", "ant1", "note"} & set(plain.columns)


@pytest.mark.parametrize("change, why", [({"sig_re": "if(id = 5, 0D, 0.1D)"}, "sig_re is not above zero in 1"), ({"re": "if(id = 5, double('nan'), 1D)"}, "re is not finite in 1"), ({"u_m": "if(id in (5, 6), null, 1D)"}, "u_m is not finite in 2"), ({"freq_hz": "id * 1e9D + 1"}, "frequencies differ"), ({"flag": "true"}, "no sample")])
def test_bad_datasets_are_refused_whole(spark, tmp_path, change, why):
    with pytest.raises(Exception, match=why):
        dataset.write_visibilities(some(spark, **change), f"file://{tmp_path}/set")
    assert files_in(tmp_path) == []


def test_flagged_samples_may_hold_anything(spark, tmp_path):
    dataset.write_visibilities(some(spark, re="if(id % 7 = 0, double('nan'), 1D)", sig_re="if(id % 7 = 0, -1D, 1D)"), f"file://{tmp_path}/set")
    assert files.read_visibilities(spark, f"file://{tmp_path}/set").where("not flag and re = 1").count() == 428


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    df = some(spark).withColumn("re", F.when(F.col("row_id") == 499, F.raise_error(F.lit("no such sample")).cast("double")).otherwise(F.col("re")))
    with pytest.raises(Exception, match="no such sample"):
        dataset.write_visibilities(df, f"file://{tmp_path}/set")
    assert files_in(tmp_path) == []


def test_missing_columns_are_named(spark, tmp_path):
    with pytest.raises(Exception, match="sig_im"):
        dataset.write_visibilities(some(spark).drop("sig_im"), f"file://{tmp_path}/set")


def legacy_export(path, vis, sigma, uv, hz, begins="sigma_statwt"):
    path.mkdir(exist_ok=True)
    reim = lambda a: np.stack([a.real, a.imag], -1)
    for name, a in (("visibilities", reim(vis)), (begins, reim(sigma)), ("uv_wavelengths", uv), ("frequencies", hz)):
        (path / f"{name}_target.fits").write_bytes(files.fits_bytes(np.ascontiguousarray(a)))


@pytest.mark.parametrize("hands, different", [("two", 2), ("doubled", 1), ("one", 1), ("three", 2)])
def test_prototype_exports(spark, tmp_path, hands, different, caplog):
    draw = np.random.default_rng(8)
    n_chan, n = 3, 40
    one, other = (draw.normal(size=(n_chan, n)) + 1j * draw.normal(size=(n_chan, n)) for _ in range(2))
    vis = {"two": np.stack([one, other]), "doubled": np.stack([one, one * (1 + 1e-9)]), "one": one, "three": np.stack([one, other, one])}[hands]
    sigma = np.full(vis.shape, 0.3 + 0.4j)
    hz, uvw = 230e9 + 1e9 * np.arange(n_chan), draw.normal(0, 100, (n, 2))
    uv = uvw[None] * (hz / 299792458.0)[:, None, None]
    legacy_export(tmp_path / "x", vis, sigma, uv[0] if hands == "one" else uv, hz, "sigma" if hands == "two" else "sigma_statwt")
    rows = files.read_visibilities(spark, f"file://{tmp_path}/x").collect()
    mean = np.atleast_3d(vis.reshape(-1, n_chan, n)).mean(0)
    assert len(rows) == n_chan * n
    for r in rows:
        assert complex(r.re, r.im) == pytest.approx(mean[r.chan, r.row_id]) and (r.u_m, r.v_m) == (pytest.approx(uvw[r.row_id, 0]), pytest.approx(uvw[r.row_id, 1]))
        assert r.sig_re == pytest.approx(0.3 / different**0.5) and r.sig_im == pytest.approx(0.4 / different**0.5) and r.freq_hz == hz[r.chan] and not r.flag
    assert ("differ" in caplog.text) == (hands in ("doubled", "three"))
    (tmp_path / "x" / "uv_wavelengths_target.fits").unlink()
    from fringeframe.sources import legacy

    assert legacy.legacy_files(f"file://{tmp_path}/x") is None
    with pytest.raises(FileNotFoundError):
        legacy.HandReader(f"file://{tmp_path}/x")
