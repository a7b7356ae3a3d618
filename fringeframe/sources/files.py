"""Readers of visibility files as Spark data sources (npz archives and FITS directories), and writers of datasets and planes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from fringeframe.sources.dataset import SCHEMA, read_dataset, write_visibilities  # noqa: F401
from fringeframe.sources.legacy import legacy_files, read_legacy
from fringeframe.sources.members import FITS_BLOCK, FITS_KINDS, Ranged, fits_header, fits_member, npz_members, opened, place

#: Rows of one partition, and of one Arrow batch.
PARTITION_ROWS, BATCH_ROWS = 1 << 20, 1 << 15
#: Arrays of a window besides its samples: one entry for each row.
PER_ROW = {"antenna1": np.int32, "antenna2": np.int32, "time": np.float64}
LIGHT = 299_792_458.0


class Held:
    """Bytes with the range reads of a file."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def read_at(self, size: int, at: int) -> bytes:
        return self.raw[at : at + size]


def fits_image(raw: bytes) -> tuple[dict[str, object], np.ndarray]:
    """Header and array of a primary image."""
    f = Ranged(Held(raw), len(raw))
    return fits_header(f)[0], fits_member(f).whole(f)


def fits_bytes(array: np.ndarray, cards: dict[str, object] | None = None) -> bytes:
    """A primary image of an array, 8-byte or 4-byte floats or integers as they are."""
    kinds = {np.dtype(v).newbyteorder("="): k for k, v in FITS_KINDS.items()}
    bits = kinds[array.dtype.newbyteorder("=")]
    header = {"SIMPLE": True, "BITPIX": bits, "NAXIS": array.ndim, **{f"NAXIS{k + 1}": n for k, n in enumerate(reversed(array.shape))}, **(cards or {})}
    lines = []
    for key, value in header.items():
        text = ("T" if value else "F").rjust(20) if isinstance(value, bool) else f"'{value:<8}'" if isinstance(value, str) else repr(value).upper().rjust(20)
        lines.append(f"{key:<8}= {text}".ljust(80))
    head = "".join([*lines, "END".ljust(80)]).encode("ascii")
    body = array.astype(FITS_KINDS[bits]).tobytes()
    return head + b" " * (-len(head) % FITS_BLOCK) + body + b"\0" * (-len(body) % FITS_BLOCK)


class Slice(InputPartition):
    """Rows first to stop of one channel of one window; chan None: all of the window, in one pass."""

    def __init__(self, prefix: str, spw: int, chan: int | None, first: int, stop: int):
        super().__init__((prefix, spw, chan, first, stop))


class Bounds:
    """What filters leave of windows, channels and rows."""

    COLUMNS = ("spw", "chan", "row_id")

    def __init__(self):
        self.low = dict.fromkeys(self.COLUMNS, 0)
        self.high = dict.fromkeys(self.COLUMNS, math.inf)
        self.only: dict[str, set[int]] = {}

    def take(self, f: Filter) -> bool:
        """Whether a filter is met in full from here on."""
        column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        value = getattr(f, "value", None)
        if column not in self.COLUMNS:
            return isinstance(f, IsNotNull) and column in self.COLUMNS
        if isinstance(f, IsNotNull):
            return True
        if isinstance(f, (EqualTo, In)):
            values = {v for v in (value if isinstance(f, In) else [value]) if v is not None}
            if column == "row_id":  # a range holds them; Spark picks from it
                self.low[column], self.high[column] = max(self.low[column], min(values, default=0)), min(self.high[column], max(values, default=-1) + 1)
                return isinstance(f, EqualTo)
            self.only[column] = self.only.get(column, values) & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            self.low[column] = max(self.low[column], value + isinstance(f, GreaterThan))
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            self.high[column] = min(self.high[column], value + isinstance(f, LessThanOrEqual))
        else:
            return False
        return True

    def keeps(self, column: str, value: int) -> bool:
        return self.low[column] <= value < self.high[column] and value in self.only.get(column, (value,))

    def spans(self, n: int) -> list[tuple[int, int]]:
        """Ranges of rows that are left of n, of at most PARTITION_ROWS."""
        low, high = int(max(0, self.low["row_id"])), int(min(n, self.high["row_id"]))
        return [(a, min(high, a + PARTITION_ROWS)) for a in range(low, high, PARTITION_ROWS)]


class VisibilityReader(DataSourceReader):
    """Splits files by window, channel and row range; filters on spw, chan and row_id leave the rest unread.

    ``window`` gives a window's arrays by name with the open files that hold them, ``prefixes`` the windows. Planning reads headers;
    a slice reads its own bytes of each array. A window with a deflated array can't be entered in the middle: it is one
    partition, which goes through its members once, side by side, a channel at a time.
    """

    def __init__(self, path: str):
        self.path, self.bounds = path, Bounds()

    def prefixes(self) -> list[str]:
        raise NotImplementedError

    def window(self, prefix: str):
        """For with: {name: (Member, Ranged)}."""
        raise NotImplementedError

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.bounds.take(f):
                yield f

    def partitions(self) -> list[Slice]:
        out = []
        for spw, prefix in enumerate(self.prefixes()):
            if not self.bounds.keeps("spw", spw):
                continue
            with self.window(prefix) as there:
                n, channels = there["uvw"][0].shape[0], max(1, math.prod(there["frequencies"][0].shape))
                deflated = any(m.at is None for m, _ in there.values())
            spans = self.bounds.spans(n)
            kept = [c for c in range(channels) if self.bounds.keeps("chan", c)]
            if deflated and spans and kept:
                out.append(Slice(prefix, spw, None, spans[0][0], spans[-1][1]))
            elif not deflated:
                out += [Slice(prefix, spw, c, a, b) for c in kept for a, b in spans]
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no partition is left
            return
        prefix, spw, chan, first, stop = partition.value
        with self.window(prefix) as there:
            frequencies = np.atleast_1d(there["frequencies"][0].whole(there["frequencies"][1]))
            yield from self.sliced(there, frequencies, spw, chan, first, stop) if chan is not None else self.passed(there, frequencies, spw, first, stop)

    def sliced(self, there: dict, frequencies: np.ndarray, spw: int, chan: int, first: int, stop: int) -> Iterator[pa.RecordBatch]:
        for at in range(first, stop, BATCH_ROWS):
            end = min(stop, at + BATCH_ROWS)
            part = lambda name, lead=(): there[name][0].rows(there[name][1], at, end, lead) if name in there else None  # noqa: E731, B023
            values = [complex_of(*(part(n, (chan,)) for n in (name, f"{name}_re", f"{name}_im"))) for name in ("data", "noise")]
            yield batch(spw, chan, frequencies[chan], at, part("uvw"), *values, part("flags", (chan,)), {n: part(n) for n in PER_ROW})

    def passed(self, there: dict, frequencies: np.ndarray, spw: int, first: int, stop: int) -> Iterator[pa.RecordBatch]:
        rows = {n: there[n][0].whole(there[n][1]) for n in ("uvw", *PER_ROW) if n in there}
        names = [n for n in ("data", "data_re", "data_im", "noise", "noise_re", "noise_im", "flags") if n in there]
        streams = zip(*(there[n][0].blocks(there[n][1]) for n in names), strict=True)
        for chan, blocks in enumerate(streams):
            if not self.bounds.keeps("chan", chan):
                continue
            own = dict(zip(names, blocks, strict=True))
            values = [complex_of(*(own.get(n) for n in (name, f"{name}_re", f"{name}_im"))) for name in ("data", "noise")]
            for a, b in self.bounds.spans(len(rows["uvw"])):
                for at in range(max(a, first), min(b, stop), BATCH_ROWS):
                    cut = slice(at, min(b, stop, at + BATCH_ROWS))
                    flags = own["flags"][cut] if "flags" in own else None
                    yield batch(spw, chan, frequencies[chan], at, rows["uvw"][cut], *(v[cut] for v in values), flags, {n: rows[n][cut] if n in rows else None for n in PER_ROW})


def batch(spw: int, chan: int, frequency: float, first: int, uvw: np.ndarray, data: np.ndarray, noise: np.ndarray, flags: np.ndarray | None, rows: dict) -> pa.RecordBatch:
    """Rows of SCHEMA from the slices of a window's arrays."""
    n = len(uvw)
    columns = [pa.array(np.full(n, spw, np.int32)), pa.array(np.full(n, chan, np.int32)), pa.array(np.arange(first, first + n)), *(pa.array(uvw[:, k].astype(float)) for k in range(3)), pa.array(np.full(n, float(frequency)))]
    columns += [pa.array(np.ascontiguousarray(part, float)) for x in (data, noise) for part in (x.real, x.imag)]
    columns.append(pa.array(np.zeros(n, bool) if flags is None else flags.astype(bool)))
    columns += [pa.nulls(n, pa.from_numpy_dtype(np.dtype(kind))) if rows[name] is None else pa.array(rows[name].astype(kind)) for name, kind in PER_ROW.items()]
    return pa.RecordBatch.from_arrays(columns, ["spw", "chan", "row_id", "u_m", "v_m", "w_m", "freq_hz", "re", "im", "sig_re", "sig_im", "flag", "ant1", "ant2", "time_s"])


def complex_of(a: np.ndarray | None, re: np.ndarray | None = None, im: np.ndarray | None = None) -> np.ndarray:
    """Complex values from complex, from a last axis of (real, imaginary), or from two arrays."""
    if a is None:
        return re + 1j * im
    return a if np.iscomplexobj(a) else a[..., 0] + 1j * a[..., 1]


class NpzReader(VisibilityReader):
    """One archive: plain member names, or spw000_ and so on with n_spw; values as data or as data_re and data_im."""

    def prefixes(self) -> list[str]:
        with opened(self.path) as f:
            n = npz_members(f).get("n_spw")
            return [""] if n is None else [f"spw{k:03d}_" for k in range(int(n.whole(f)))]

    @contextmanager
    def window(self, prefix: str):
        with opened(self.path) as f:
            yield {k.removeprefix(prefix): (m, f) for k, m in npz_members(f).items() if k.startswith(prefix)}


class FitsReader(VisibilityReader):
    """A directory of name.fits, or of such directories spw000, spw001 and so on."""

    def prefixes(self) -> list[str]:
        files, p = place(self.path)
        inside = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(p)) if i.type == fs.FileType.Directory and i.base_name.startswith("spw"))
        return [f"{x}/" for x in inside] or [""]

    @contextmanager
    def window(self, prefix: str):
        files, p = place(self.path)
        with ExitStack() as stack:
            there = {}
            for name in ("uvw", "frequencies", "data", "noise", "flags", *PER_ROW):
                path = f"{self.path.rstrip('/')}/{prefix}{name}.fits"
                if files.get_file_info(place(path)[1]).type == fs.FileType.File:
                    f = stack.enter_context(opened(path))
                    there[name] = fits_member(f, name), f
            yield there


class RowReader(DataSourceReader):
    """Rows (spw, row_id, channels, n_live, length) of a reader's windows without their samples: places, frequencies and flags are read."""

    def __init__(self, reader: VisibilityReader):
        self.reader = reader

    def partitions(self) -> list[Slice]:
        out = []
        for spw, prefix in enumerate(self.reader.prefixes()):
            with self.reader.window(prefix) as there:
                n, whole = there["uvw"][0].shape[0], "flags" in there and there["flags"][0].at is None
            out += [Slice(prefix, spw, None, 0, n)] if whole else [Slice(prefix, spw, None, a, min(n, a + PARTITION_ROWS)) for a in range(0, n, PARTITION_ROWS)]
        return out

    def read(self, partition: Slice | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        prefix, spw, _, first, stop = partition.value
        with self.reader.window(prefix) as there:
            frequencies = np.atleast_1d(there["frequencies"][0].whole(there["frequencies"][1]))
            channels, scale = len(frequencies), float(np.max(frequencies, initial=0.0)) / LIGHT
            live = np.full(stop - first, channels, np.int64)
            flags, f = there.get("flags", (None, None))
            if flags is not None:
                live[:] = 0
                for part in (flags.blocks(f) if flags.at is None else (flags.rows(f, first, stop, (c,)) for c in range(channels))):
                    live += ~part.astype(bool)
            uvw, g = there["uvw"]
            place_of = uvw.whole(g)[first:stop] if uvw.at is None else uvw.rows(g, first, stop)
            for at in range(0, stop - first, BATCH_ROWS):
                part = slice(at, min(stop - first, at + BATCH_ROWS))
                n = part.stop - part.start
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, spw, np.int32)), pa.array(np.arange(first + part.start, first + part.stop)), pa.array(np.full(n, channels, np.int32)), pa.array(live[part]), pa.array(np.hypot(place_of[part, 0], place_of[part, 1]).astype(float) * scale)],
                    ["spw", "row_id", "channels", "n_live", "length"],
                )


class NpzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "visnpz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options["path"])


class HeaderSource(DataSource):
    """The rows of files of either kind, by their path, without samples."""

    @classmethod
    def name(cls) -> str:
        return "visrows"

    def schema(self) -> str:
        return "spw int, row_id long, channels int, n_live long, length double"

    def reader(self, schema) -> RowReader:
        path = self.options["path"]
        return RowReader((NpzReader if path.endswith(".npz") else FitsReader)(path))


class FitsSource(NpzSource):
    @classmethod
    def name(cls) -> str:
        return "visfits"

    def reader(self, schema) -> FitsReader:
        return FitsReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the formats known to the session, and let filters reach them."""
    for source in (NpzSource, FitsSource, HeaderSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_visibilities(spark: SparkSession, path: str) -> DataFrame:
    """Samples of an npz archive, a FITS directory, a prototype export or a Parquet dataset, by what the path looks like."""
    register(spark)
    if path.endswith(".npz"):
        return spark.read.format("visnpz").load(path)
    if legacy_files(path) is not None:
        return read_legacy(spark, path)
    files, p = place(path)
    listed = files.get_file_info(fs.FileSelector(p, recursive=True))
    if any(i.path.endswith(".fits") for i in listed):
        return spark.read.format("visfits").load(path)
    return read_dataset(spark, path)


def scan_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row per row of a dataset's files: its window's channels, those not flagged, its baseline's length in wavelengths at the
    window's highest frequency, and whether any channel is left."""
    register(spark)
    return spark.read.format("visrows").load(path).withColumn("row_keep", F.col("n_live") > 0)


def scan_windows(rows: DataFrame) -> DataFrame:
    """(spw, n_rows, n_chan, n_samples, n_kept, longest) of what ``scan_rows`` gives."""
    return rows.groupBy("spw").agg(F.count(F.lit(1)).alias("n_rows"), F.max("channels").alias("n_chan"), F.sum("n_live").alias("n_samples"), F.sum(F.col("row_keep").cast("long")).alias("n_kept"), F.max("length").alias("longest"))


def plane_bytes(plane: DataFrame, value: str, n: int, step_arcsec: float, cards: dict | None = None, n_x: int | None = None) -> bytes:
    """A FITS image of a plane of n rows and n (or ``n_x``) columns (pix_y, pix_x, value), rows turned so that north is up; missing pixels are NaN."""
    n_x = n_x or n
    out = np.full((n, n_x), np.nan, np.float32)
    for r in plane.select("pix_y", "pix_x", value).toLocalIterator():
        out[r[0], r[1]] = np.nan if r[2] is None else r[2]
    return fits_bytes(out[::-1], {"CTYPE1": "RA---SIN", "CTYPE2": "DEC--SIN", "CRPIX1": (n_x + 1) / 2, "CRPIX2": (n + 1) / 2, "CDELT1": -step_arcsec / 3600, "CDELT2": step_arcsec / 3600, **(cards or {})})
