"""Image cubes in FITS files as tables: a partition reads the bytes of its rows, filters on planes leave the rest unread."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from fringeframe.sources.members import Member, fits_header, fits_member, opened

#: Pixels of a partition and of a batch.
PARTITION_PIXELS, BATCH_PIXELS = 1 << 22, 1 << 16
#: Units of a frequency axis in Hz.
HERTZ = {"": 1.0, "HZ": 1.0, "KHZ": 1e3, "MHZ": 1e6, "GHZ": 1e9}


def cube_member(path: str) -> tuple[dict, Member]:
    """Header and member of a cube of planes, rows and columns; leading axes of length one are left aside."""
    with opened(path) as f:
        header, member = fits_header(f)[0], fits_member(f, path)
    shape = list(member.shape)
    while len(shape) > 3 and shape[0] == 1:
        shape.pop(0)
    if len(shape) == 2:
        shape.insert(0, 1)
    if len(shape) != 3:
        raise ValueError(f"{path} is no cube: its shape is {member.shape}")
    member.shape = tuple(shape)
    return header, member


class Rows(InputPartition):
    def __init__(self, plane: int, first: int, stop: int):
        super().__init__((plane, first, stop))


class CubeReader(DataSourceReader):
    def __init__(self, path: str):
        self.path, self.low, self.high, self.only = path, 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = getattr(f, "attribute", None) == ("plane",)
            if own and isinstance(f, (EqualTo, In)):
                named = {v for v in (f.value if isinstance(f, In) else [f.value]) if v is not None}
                self.only = named if self.only is None else self.only & named
            elif own and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif own and isinstance(f, (LessThan, LessThanOrEqual)):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high = stop if self.high is None else min(self.high, stop)
            elif not (own and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[Rows]:
        _, member = cube_member(self.path)
        planes, n_y, n_x = member.shape
        step = max(1, PARTITION_PIXELS // max(1, n_x))
        kept = [p for p in range(self.low, planes if self.high is None else min(planes, self.high)) if self.only is None or p in self.only]
        return [Rows(p, a, min(n_y, a + step)) for p in kept for a in range(0, n_y, step)]

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        plane, first, stop = partition.value
        _, member = cube_member(self.path)
        _, n_y, n_x = member.shape
        step = max(1, BATCH_PIXELS // max(1, n_x))
        with opened(self.path) as f:
            for a in range(first, stop, step):
                b = min(stop, a + step)
                values = member.rows(f, a, b, (plane,)).astype(np.float64).reshape(-1)
                row = np.repeat(np.arange(n_y - 1 - a, n_y - 1 - b, -1, dtype=np.int32), n_x)  # the file's first row is the southernmost
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), plane, np.int32)), pa.array(row), pa.array(np.tile(np.arange(n_x, dtype=np.int32), b - a)), pa.array(values, mask=~np.isfinite(values))], ["plane", "pix_y", "pix_x", "value"])


class CubeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "viscube"

    def schema(self) -> str:
        return "plane int, pix_y int, pix_x int, value double"

    def reader(self, schema) -> CubeReader:
        return CubeReader(self.options["path"])


def read_cube(spark: SparkSession, path: str) -> DataFrame:
    """(plane, pix_y, pix_x, value) of a FITS cube or image, row 0 in the north; what is no number is null."""
    spark.dataSource.register(CubeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("viscube").load(path)


def frequencies(header: dict, planes: int) -> list[float]:
    """Hz of each plane: one card for each (FREQ0001 and so on) where the axis is uneven, else reference, place and step of the third axis."""
    own = [header.get(f"FREQ{k + 1:04d}") for k in range(planes)]
    if all(f is not None for f in own):
        return [float(f) for f in own]
    if not str(header.get("CTYPE3", "")).upper().startswith("FREQ"):
        raise ValueError("the cube needs a frequency axis")
    unit = str(header.get("CUNIT3", "")).strip().upper()
    if unit not in HERTZ:
        raise ValueError(f"no unit of frequency: {unit}")
    return [(float(header["CRVAL3"]) + (k + 1 - float(header.get("CRPIX3", 1))) * float(header["CDELT3"])) * HERTZ[unit] for k in range(planes)]


def spectral_axis(spark: SparkSession, path: str, rest_hz: float | None = None, systemic: float = 0.0) -> DataFrame:
    """(plane, freq_hz, velocity): radio velocities in km/s about a rest frequency, given or from RESTFRQ or RESTFREQ, less the systemic one."""
    from fringeframe.functions.sky import LIGHT

    header, member = cube_member(path)
    rest = rest_hz or header.get("RESTFRQ") or header.get("RESTFREQ")
    if not rest:
        raise ValueError("no rest frequency: give one, or put RESTFRQ into the header")
    hz = frequencies(header, member.shape[0])
    return spark.createDataFrame([(k, f, LIGHT / 1e3 * (1 - f / float(rest)) - systemic) for k, f in enumerate(hz)], "plane int, freq_hz double, velocity double")
