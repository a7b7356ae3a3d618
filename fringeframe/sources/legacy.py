"""Prototype exports: one FITS array for each kind of value, hands first, baselines in wavelengths."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fringeframe.functions.sky import LIGHT
from fringeframe.sources.dataset import SCHEMA
from fringeframe.sources.members import fits_member, opened, place

logger = logging.getLogger(__name__)

#: Rows of a partition and of a batch.
PARTITION_ROWS, BATCH_ROWS = 1 << 20, 1 << 15
#: How a file of each kind may begin, the better name first; the rest of a name is that of the visibilities.
BEGINS = {"visibilities": ("visibilities",), "sigma": ("sigma_statwt", "sigma"), "uv": ("uv_wavelengths",), "frequencies": ("frequencies",)}
#: Values count as equal within these shares of themselves and of one.
RELATIVE, ABSOLUTE = 1e-5, 1e-8


def legacy_files(path: str) -> dict[str, str] | None:
    """Paths of the four files of such an export, or None where one is missing."""
    files, root = place(path)
    if files.get_file_info(root).type != fs.FileType.Directory:
        return None
    names = sorted(i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".fits"))
    first = next((n for n in names if n.startswith("visibilities_")), None)
    if first is None:
        return None
    stem, found = first[len("visibilities_") :], {}
    for kind, begins in BEGINS.items():
        for b in begins:
            own = [n for n in names if n.startswith(f"{b}_")]
            if own:
                found[kind] = f"{path.rstrip('/')}/{f'{b}_{stem}' if f'{b}_{stem}' in own else own[0]}"
                break
    return found if len(found) == len(BEGINS) else None


class Hand(InputPartition):
    def __init__(self, hand: int, chan: int, first: int, stop: int):
        super().__init__((hand, chan, first, stop))


class HandReader(DataSourceReader):
    """Rows of one hand and channel by their byte range; uvw in metres come from the first channel's wavelengths."""

    def __init__(self, path: str):
        found = legacy_files(path)
        if found is None:
            raise FileNotFoundError(f"no prototype export in {path}")
        self.files = found

    @contextmanager
    def arrays(self):
        with ExitStack() as stack:
            there = {}
            for kind, path in self.files.items():
                f = stack.enter_context(opened(path))
                there[kind] = fits_member(f, path), f
            yield there

    def partitions(self) -> list[Hand]:
        with self.arrays() as there:
            shape = there["visibilities"][0].shape
            if there["sigma"][0].shape != shape or shape[-1] != 2 or len(shape) not in (3, 4):
                raise ValueError(f"visibilities of shape {shape} and noise of shape {there['sigma'][0].shape}")
        hands, channels, n = (1, *shape)[-4:-1]
        return [Hand(h, c, a, min(n, a + PARTITION_ROWS)) for h in range(hands) for c in range(channels) for a in range(0, n, PARTITION_ROWS)]

    def read(self, partition: Hand | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            return
        hand, chan, first, stop = partition.value
        with self.arrays() as there:
            hz = np.atleast_1d(there["frequencies"][0].whole(there["frequencies"][1])).astype(float)
            for a in range(first, stop, BATCH_ROWS):
                b = min(stop, a + BATCH_ROWS)
                part = lambda kind, lead: there[kind][0].rows(there[kind][1], a, b, lead[-(len(there[kind][0].shape) - 2) :] if len(there[kind][0].shape) > 2 else ())  # noqa: E731, B023
                value, sigma, uv = part("visibilities", (hand, chan)), part("sigma", (hand, chan)), part("uv", (0, 0)) * (LIGHT / hz[0])
                n = b - a
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, hand, np.int32)), pa.array(np.full(n, chan, np.int32)), pa.array(np.arange(a, b)), pa.array(np.full(n, hz[chan])), *(pa.array(np.ascontiguousarray(x[:, k], float)) for x in (uv, value, sigma) for k in range(2))],
                    ["hand", "chan", "row_id", "freq_hz", "u_m", "v_m", "re", "im", "sig_re", "sig_im"],
                )


class HandSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vishands"

    def schema(self) -> str:
        return "hand int, chan int, row_id long, freq_hz double, u_m double, v_m double, re double, im double, sig_re double, sig_im double"

    def reader(self, schema) -> HandReader:
        return HandReader(self.options["path"])


def independent(hands: DataFrame) -> tuple[int, int]:
    """(hands, how many of them differ) of rows (hand, chan, row_id, re, im). A hand stored twice, to rounding, is one.

    A row of the aggregate holds a sample's few hands; what leaves Spark is one truth for each pair of hands.
    """
    n = (hands.agg(F.max("hand")).first()[0] or 0) + 1
    if n == 1:
        return 1, 1
    value = [(F.max(F.when(F.col("hand") == h, F.col("re"))).alias(f"re{h}"), F.max(F.when(F.col("hand") == h, F.col("im"))).alias(f"im{h}")) for h in range(n)]
    wide = hands.groupBy("chan", "row_id").agg(*(c for both in value for c in both))
    pairs = [(i, j) for i in range(n) for j in range(i)]
    close = lambda i, j: F.hypot(F.col(f"re{i}") - F.col(f"re{j}"), F.col(f"im{i}") - F.col(f"im{j}")) <= ABSOLUTE + RELATIVE * F.hypot(F.col(f"re{j}"), F.col(f"im{j}"))
    same = wide.agg(*(F.bool_and(F.coalesce(close(i, j), F.lit(False))).alias(f"same_{i}_{j}") for i, j in pairs)).first()
    kept: list[int] = []
    for i in range(n):
        if not any(same[f"same_{i}_{j}"] for j in kept):
            kept.append(i)
    return n, len(kept)


def read_legacy(spark: SparkSession, path: str) -> DataFrame:
    """Samples (SCHEMA) of a prototype export: the mean over hands, with the noise of as many measurements as there are different hands."""
    spark.dataSource.register(HandSource)
    hands = spark.read.format("vishands").load(path)
    n, different = independent(hands)
    if different < n:
        logger.warning("%d hands of which %d differ: the noise is that of %d", n, different, different)
    sigma = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c))) / F.lit(float((n * different) ** 0.5))
    cells = hands.groupBy("chan", "row_id").agg(F.first("freq_hz").alias("freq_hz"), F.first("u_m").alias("u_m"), F.first("v_m").alias("v_m"), F.avg("re").alias("re"), F.avg("im").alias("im"), sigma("sig_re").alias("sig_re"), sigma("sig_im").alias("sig_im"))
    given = {"spw": F.lit(0), "w_m": F.lit(0.0), "flag": F.lit(False)}
    return cells.select(*((F.col(name) if name in cells.columns else given.get(name, F.lit(None))).cast(kind).alias(name) for name, kind in (c.split() for c in SCHEMA.split(", "))))
