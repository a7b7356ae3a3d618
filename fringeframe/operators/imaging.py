"""Images and sufficient statistics: sums over samples, taken as dense partial arrays in each task and added by pixel."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.functions.sky import ARCSEC, image_weight
from fringeframe.session import held

#: Samples whose phases are held at a time, keys whose arrays a task holds, groups of tasks whose arrays are added first.
ROWS, MOST_KEYS, FAN = 4096, 64, 16


def samples(vis: DataFrame, frequency: Column) -> DataFrame:
    """(spw, chan, u, v, re, im, sig_re, sig_im) of unflagged samples; u and v in wavelengths, v's sign turned."""
    from fringeframe.functions.sky import u_lambda, v_lambda

    return vis.where(~F.coalesce(F.col("flag"), F.lit(False))).select("spw", "chan", u_lambda(frequency).alias("u"), v_lambda(frequency).alias("v"), "re", "im", "sig_re", "sig_im")


@dataclass(frozen=True)
class Plane:
    """Sums over samples of Re[(re + i im) e^{+2 pi i (u x + v y)}] on a grid; im None is zero."""

    name: str
    ys: tuple[float, ...]
    xs: tuple[float, ...]
    re: str
    im: str | None = None


def one_pass(points: DataFrame, planes: Sequence[Plane], totals: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """(keys, plane, pix_y, pix_x, value): all planes and the sums of the columns ``totals`` (planes of one pixel) from one scan.

    The phase factors into axes, so a batch costs a product of small matrices, and planes on the same grid share it. With
    keys a task holds an array for each; samples stay where they are while there are MOST_KEYS keys at most, which a look at the key columns
    tells, and are dealt by key beyond it, so that a task meets few. One that meets more all the same emits what it has and goes on. A
    task's sums leave as one array, arrays are added in FAN groups of tasks, and only those are taken apart by pixel.
    """
    numbers = dict.fromkeys(c for p in planes for c in (p.re, p.im) if c)
    places = [(p.name, iy, ix) for p in planes for iy in range(len(p.ys)) for ix in range(len(p.xs))] + [(t, 0, 0) for t in totals]
    names = [p.name for p in planes] + list(totals)
    number = {n: k for k, n in enumerate(names)}
    plane_of, y_of, x_of = (np.array(c, np.int32) for c in ([number[n] for n, _, _ in places], [y for _, y, _ in places], [x for _, _, x in places]))
    kinds = dict(points.dtypes)
    columns = list(dict.fromkeys(["u", "v", *numbers, *totals]))
    source = points.select(*keys, *columns)
    if keys and points.select(*keys).distinct().limit(MOST_KEYS + 1).count() > MOST_KEYS:
        deals = max(FAN, points.sparkSession.sparkContext.defaultParallelism)
        source = source.withColumn("deal_", F.spark_partition_id() % deals).repartition(*keys, "deal_").drop("deal_")

    def sums_of(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
        get = {n: batch.column(n).to_numpy(zero_copy_only=False)[rows] for n in columns}
        out = []
        for at in range(0, len(rows), ROWS):
            part = slice(at, at + ROWS)
            turned: dict[tuple, np.ndarray] = {}
            own = []
            for p in planes:
                for axis, values in (("u", p.xs), ("v", p.ys)):
                    if (axis, values) not in turned:
                        turned[axis, values] = np.exp(2j * math.pi * ARCSEC * np.outer(get[axis][part], values))
                value = get[p.re][part] + (1j * get[p.im][part] if p.im else 0)
                own.append(((turned["v", p.ys] * value[:, None]).T @ turned["u", p.xs]).real.reshape(-1))
            out.append(np.concatenate([*own, [get[t][part].sum() for t in totals]]))
        return np.sum(out, axis=0)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[tuple, np.ndarray] = {}
        group = TaskContext.get().partitionId() % FAN

        def flush() -> pa.RecordBatch:
            rows = list(mine.items())
            mine.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k[c] for k, _ in rows], column_kinds[c]) for c in range(len(keys))), pa.array([group] * len(rows), pa.int32()), pa.array([v for _, v in rows], pa.list_(pa.float64()))], [*keys, "group_", "sums_"])

        for batch in batches:
            column_kinds = [batch.column(k).type for k in keys]
            if keys:
                coded = [batch.column(k).dictionary_encode() for k in keys]
                code = np.zeros(batch.num_rows, np.int64)
                for c in coded:
                    code = code * (len(c.dictionary) + 1) + c.indices.fill_null(len(c.dictionary)).to_numpy()
                found = [np.flatnonzero(code == k) for k in np.unique(code)]
            else:
                found = [np.arange(batch.num_rows)]
            for rows in found:
                if not len(rows):
                    continue
                key = tuple(batch.column(k)[int(rows[0])].as_py() for k in keys)
                mine[key] = mine[key] + sums_of(batch, rows) if key in mine else sums_of(batch, rows)
                if len(mine) > MOST_KEYS:
                    yield flush()
        if mine:
            yield flush()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (keys, group) to one set of pixels each."""
        mark, total = None, None

        def rows() -> pa.RecordBatch:
            own = [pa.array([v] * len(total), kind) for v, kind in zip(mark[:-1], column_kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*own, pa.array(plane_of), pa.array(y_of), pa.array(x_of), pa.array(total)], [*keys, "plane_", "pix_y", "pix_x", "value"])

        for batch in batches:
            column_kinds = [c.type for c in batch.columns[: len(keys)]]
            for k in range(batch.num_rows):
                now = tuple(c[k].as_py() for c in batch.columns[: len(keys) + 1])
                value = batch.column("sums_")[k].values.to_numpy()
                if now == mark:
                    total = total + value
                    continue
                if mark is not None:
                    yield rows()
                mark, total = now, value
        if mark is not None:
            yield rows()

    of_keys = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    arrays = source.mapInArrow(partial, f"{of_keys}group_ int, sums_ array<double>")
    grouped = arrays.repartition(*keys, "group_").sortWithinPartitions(*keys, "group_")
    taken = grouped.mapInArrow(added, f"{of_keys}plane_ int, pix_y int, pix_x int, value double")
    summed = taken.groupBy(*keys, "plane_", "pix_y", "pix_x").agg(F.sum("value").alias("value"))
    return summed.select(*keys, F.element_at(F.array(*(F.lit(n) for n in names)), F.col("plane_") + 1).alias("plane"), "pix_y", "pix_x", "value")


def gridded_sums(points: DataFrame, ny: int, nx: int, y_arcsec: np.ndarray, x_arcsec: np.ndarray, columns: tuple[str, ...], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, pix_y, pix_x, value per column): ``one_pass`` over planes of one grid, side by side; ``columns`` are names of pairs (name_re, name_im)."""
    planes = [Plane(n, tuple(map(float, y_arcsec)), tuple(map(float, x_arcsec)), f"{n}_re", f"{n}_im") for n in columns]
    long = one_pass(points, planes, (), keys)
    return long.groupBy(*keys, "pix_y", "pix_x").agg(*(F.sum(F.when(F.col("plane") == n, F.col("value"))).alias(n) for n in columns))


def axes(n: int, fov_arcsec: float) -> tuple[np.ndarray, np.ndarray]:
    """(y, x) offsets of pixel centres: row 0 is north, x grows to the west of the image (offset in right ascension is -x)."""
    step = fov_arcsec / n
    at = (np.arange(n) - (n - 1) / 2) * step
    return -at, -at


def weighted(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The columns that planes and totals of the terms are made of."""
    w, sr, si = image_weight(F.col("sig_re"), F.col("sig_im")), F.col("sig_re") * F.col("sig_re"), F.col("sig_im") * F.col("sig_im")
    return points.select(
        *keys,
        "u",
        "v",
        w.alias("sum_w"),
        (w * F.col("re")).alias("w_re"),
        (w * F.col("im")).alias("w_im"),
        (F.col("re") / sr).alias("d_re"),
        (F.col("im") / si).alias("d_im"),
        F.lit(1.0).alias("n_vis"),
        (F.col("re") * F.col("re") / sr + F.col("im") * F.col("im") / si).alias("data_term"),
        (F.log(F.lit(2 * math.pi) * sr) + F.log(F.lit(2 * math.pi) * si)).alias("noise_norm"),
    )


def grid(n: int, fov_arcsec: float) -> tuple[tuple[float, ...], tuple[float, ...]]:
    return tuple(tuple(map(float, a)) for a in axes(n, fov_arcsec))


def dirty_image(points: DataFrame, n: int, fov_arcsec: float) -> DataFrame:
    """(pix_y, pix_x, dirty, beam): natural-weight image of the data and of a unit point, divided by the sum of weights; one scan."""
    y, x = grid(n, fov_arcsec)
    long = held(one_pass(weighted(points), [Plane("dirty", y, x, "w_re", "w_im"), Plane("beam", y, x, "sum_w")], ["sum_w"]))
    total = long.where("plane = 'sum_w'").select(F.col("value").alias("total_"))
    wide = long.where("plane <> 'sum_w'").groupBy("pix_y", "pix_x").agg(*(F.sum(F.when(F.col("plane") == p, F.col("value"))).alias(p) for p in ("dirty", "beam")))
    return wide.crossJoin(F.broadcast(total)).select("pix_y", "pix_x", *((F.col(p) / F.col("total_")).alias(p) for p in ("dirty", "beam")))  # one row


def lags(n: int, fov_arcsec: float) -> tuple[float, ...]:
    """Offsets of the doubled grid, from -n to n - 1 pixels."""
    return tuple(map(float, -np.arange(-n, n) * (fov_arcsec / n)))


def kernel(points: DataFrame, n: int, fov_arcsec: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(lag_y, lag_x, kernel): sum of cos 2 pi (u dx + v dy) / sigma^2 at every lag of the doubled grid, from -n to n-1 pixels."""
    at = lags(n, fov_arcsec)
    long = one_pass(weighted(points, keys), [Plane("kernel", at, at, "sum_w")], (), keys)
    return long.select(*keys, (F.col("pix_y") - n).alias("lag_y"), (F.col("pix_x") - n).alias("lag_x"), F.col("value").alias("kernel"))


SCALARS = ("n_vis", "sum_w", "data_term", "noise_norm")


def terms(points: DataFrame, n: int, fov_arcsec: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, plane, pix_y, pix_x, value): kernel (lags from -n), dirty image and beam sums, data image and the scalars of each key, from one scan.

    All are additive, so those of several windows or channels are the sum of theirs (``added_terms``).
    """
    y, x = grid(n, fov_arcsec)
    at = lags(n, fov_arcsec)
    planes = [Plane("kernel", at, at, "sum_w"), Plane("dirty", y, x, "w_re", "w_im"), Plane("beam", y, x, "sum_w"), Plane("data", y, x, "d_re", "d_im")]
    return one_pass(weighted(points, keys), planes, SCALARS, keys)


def added_terms(parts: DataFrame) -> DataFrame:
    """Terms of all keys as those of one dataset: field-wise sums."""
    return parts.groupBy("plane", "pix_y", "pix_x").agg(F.sum("value").alias("value"))


def scalar_terms(points: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The additive scalars: n_vis, sum_w, data_term (chi square of nothing), noise_norm."""
    sr, si = F.col("sig_re") * F.col("sig_re"), F.col("sig_im") * F.col("sig_im")
    return points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_vis"),
        F.sum(image_weight(F.col("sig_re"), F.col("sig_im"))).alias("sum_w"),
        F.sum(F.col("re") * F.col("re") / sr + F.col("im") * F.col("im") / si).alias("data_term"),
        F.sum(F.log(F.lit(2 * math.pi) * sr) + F.log(F.lit(2 * math.pi) * si)).alias("noise_norm"),
    )


def combine(parts: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Terms of several parts as those of the whole: field-wise sums."""
    return parts.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("n_vis", "sum_w", "data_term", "noise_norm")))


def pixels(spark: SparkSession, n: int, fov_arcsec: float) -> DataFrame:
    """(pix_y, pix_x, x_as, y_as): the image grid; x_as is minus the offset in right ascension."""
    step = fov_arcsec / n
    grid = spark.range(n * n).select(F.floor(F.col("id") / n).cast("int").alias("pix_y"), (F.col("id") % n).cast("int").alias("pix_x"))
    return grid.withColumns({"x_as": (F.col("pix_x") - (n - 1) / 2) * F.lit(step), "y_as": -(F.col("pix_y") - (n - 1) / 2) * F.lit(step)})
