"""What a fit delivers: restored beam and image, tables of planes, cached terms, the record of a run."""

from __future__ import annotations

import hashlib
import json
import logging
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeframe.operators.wcs import Grid
from fringeframe.plans.inversion import Terms
from fringeframe.sources.files import place

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class Beam:
    """Widths (standard deviations, arcseconds) and angle from the row axis in degrees."""

    major: float
    minor: float
    angle: float

    def solid_angle(self, step: float) -> float:
        """In pixels."""
        return 2 * math.pi * self.major * self.minor / step**2


def fit_beam(beam: np.ndarray, step: float, level: float = 0.1) -> Beam:
    """The elliptical Gaussian that fits the main lobe above ``level``: least squares on the logarithm, weighted by the square."""
    n = len(beam)
    y, x = np.mgrid[0:n, 0:n] * step
    top = np.unravel_index(int(beam.argmax()), beam.shape)
    dy, dx = y - y[top], x - x[top]
    seen, front = np.zeros(beam.shape, bool), [top]
    while front:
        p = front.pop()
        if 0 <= p[0] < n and 0 <= p[1] < n and not seen[p] and beam[p] > level * beam[top]:
            seen[p] = True
            front += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    v = beam[seen] / beam[top]
    a = np.stack([dy[seen] ** 2, 2 * dy[seen] * dx[seen], dx[seen] ** 2], 1) * v[:, None]
    yy, xy, xx = np.linalg.lstsq(a, -2 * np.log(v) * v, rcond=None)[0]
    values, vectors = np.linalg.eigh(np.array([[yy, xy], [xy, xx]]))
    widths = 1 / np.sqrt(np.maximum(values, 1e-30))
    return Beam(float(widths[0]), float(widths[1]), math.degrees(math.atan2(vectors[1, 0], vectors[0, 0])) % 180)


def restore(model: np.ndarray, residual: np.ndarray, beam: Beam, step: float) -> np.ndarray:
    """The model seen through a beam of unit peak, plus what is left."""
    n = len(model)
    y, x = (np.mgrid[0 : 2 * n, 0 : 2 * n] - n) * step
    t = math.radians(beam.angle)
    along, across = y * math.cos(t) + x * math.sin(t), x * math.cos(t) - y * math.sin(t)
    lobe = np.exp(-0.5 * ((along / beam.major) ** 2 + (across / beam.minor) ** 2))
    return Response(lobe).to(model) + residual


class Response:
    """What a point looks like, on lags of twice an image's side (zero in the middle); transformed once for any number of images."""

    def __init__(self, lags: np.ndarray):
        self.shape = lags.shape
        self.spectrum = np.fft.rfft2(np.roll(lags, [-(s // 2) for s in lags.shape], (0, 1)))

    def to(self, image: np.ndarray) -> np.ndarray:
        """Every pixel replaced by the response to it, summed; transforms pad the image, so nothing wraps round."""
        whole = np.fft.irfft2(np.fft.rfft2(image, self.shape) * self.spectrum, self.shape)
        return whole[tuple(slice(s) for s in image.shape)]


def planes(spark: SparkSession, arrays: dict[str, np.ndarray], plane: int = 0) -> DataFrame:
    """(plane, kind, pix_y, pix_x, value) of images; NaN becomes null."""
    rows = [(plane, kind, int(y), int(x), None if math.isnan(v) else float(v)) for kind, a in arrays.items() for (y, x), v in np.ndenumerate(a)]
    return spark.createDataFrame(rows, "plane int, kind string, pix_y int, pix_x int, value double")


#: Cards that say where an image lies.
PLACING = ("CTYPE1", "CTYPE2", "CRVAL1", "CRVAL2", "CRPIX1", "CRPIX2", "CDELT1", "CDELT2", "CROTA2", "EQUINOX", "RADESYS")


def grid_of(header: dict) -> dict[str, object]:
    """The cards of a header that say where its planes lie."""
    return {k: header[k] for k in PLACING if k in header}


def product_cards(n: int, step_arcsec: float, centre: tuple[float, float] | None = None, moved: tuple[float, float] = (0.0, 0.0), unit: str = "", beam: Beam | None = None, hz: Sequence[float] = (), rest_hz: float | None = None) -> dict[str, object]:
    """Cards of a product on the image grid: where it lies, its unit, its beam and its frequencies.

    ``centre`` is the pointing in degrees, ``moved`` the offset in arcseconds (x to the west) by which the data were recentred: the reference then lies
    there, in right ascension by the offset over the cosine of the declination. An uneven axis of frequencies gets a card for each plane.
    """
    at = Grid(*(centre or (0.0, 0.0)), (n - 1) / 2, (n - 1) / 2, -step_arcsec / 3600, step_arcsec / 3600, n, n)
    cards = (at.shifted(*moved) if any(moved) else at).cards()
    if centre is not None:
        cards |= {"RADESYS": "ICRS"}
    if unit:
        cards["BUNIT"] = unit
    if beam is not None:
        fwhm = 2 * math.sqrt(2 * math.log(2)) / 3600
        cards |= {"BMAJ": beam.major * fwhm, "BMIN": beam.minor * fwhm, "BPA": beam.angle}
    if len(hz):
        steps = np.diff(hz)
        cards |= {"CTYPE3": "FREQ", "CUNIT3": "Hz", "CRPIX3": 1.0, "CRVAL3": float(hz[0]), "CDELT3": float(steps[0]) if len(steps) else 1.0}
        if len(steps) > 1 and np.ptp(steps) > 1e-6 * np.abs(steps).max():
            cards |= {f"FREQ{k + 1:04d}": float(f) for k, f in enumerate(hz)}
    if rest_hz:
        cards["RESTFRQ"] = float(rest_hz)
    return cards


def median_beam(beams: Sequence[Beam]) -> Beam:
    """The beam of middle area, for planes that share one header."""
    return sorted(beams, key=lambda b: (b.major * b.minor, b.major))[len(beams) // 2]


def with_points(image: DataFrame, points: DataFrame, step: float, n: int) -> DataFrame:
    """(pix_y, pix_x, value) with each point's flux added to its nearest pixel."""
    at = points.select(F.rint((n - 1) / 2 - F.col("y_as") / step).cast("int").alias("pix_y"), F.rint(F.col("x_as") / step + (n - 1) / 2).cast("int").alias("pix_x"), F.col("flux").alias("value"))
    return image.select("pix_y", "pix_x", "value").unionByName(at).groupBy("pix_y", "pix_x").agg(F.sum("value").alias("value"))


def terms_key(source: str, **choices: object) -> str:
    """Identity of cached terms: what was read and every choice that shapes them."""
    return hashlib.sha256(json.dumps([source, choices], sort_keys=True, default=str).encode()).hexdigest()


def content_identity(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row (n, content): what ``rows`` hold in ``columns``, whatever their order and partitioning.

    A row is the first 60 bits of the MD5 of its values, nulls marked, lengths in front; the sum over all rows, kept whole, is the content. Only sums move.
    """
    values = [F.coalesce(F.concat(F.length(s := F.col(f"`{c}`").cast("string")).cast("string"), F.lit(":"), s), F.lit("-")) for c in columns]
    mark = F.conv(F.substring(F.md5(F.concat_ws("|", *values).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum(mark).cast("string").alias("content"))


def source_identity(source: str | DataFrame) -> str:
    """A name for what a cache was made from: of files, where they are, their sizes and times, without a pass over them; of a table, its content."""
    if isinstance(source, DataFrame):
        row = content_identity(source, sorted(source.columns)).first()
        return f"table:{row['n']}:{row['content']}"
    files, root = place(source)
    found = files.get_file_info(root)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(source)
    listed = [found] if found.type == fs.FileType.File else [i for i in files.get_file_info(fs.FileSelector(root, recursive=True)) if i.type == fs.FileType.File and not i.base_name.startswith(".")]
    parts = sorted(f"{i.path}:{i.size}:{i.mtime_ns}" for i in listed)
    return f"files:{len(parts)}:{hashlib.sha256('|'.join(parts).encode()).hexdigest()[:32]}"


def cached_terms(spark: SparkSession, folder: str, key: str, build: Callable[[], Terms], renew: bool = False) -> Terms:
    """Terms from the cache, or built and put there. A cache that is damaged, of another key or of another shape never stops a run: it is built anew,
    and one that can't be written costs a warning."""
    found = None if renew else load_terms(spark, folder, key)
    if found is not None:
        return found
    made = build()
    try:
        save_terms(spark, made, folder, key)
    except Exception as e:  # noqa: BLE001  a full disk or a store without leave to write: the terms are there all the same
        logger.warning("terms %s are not cached: %s", key, e)
    return made


def save_terms(spark: SparkSession, terms: Terms, folder: str, key: str) -> None:
    row = (key, len(terms.dirty), terms.kernel.reshape(-1).tolist(), terms.dirty.reshape(-1).tolist(), int(terms.n_vis), float(terms.sum_w), float(terms.data_term), float(terms.noise_norm))
    made = spark.createDataFrame([row], "key string, n int, kernel array<double>, dirty array<double>, n_vis long, sum_w double, data_term double, noise_norm double")
    made.write.mode("overwrite").parquet(f"{folder}/{key}")


def load_terms(spark: SparkSession, folder: str, key: str) -> Terms | None:
    """Cached terms, or none where there are none of this key or they can't be used."""
    files, p = place(f"{folder}/{key}")
    if files.get_file_info(p).type == fs.FileType.NotFound:
        return None
    try:
        r = spark.read.parquet(f"{folder}/{key}").where(F.col("key") == key).first()
        if r is None:
            return None
        return Terms(np.array(r.kernel).reshape(2 * r.n, 2 * r.n), np.array(r.dirty).reshape(r.n, r.n), r.n_vis, r.sum_w, r.data_term, r.noise_norm)
    except Exception as e:  # noqa: BLE001  whatever is wrong with a cache, it is built again
        logger.warning("cached terms %s can't be read and are built again: %s", key, str(e).splitlines()[0])
        return None


def run_record(**resolved: object) -> str:
    """What ran, as JSON."""
    return json.dumps(resolved, sort_keys=True, default=str)
