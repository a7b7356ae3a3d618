"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import attach, cut

#: n-gram lengths in characters and the number of hash buckets they share.
ORDERS, BUCKETS = (3, 4, 5, 6), 1 << 18
#: Labelled rows that a fit sees at most: a bounded sample, the rows of smallest hash.
SAMPLE_ROWS = 6000
#: Characters of text whose n-grams are taken at a time.
WINDOW = 1 << 20


def features(text: str | None) -> np.ndarray:
    """Sorted distinct bucket numbers of a whole text's n-grams of characters (lower case, a space at either end)."""
    a = np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)
    seen = np.zeros(BUCKETS, bool)
    for start in range(0, len(a), WINDOW):
        part = a[start : start + WINDOW + max(ORDERS) - 1]
        h = np.full(len(part), 0x811C9DC5, np.uint32)
        for n in range(1, max(ORDERS) + 1):
            if n > len(part):
                break
            h = (h[: len(part) - n + 1] ^ part[n - 1 :]) * np.uint32(0x01000193)
            if n in ORDERS:
                seen[((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(14)] = True
    return np.flatnonzero(seen)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        z = float(self.weights[features(text)].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def train(rows: Callable[[], Iterable[tuple[int, np.ndarray]]], strength: float = 6.0, smooth: float = 1.0, surprise: float = 3.0, steps: int = 200, rare: float = 3.0) -> Model:
    """Fit on (label, bucket numbers) rows, which ``rows`` gives twice: to count, then to keep the cells of used buckets.

    Buckets are used whose share differs between the labels by ``surprise`` standard errors; a toxic row weighs
    ``rare`` times. With one label only, or none at all, the model answers that label's share for every text.
    """
    counts, n = np.zeros((2, BUCKETS)), np.zeros(2)
    for label, own in rows():
        counts[label, own] += 1
        n[label] += 1
    if not n.all():
        share = float(np.clip(n[1] / n.sum() if n.any() else 0.0, 0.01, 0.99))
        return Model(np.zeros(BUCKETS), float(np.log(share / (1 - share))))
    ratio = np.log((counts[1] + smooth) / (n[1] + 2 * smooth)) - np.log((counts[0] + smooth) / (n[0] + 2 * smooth))
    pool = counts.sum(0) / n.sum()
    error = np.sqrt(np.maximum(pool * (1 - pool), 1e-12) * (1 / n).sum())
    used = np.flatnonzero(np.abs(counts[1] / n[1] - counts[0] / n[0]) >= surprise * error)
    place = np.full(BUCKETS, -1, np.int32)
    place[used] = np.arange(len(used))
    cells, labels = [], []
    for label, own in rows():
        c = place[own]
        cells.append(c[c >= 0])
        labels.append(label)
    y = np.array(labels, float)
    row, column = np.repeat(np.arange(len(cells), dtype=np.int32), [len(c) for c in cells]), np.concatenate(cells)
    value = ratio[used].astype(np.float32)[column]
    w, bias, weight = np.zeros(len(used)), float(np.log(rare * n[1] / n[0])), np.where(y == 1, rare, 1.0)
    mean, square, rate = np.zeros(len(used) + 1), np.zeros(len(used) + 1), 0.05
    for k in range(1, steps + 1):
        z = np.bincount(row, value * w[column], minlength=len(y)) + bias
        off = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * weight
        slope = np.append(np.bincount(column, value * off[row], minlength=len(used)) + strength * w, off.sum())
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        step = rate * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
        w, bias = w - step[:-1], bias - float(step[-1])
    weights = np.zeros(BUCKETS)
    weights[used] = ratio[used] * w
    return Model(weights, bias)


def fit(documents: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", rows: int = SAMPLE_ROWS, held_out: int = 5) -> Model:
    """Fit on labelled documents whose crc32(key) mod ``held_out`` is not 0.

    The sample is bounded: ``rows`` labels of smallest hash, broadcast to the documents, one text for each. A text
    goes to the driver as the bucket numbers of the whole of it (packed as bits where that is smaller), a partition
    at a time, and only cells of used buckets are kept there. Null keys, texts and labels are not learnt from.
    """
    chosen = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    chosen = chosen.where(F.crc32(F.col("k").cast("string")) % held_out != 0).orderBy(F.xxhash64("k"), "k", "y").limit(rows)
    joined = documents.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t is not null").join(F.broadcast(chosen), "k")

    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = []
            for v in batch:
                own = features(v.as_py())
                bits = np.zeros(BUCKETS, bool)
                bits[own] = True
                out.append(b"i" + own.astype(np.uint32).tobytes() if len(own) * 4 < BUCKETS // 8 else b"b" + np.packbits(bits).tobytes())
            yield pa.array(out, pa.binary())

    packed = joined.select("k", "y", F.arrow_udf(pack, T.BinaryType(), F.ArrowUDFType.SCALAR_ITER)("t").alias("f"))
    packed = cut(packed.groupBy("k", "y").agg(F.min("f").alias("f")).select("y", "f"))

    def stream() -> Iterator[tuple[int, np.ndarray]]:
        for r in packed.toLocalIterator():
            raw = bytes(r.f)
            yield r.y, np.frombuffer(raw[1:], np.uint32) if raw[:1] == b"i" else np.flatnonzero(np.unpackbits(np.frombuffer(raw[1:], np.uint8)))

    return train(stream)


def score(df: DataFrame, model: Model, text: str = "text", key: str = "doc_id", held_out: int = 5, threshold: float = 0.5) -> DataFrame:
    """``df`` with held_out, score (0 to 1, higher: likelier toxic) and predicted (score >= ``threshold``).

    Nothing but the text enters the score; null and empty texts get the score of a text without n-grams. Each row is
    scored alone, so repeated rows agree; very long texts are scored whole, a window of characters at a time; rows without a key are
    not held out; an empty table gives an empty result. Result columns replace inputs of their name.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.weights.astype(np.float32), model.bias))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shared.value)
        for batch in batches:
            yield pa.array([own.score(v.as_py()) for v in batch], pa.float64())

    scored = F.arrow_udf(run, T.DoubleType(), F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`"))
    out = attach(df, {"held_out": F.coalesce(F.crc32(F.col(f"`{key}`").cast("string")) % held_out == 0, F.lit(False)), "score": scored})
    return attach(out, {"predicted": (F.col("score") >= threshold).cast("int")})
