"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, one vector of each group stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import cut
from fringeframe.llm.components import connected_components
from fringeframe.llm.simhash import join_labels

#: Vectors that the cells are fitted on (those of smallest hash) and their bytes at most, vectors for each cell, and most cells.
SAMPLE_ROWS, SAMPLE_BYTES, CELL_ROWS, MOST_CELLS = 20_000, 64 << 20, 4096, 4096
#: Share of the exact margin within which a vector joins other cells than its own; 1 loses no pair.
SHARE = 0.27
#: Vectors and bytes of vectors of a part of a hot cell, and rows of a block of products.
PART_ROWS, PART_BYTES, BLOCK = 32_768, 32 << 20, 1024
#: Vectors with copies up to this many are named in a broadcast; beyond it copies meet in a shuffle.
BROADCAST_ROWS = 1_000_000


def usable_rows(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) of the vectors of each length; null, empty, zero vectors and those with null or non-finite components are left out."""
    offsets = np.asarray(lists.offsets)
    size = np.where(np.asarray(lists.is_valid()), np.diff(offsets), 0)
    values = lists.values.to_numpy(zero_copy_only=False)
    for width in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == width)
        m = values[offsets[rows][:, None] + np.arange(width)]
        good = np.isfinite(m).all(axis=1) & (m != 0).any(axis=1)
        if good.any():
            yield rows[good], m[good]


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; no square over- or underflows."""
    m = m.astype(np.float64)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Unit centres: means of the nearest rows by cosine, put back on the sphere; an empty cell takes a random row."""
    draw = np.random.default_rng(seed)
    centres = sample[draw.permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        own = np.concatenate([(sample[a : a + 4096] @ centres.T).argmax(axis=1) for a in range(0, len(sample), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(axis=1))
        empty = norm == 0
        sums[empty] = sample[draw.integers(0, len(sample), int(empty.sum()))]
        norm[empty] = 1.0
        centres = sums / norm[:, None]
    return centres


def cells_of(units: np.ndarray, centres: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(cells, their number for each row): a row's own cell first, then those whose border it lies within ``margin`` of.

    The border of two cells is the plane between their centres. Vectors at angle t are at most 2 sin(t / 2) apart, so
    where a border parts them one of them lies within sin(t / 2) of it: with that margin every such pair meets in the
    own cell of one of them.
    """
    cosine = units @ centres.T
    own = cosine.argmax(axis=1)
    best = cosine[np.arange(len(units)), own]
    gap = np.sqrt(np.maximum(2 - 2 * (centres[own] @ centres.T), 1e-12))
    inside = best[:, None] - cosine <= margin * gap + 1e-12
    inside[np.arange(len(units)), own] = False
    counts = 1 + inside.sum(axis=1)
    out = np.empty(int(counts.sum()), np.int32)
    first = np.cumsum(counts) - counts
    rest = np.ones(len(out), bool)
    rest[first] = False
    out[first], out[rest] = own, np.nonzero(inside)[1]
    return out, counts


def link_unit(cell: int, own: np.ndarray, node: np.ndarray, weight: np.ndarray, cells: np.ndarray, counts: np.ndarray, m: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Link counts (kind 0: node, number) and stars of linked groups (kind 1: node, smaller node) of one unit.

    Pairs have a vector whose own cell this is. A pair that also meets in the other one's own cell counts in the smaller
    cell. In a unit of two parts the pairs inside a part are left to that part's own unit. Products run in single
    precision; those too near the threshold to tell are taken again in double.
    """
    n = len(node)
    home = cells[np.cumsum(counts) - counts]
    units = unit_rows(m)
    single = units.astype(np.float32)
    slack = 2.0 * (m.shape[1] + 8) * 2.0**-24
    most = int(cells.max()) + 1
    joined = np.sort(np.repeat(np.arange(n, dtype=np.int64), counts) * most + cells)
    labels, degree = np.arange(n), np.zeros(n, np.int64)
    mixed = own.max() != own.min()
    ours = int((home == cell).sum())  # rows come with these first
    for a in range(0, ours, BLOCK):
        some = single[a : min(a + BLOCK, ours)]
        for b in range(a, n, BLOCK):
            product = some @ single[b : b + BLOCK].T
            i, j = np.nonzero(product >= threshold - slack)
            near = np.abs(product[i, j] - threshold) <= slack
            i, j = i + a, j + b
            right = (j > i) & ~near
            for s in range(0, int(near.sum()), 1 << 16):
                k = np.flatnonzero(near)[s : s + (1 << 16)]
                right[k] = (j[k] > i[k]) & ((units[i[k]] * units[j[k]]).sum(axis=1) >= threshold)
            if mixed:
                right &= own[i] != own[j]
            i, j = i[right], j[right]
            other = home[j]
            key = i * most + other
            met = joined[np.minimum(np.searchsorted(joined, key), len(joined) - 1)] == key
            counted = (other == cell) | ~met | (cell < other)
            i, j = i[counted], j[counted]
            degree += np.bincount(i, weight[j], n).astype(np.int64) + np.bincount(j, weight[i], n).astype(np.int64)
            join_labels(labels, i, j)
    least = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, labels, node)
    root = least[labels]
    some, linked = degree > 0, root != node
    kind = np.r_[np.zeros(some.sum(), np.int32), np.ones(linked.sum(), np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.r_[node[some], node[linked]]), pa.array(np.r_[degree[some], root[linked]])], ["kind", "node", "value"])


UNIT = ("dim", "cell", "part_a", "part_b")


def compare(batches: Iterator[pa.RecordBatch], kind: np.dtype, threshold: float) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows sorted by unit become the links of each unit."""

    def solve(table: pa.Table) -> pa.RecordBatch:
        get = {n: table.column(n).combine_chunks() for n in table.column_names}
        cell = get["cell"][0].as_py()
        node, first = np.unique(get["node"].to_numpy(), return_index=True)
        lists = get["cells"].take(pa.array(first))
        counts = np.diff(np.asarray(lists.offsets))
        cells = np.asarray(lists.flatten())
        order = np.argsort(cells[np.cumsum(counts) - counts] != cell, kind="stable")
        lists = lists.take(pa.array(order))
        first = first[order]
        vectors = np.frombuffer(b"".join(get["vector"].take(pa.array(first)).to_pylist()), kind).reshape(len(first), -1)
        return link_unit(cell, get["own"].to_numpy()[first], node[order], get["copies"].to_numpy()[first].astype(float), np.asarray(lists.flatten()), counts[order], vectors, threshold)

    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]) if held is not None else table
        marks = [table.column(c).to_numpy() for c in UNIT]
        ends = np.flatnonzero(np.any([np.diff(x) != 0 for x in marks], axis=0)) + 1
        start = 0
        for end in ends.tolist():
            yield solve(table.slice(start, end - start))
            start = end
        held = table.slice(start).combine_chunks()
    if held is not None and held.num_rows:
        yield solve(held)


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, share: float = SHARE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """One row per vector: key, n_links, component_id, kept.

    Cells are fitted on a bounded sample (SAMPLE_ROWS, SAMPLE_BYTES) and every vector joins its own cell and those whose border is
    near: within ``share`` of the margin sin(t / 2) that loses no pair (t: the angle of ``threshold``). With share = 1
    the result is exact; with the default a pair may be missed that a border parts and whose vectors both lie beyond
    it (the README has the measured recall). No pair below the threshold links. Equal vectors are one node, so a common
    vector costs one comparison; nodes are named by 64 bits of a hash. A vector leaves the scan once for each
    of its cells, as it came; cells of more than PART_ROWS vectors (by the sample) are compared by pairs of parts.
    Null, empty, zero vectors and those with a null or non-finite component link with nothing; vectors of different lengths
    don't link; rows without a key are left out; rows that repeat a key count as vectors of their own; other columns
    are not read; an empty table gives an empty result.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("vector")).where("id is not null")
    wide = not isinstance(rows.schema["vector"].dataType, T.ArrayType) or not isinstance(rows.schema["vector"].dataType.elementType, T.FloatType)
    if wide:
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    kind = np.dtype("<f8" if wide else "<f4")

    def name(raw: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little", signed=True)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, dim = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int32)
            for at, m in usable_rows(batch.column(1)):
                node[at], dim[at] = [name(x.tobytes()) for x in m.astype(kind)], m.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, mask=dim == 0), pa.array(dim)], ["id", "node", "dim"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, m in usable_rows(batch.column(1)):
                raw = [x.tobytes() for x in m.astype(kind)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array([name(x) for x in raw], pa.int64()), pa.array(np.full(len(at), m.shape[1], np.int32)), pa.array(raw, pa.binary())], ["id", "node", "dim", "vector"])

    everyone = cut(rows.mapInArrow(named, "id long, node long, dim int"))
    nodes = cut(everyone.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim")))
    n, widest = nodes.agg(F.count(F.lit(1)), F.max("dim")).first()
    if not n:
        return everyone.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    vectors = rows.mapInArrow(packed, "id long, node long, dim int, vector binary")

    bound = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (kind.itemsize * widest)))
    chosen = F.broadcast(nodes.orderBy(F.xxhash64("node"), "node").limit(bound).select("node", F.col("id").alias("first")))
    sample = {r.node: (r.dim, bytes(r.vector)) for r in vectors.join(chosen, "node").where("id = first").select("node", "dim", "vector").toLocalIterator()}
    margin = share * float(np.sqrt(max(0.0, (1 - threshold) / 2)))
    centres: dict[int, np.ndarray] = {}
    sizes: dict[tuple[int, int], int] = {}
    for dim in sorted({d for d, _ in sample.values()}):
        points = unit_rows(np.frombuffer(b"".join(sample[k][1] for k in sorted(sample) if sample[k][0] == dim), kind).reshape(-1, dim))
        centres[dim] = spherical_kmeans(points, max(1, min(len(points), MOST_CELLS, n * len(points) // len(sample) // cell_rows)))
        for at in range(0, len(points), 1024):
            for c, k in zip(*np.unique(cells_of(points[at : at + 1024], centres[dim], margin)[0], return_counts=True), strict=True):
                sizes[dim, int(c)] = sizes.get((dim, int(c)), 0) + int(k)

    def parts(dim: int, seen: int) -> int:
        """Parts of a cell of which ``seen`` vectors are in the sample, by a size that it hardly exceeds."""
        most = min(PART_ROWS, max(1, PART_BYTES // (kind.itemsize * dim)))
        return -(-int((seen + 3 * seen**0.5 + 3) * n / len(sample)) // most) if n > most else 1

    shared = spark.sparkContext.broadcast((centres, {k: parts(k[0], v) for k, v in sizes.items()}))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each cell and pair of parts that a vector joins."""
        fitted, split = shared.value
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                mine = batch.filter(pa.array(dims == dim))
                for at in range(0, mine.num_rows, 1024):
                    some = mine.slice(at, 1024)
                    m = np.frombuffer(b"".join(some.column("vector").to_pylist()), kind).reshape(some.num_rows, dim)
                    if dim in fitted:
                        cells, counts = cells_of(unit_rows(m), fitted[dim], margin)
                    else:
                        cells, counts = np.zeros(some.num_rows, np.int32), np.ones(some.num_rows, np.int64)
                    row = np.repeat(np.arange(some.num_rows), counts)
                    into = np.array([split.get((dim, c), parts(dim, 0)) for c in cells.tolist()])
                    own = (some.column("node").to_numpy()[row].view(np.uint64) >> np.uint64(20)).astype(np.int64) % into
                    deal = np.repeat(np.arange(len(row)), into)
                    other = np.arange(len(deal)) - np.repeat(np.cumsum(into) - into, into)
                    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(cells))
                    at_row = pa.array(row[deal])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(deal), dim, np.int32)), pa.array(cells[deal]), pa.array(np.minimum(own[deal], other)), pa.array(np.maximum(own[deal], other)), pa.array(own[deal])]
                        + [some.column("node").take(at_row), some.column("copies").take(at_row), lists.take(at_row), some.column("vector").take(at_row)],
                        [*UNIT, "own", "node", "copies", "cells", "vector"],
                    )

    twice = nodes.where("copies > 1").select("node", F.col("id").alias("first"), "copies")
    if twice.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        # Units fold rows that repeat key and vector, so one copy or some may stand for a node here.
        once = vectors.join(F.broadcast(twice), "node", "left").where("first is null or id = first").select("node", F.coalesce("copies", F.lit(1).cast("long")).alias("copies"), "dim", "vector")
    else:
        once = vectors.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("vector").alias("vector"))
    dealt = once.mapInArrow(placed, "dim int, cell int, part_a long, part_b long, own long, node long, copies long, cells array<int>, vector binary")
    ordered = dealt.repartition(*UNIT).sortWithinPartitions(*UNIT)
    found = cut(ordered.mapInArrow(lambda it: compare(it, kind, threshold), "kind int, node long, value long"))
    degree = found.where("kind = 0").groupBy("node").agg(F.sum("value").alias("links"))
    groups = cut(connected_components(found.where("kind = 1").select("node", F.col("value").alias("other")), "node", "other"))
    least = nodes.join(groups, "node").groupBy("component").agg(F.min("id").alias("least"))
    named_groups = groups.join(least, "component").select("node", "least")
    labelled = nodes.join(degree, "node", "left").join(named_groups, "node", "left")
    labelled = cut(labelled.select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("least", "id").alias("component")))
    both = everyone.join(labelled, "node", "left")
    component = F.coalesce("component", "id")
    return both.select(F.col("id").alias(key), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
