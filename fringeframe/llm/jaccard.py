"""Near copies by Jaccard similarity of word shingles: SimHash fingerprints and MinHash bands propose groups, whole shingle sets confirm links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import attach, cut, free_name
from fringeframe.llm.components import connected_components
from fringeframe.llm.simhash import FOLD, link_fingerprints

#: Links are pairs of at least 4/5, counted in whole numbers.
LEAST = (4, 5)
#: A pair of similarity s shares a band with probability 1 - (1 - s^ROWS)^BANDS: 0.99985 at 0.8.
BANDS, ROWS = 48, 8
#: Texts and shingles of a part of a hot group; a task compares two parts.
PART_ROWS, PART_SHINGLES = 2048, 1 << 20

_draw = np.random.default_rng(42)
FACTORS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1)
SHIFTS = _draw.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)
MIXERS = _draw.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)
SALTS = _draw.integers(0, 1 << 64, BANDS, dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted set of the XXH64 of a whole text's shingles; a shorter text is one shingle, no word gives none."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(line[s:e], 42) for s, e in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64))


def keys(own: np.ndarray) -> np.ndarray:
    """A long for each band of MinHashes of a set; an empty set has none."""
    if not len(own):
        return np.empty(0, np.int64)
    low = (own ^ (own >> np.uint64(32))).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(least, (low[None, at : at + 1024] * FACTORS + SHIFTS).min(axis=1), out=least)
    return ((least.reshape(BANDS, ROWS).astype(np.uint64) * MIXERS).sum(axis=1) + SALTS).view(np.int64)


def majority(own: np.ndarray) -> int:
    """64 bits of a set of hashes, as SimHash has them: a bit is 1 if over half of them have it; signed."""
    ones = np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(own), bitorder="little").view("<i8")[0])


def link_sets(sets: list[np.ndarray]) -> np.ndarray:
    """Labels that join sets (none empty) whose similarity is LEAST or more, directly or by way of others.

    From each set the ones not yet reached and of fitting size are counted at once, so a dense group costs one pass.
    """
    part, whole = LEAST
    labels = np.arange(len(sets))
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets = [sets[k] for k in order]
    sizes = np.array([len(s) for s in sets])
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(sizes)[:-1])
    mark = np.zeros(len(values), np.int64)
    live, live_sizes = np.arange(len(sets)), sizes
    while len(live):
        seed, queue = live[0], [live[0]]
        flat, live, live_sizes = flat[live_sizes[0] :], live[1:], live_sizes[1:]
        while queue and len(live):
            p = queue.pop()
            low, high = np.searchsorted(live_sizes * whole, sizes[p] * part, "left"), np.searchsorted(live_sizes * part, sizes[p] * whole, "right")
            if low >= high:
                continue
            edges = np.r_[0, np.cumsum(live_sizes)]
            mark[own[p]] = 1
            both = np.add.reduceat(mark[flat[edges[low] : edges[high]]], edges[low:high] - edges[low])
            mark[own[p]] = 0
            hit = np.zeros(len(live), bool)
            hit[low:high] = whole * both >= part * (sizes[p] + live_sizes[low:high] - both)
            if hit.any():
                labels[order[live[hit]]] = order[seed]
                queue += live[hit].tolist()
                flat, live, live_sizes = flat[np.repeat(~hit, live_sizes)], live[~hit], live_sizes[~hit]
    return labels


def bucket_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows sorted by (key, node) become links to the first node of their key."""
    last, pivot = None, None
    for batch in batches:
        key, node = (c.to_numpy() for c in batch.columns)
        if not len(key):
            continue
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        first = node[starts]
        if last is not None and key[0] == last:
            first[0] = pivot
        root = np.repeat(first, np.diff(np.r_[starts, len(key)]))
        last, pivot = key[-1], root[-1]
        linked = root != node
        yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], ["node", "other"])


def unit_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: rows (unit columns, node, shingles) sorted by unit become a star of links for each of its groups."""
    unit, nodes, sets = None, [], []

    def solve() -> pa.RecordBatch:
        node = np.array(nodes, np.int64)
        root = node[link_sets(sets)]
        linked = root != node
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], ["node", "other"])

    for batch in batches:
        group, part_a, part_b, node, own = batch.columns
        for row, (g, a, b, k) in enumerate(zip(group.to_pylist(), part_a.to_pylist(), part_b.to_pylist(), node.to_pylist(), strict=True)):
            if unit != (g, a, b):
                if len(nodes) > 1:
                    yield solve()
                unit, nodes, sets = (g, a, b), [], []
            nodes.append(k)
            sets.append(np.frombuffer(own[row].as_py(), np.uint64))
    if len(nodes) > 1:
        yield solve()


def sketch(df: DataFrame, text: str, width: int) -> DataFrame:
    """(words, node, print, keys) beside the columns of ``df``: a hash of the text, one of its shingle set, its fingerprint and bands."""
    kind = T.StructType([T.StructField("node", T.LongType()), T.StructField("print", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingles(v.as_py(), width) for v in batch]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 7) for s in sets], np.uint64).view(np.int64)
            own = [keys(s) for s in sets]
            bands = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(k) for k in own])].astype(np.int32)), pa.array(np.concatenate([np.empty(0, np.int64), *own])))
            prints = pa.array([majority(s) for s in sets], pa.int64())
            yield pa.StructArray.from_arrays([pa.array(node), prints, bands], ["node", "print", "keys"])

    found = df.withColumn("sketch__", F.arrow_udf(run, kind, F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`")))
    return found.select(*(f"`{c}`" for c in df.columns), F.xxhash64(F.col(f"`{text}`")).alias("words"), "sketch__.node", "sketch__.print", "sketch__.keys")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, component) of the nodes that share a band with others or lie within 4 bits of them, directly or by way of others."""
    prints = cut(nodes.where(F.size("keys") > 0).groupBy("print").agg(F.min("node").alias("first")))
    same = nodes.where(F.size("keys") > 0).join(prints, "print").where("node <> first").select("node", F.col("first").alias("other"))
    near = link_fingerprints(prints, "first", "print").unionByName(same)
    keyed = nodes.select(F.explode("keys").alias("key"), "node").repartition("key").sortWithinPartitions("key", "node")
    return connected_components(keyed.mapInArrow(bucket_stars, "node long, other long").unionByName(near), "node", "other")


def confirmed(texts: DataFrame, width: int) -> DataFrame:
    """Links (node, other) that connect all pairs of LEAST or more within each group of ``texts`` (node, group, text).

    A group too large for a task is compared by pairs of its parts.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([shingles(v.as_py(), width).tobytes() for v in batch], pa.binary())

    sets = cut(texts.select("node", "group", F.arrow_udf(run, T.BinaryType(), F.ArrowUDFType.SCALAR_ITER)(F.col("text")).alias("set")))
    need = F.greatest(F.ceil(F.count(F.lit(1)) / PART_ROWS), F.ceil(F.sum(F.length("set")) / (8 * PART_SHINGLES)))
    hot = cut(sets.groupBy("group").agg(need.cast("int").alias("parts")).where("parts > 1"))
    dealt = sets.join(hot, "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(17)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    unit = ["group", "part_a", "part_b"]
    units = dealt.select("group", F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"), "node", "set")
    return units.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(unit_links, "node long, other long")


def classes(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """(doc, words, component), one row for each row of ``df``: its key, a hash of its text, and its group of near copies.

    Texts of equal shingle sets are one node from the start; texts without a word are copies of each other.
    """
    plain = df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.col(f"`{text}`").alias("text"))
    known = cut(sketch(plain, "text", width).select("doc", "words", "node", "print", "keys"))
    nodes = cut(known.groupBy("node").agg(F.first("keys").alias("keys"), F.first("print").alias("print"), F.min("words").alias("words")))
    groups = cut(nodes.join(candidates(nodes), "node").select("node", "words", F.col("component").alias("group")))
    texts = plain.select(F.xxhash64("text").alias("words"), "text").join(groups, "words").groupBy("node", "group").agg(F.first("text").alias("text"))
    found = cut(connected_components(confirmed(texts, width), "node", "other"))
    return known.select("doc", "words", "node").join(found, "node", "left").select("doc", "words", F.coalesce("component", "node").alias("component"))


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """``df`` with component_id: the smallest key that links of similarity LEAST or more reach.

    Rows without a key keep a null component of their own; rows that repeat a key share its component. Keys are
    whole numbers. Texts without a word, null ones too, are copies of each other; very long texts are compared by whole sets; an empty table gives
    an empty result; result columns replace inputs of their name, other columns of any name and type pass.
    """
    name, own = free_name(df, "component__"), free_name(df, "doc__")
    known = cut(classes(df, text, key, width).where("doc is not null"))
    least = known.groupBy("component").agg(F.min("doc").alias(name))
    one = known.join(least, "component").groupBy(F.col("doc").alias(own)).agg(F.min(name).alias(name))
    joined = df.join(one, F.col(f"`{key}`").cast("long") == F.col(own), "left")
    return attach(joined, {"component_id": F.col(name)}).drop(own, name)


def holds_map(kind: T.DataType) -> bool:
    """Whether values of a type can hold a map (or a variant), which can be neither hashed nor ordered."""
    if isinstance(kind, T.StructType):
        return any(holds_map(f.dataType) for f in kind.fields)
    return holds_map(kind.elementType) if isinstance(kind, T.ArrayType) else isinstance(kind, (T.MapType, T.VariantType))


def survivors(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5) -> DataFrame:
    """One row of ``df`` for each group of near copies: that of the smallest key, then of the smallest hash of its text.

    Groups are of texts, so a key that repeats with other texts neither joins groups nor loses one. Rows without a key
    come after those with one. Rows of equal key and text are folded to one before they are dealt: that of the smallest hash of its columns,
    but for those that hold maps, which have no order. Texts without a word, null ones too, are one group; very long texts are compared by whole sets; an
    empty table gives an empty result; columns of any name pass.
    """
    doc, row = F.col(f"`{key}`").cast("long"), F.struct(*(f"`{c}`" for c in df.columns))
    name = ("absent", "doc", "words")
    first = F.min(F.struct(F.col("doc").isNull().alias("absent"), F.coalesce("doc", F.lit(0)).alias("doc"), "words")).alias("first")
    kept = cut(classes(df, text, key, width).groupBy("component").agg(first).select("first.*"))
    rows = df.select(doc.isNull().alias("absent"), F.coalesce(doc, F.lit(0)).alias("doc"), F.xxhash64(F.col(f"`{text}`")).alias("words"), row.alias("row"))
    ordered = F.xxhash64(F.lit(0), *(F.col("row").getField(f.name) for f in df.schema.fields if not holds_map(f.dataType)))
    return rows.groupBy(*name).agg(F.min_by("row", ordered).alias("row")).join(kept, list(name)).select("row.*")
