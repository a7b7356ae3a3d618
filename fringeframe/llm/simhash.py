"""SimHash near-dedup: fingerprints of word shingles, compared as bit planes with carry-save counters."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fringeframe.llm.common import attach, cut, free_name, split_hot
from fringeframe.llm.components import connected_components

#: Part of a hot bucket that one task compares with another part.
PART_ROWS = 2048
#: (query, word of 64 lanes) pairs that are compared at a time.
LANES = 1 << 18
SPACES = bytes(range(9, 14)) + b" "
#: A-Z to a-z, white space to the space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else 32 if c in SPACES else c for c in range(256))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """64 bits of a whole text: a bit is 1 if over half of the shingles' XXH64 have it; no word gives 0."""
    words = (text or "").encode("utf-8", "replace").translate(FOLD).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line))
    starts = np.concatenate([[0], ends[:-1] + 1])
    hashed, n = xxhash.xxh64_intdigest, len(words) - width + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        stop = min(n, at + (1 << 16))
        own = np.array([hashed(line[s:e], seed) for s, e in zip(starts[at:stop].tolist(), ends[at + width - 1 : stop + width - 1].tolist(), strict=True)], np.uint64)
        ones += np.unpackbits(own.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > n).tolist())


def bands(rows: int, radius: int, bucket: int = 64) -> tuple[int, int]:
    """(blocks, kept): the 64 bits fall into blocks, and fingerprints within ``radius`` agree on ``kept`` of them.

    blocks - radius are always clean; more blocks make longer keys. The fewest are taken with which ``rows`` even
    fingerprints leave at most about ``bucket`` in a bucket; the answer is exact for any choice.
    """
    for kept in (1, 2, 3):
        blocks = radius + kept
        if rows <= bucket << (64 * kept // blocks) or kept == 3:
            return blocks, kept


def tables(blocks: int, kept: int) -> list[int]:
    """One mask for each choice of ``kept`` blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    return [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in chosen) for chosen in combinations(range(blocks), kept)]


def planes_of(prints: np.ndarray, word: np.ndarray, lane: np.ndarray, words: int) -> np.ndarray:
    """Bit planes: entry (w, k) holds bit k of the 64 fingerprints of word w, one in each lane."""
    out = np.zeros((words, 64), np.uint64)
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.uint64)
    bits <<= lane.astype(np.uint64)[:, None]
    starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    out[word[starts]] = np.bitwise_or.reduceat(bits, starts, axis=0)
    return out


def near(planes: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, lanes): which lanes of word[i] lie within ``radius`` of fingerprint query[i], where any do.

    Each plane adds its mismatches to 64 counters at once (three carry-save bits and a sticky overflow). Entries
    all of whose lanes exceed the radius are dropped on the way.
    """
    entry = np.arange(len(query))
    ones = twos = fours = np.zeros(len(query), np.uint64)
    over = ~valid
    for k in range(64):
        x = planes[word, k] ^ (np.uint64(0) - ((query >> np.uint64(k)) & np.uint64(1)))
        carry = ones & x
        ones = ones ^ x
        x, twos = twos & carry, twos ^ carry
        carry, fours = fours & x, fours ^ x
        over = over | carry
        if k >= radius and (k % 4 == 3 or k == 63):
            out = over | beyond(ones, twos, fours, radius)
            live = out != FULL
            if not live.all():
                entry, query, word, ones, twos, fours, over = (a[live] for a in (entry, query, word, ones, twos, fours, over))
                if not len(entry):
                    break
    return entry, ~(over | beyond(ones, twos, fours, radius))


def beyond(ones: np.ndarray, twos: np.ndarray, fours: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is greater than ``radius`` (0 to 7)."""
    more, same = np.zeros_like(ones), np.full_like(ones, FULL)
    for plane, bit in ((fours, 4), (twos, 2), (ones, 1)):
        if radius & bit:
            same = same & plane
        else:
            more, same = more | (same & plane), same & ~plane
    return more


def join_labels(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Make labels[a] and labels[b] equal, in place: hook the larger root to the smaller, then jump."""
    while True:
        la, lb = labels[a], labels[b]
        apart = la != lb
        if not apart.any():
            return
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(labels, np.maximum(la, lb), np.minimum(la, lb))
        while not np.array_equal(jumped := labels[labels], labels):
            labels[:] = jumped


def link_units(unit: np.ndarray, own: np.ndarray, prints: np.ndarray, radius: int) -> np.ndarray:
    """Labels that join rows of one unit within ``radius``. unit: ascending group number of each row.

    In a unit of two parts the pairs inside a part are left to that part's own unit.
    """
    n = len(unit)
    labels = np.arange(n)
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(n) - starts[group]
    word, lane = first_word[group] + place // 64, place % 64
    total = int(words.sum())
    planes = planes_of(prints, word, lane, total)
    valid = np.zeros(total, np.uint64)
    heads = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    valid[word[heads]] = np.bitwise_or.reduceat(np.uint64(1) << lane.astype(np.uint64), heads)
    mixed = (np.maximum.reduceat(own, starts) != np.minimum.reduceat(own, starts))[group]
    base = starts[np.repeat(np.arange(len(starts)), words)] + 64 * (np.arange(total) - np.repeat(first_word, words))
    # A query meets its own word and those after it: each unordered pair once.
    todo = words[group] - place // 64
    ends = np.cumsum(todo)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, "right")))
        counts = todo[at:stop]
        row = np.repeat(np.arange(at, stop), counts)
        target = word[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts))
        entry, lanes = near(planes, prints[row], target, valid[target], radius)
        if len(entry):
            hit, bit = np.nonzero(np.unpackbits(lanes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            a, b = row[entry[hit]], base[target[entry[hit]]] + bit
            both = (b > a) & (~mixed[a] | (own[a] != own[b]))
            join_labels(labels, a[both], b[both])
        at = stop
    return labels


def unit_links(radius: int):
    """A function for mapInArrow: rows sorted by unit become links (node, other) to a smaller node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def solve(cols: list[np.ndarray]) -> pa.RecordBatch:
            table, key, part_a, part_b, own, node, prints = cols
            change = (np.diff(table) != 0) | (np.diff(key) != 0) | (np.diff(part_a) != 0) | (np.diff(part_b) != 0)
            unit = np.r_[0, np.cumsum(change)]
            labels = link_units(unit, own, prints.view(np.uint64), radius)
            least = np.full(len(unit), np.iinfo(np.int64).max)
            np.minimum.at(least, labels, node)
            root = least[labels]
            linked = root != node
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(root[linked])], ["node", "other"])

        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            last = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0) | (np.diff(cols[3]) != 0))
            end = int(last[-1]) + 1 if len(last) else 0
            held = [c[end:] for c in cols]
            if end:
                yield solve([c[:end] for c in cols])
        if held and len(held[0]):
            yield solve(held)

    return run


def link_fingerprints(prints: DataFrame, node: str, fingerprint: str, radius: int = 4) -> DataFrame:
    """Links (node, other) that connect all fingerprints within ``radius`` bits; ``prints`` has one row per fingerprint.

    Rows meet in the buckets of a few masked keys, hot buckets in pairs of parts. A unit's links are a star for each of
    its groups, so a dense group costs one row per member and no connection is lost.
    """
    blocks, kept = bands(prints.count(), radius)
    masks = [m - (1 << 64) if m >> 63 else m for m in tables(blocks, kept)]
    keyed = prints.select(F.col(node).alias("node"), F.col(fingerprint).alias("print"), F.posexplode(F.array(*(F.lit(m) for m in masks))).alias("band", "mask"))
    keyed = keyed.select("band", F.col("print").bitwiseAND(F.col("mask")).alias("key"), "node", "print")
    units = split_hot(keyed, ["band", "key"], "print", PART_ROWS)
    columns = ["band", "key", "part_a", "part_b"]
    sorted_units = units.select(*columns, "own", "node", "print").repartition(*columns).sortWithinPartitions(*columns)
    return sorted_units.mapInArrow(unit_links(radius), "node long, other long")


def printed(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """(doc, print) of every row, written down: its key and the 64 bits of its text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([fingerprint(v.as_py(), width) for v in batch], np.uint64).view(np.int64))

    return cut(df.select(F.col(f"`{key}`").cast("long").alias("doc"), F.arrow_udf(run, T.LongType(), F.ArrowUDFType.SCALAR_ITER)(F.col(f"`{text}`")).alias("print")))


def dedup(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """``df`` with simhash (long, the 64 bits) and component_id: the smallest key that links of ``radius`` bits reach.

    Equal fingerprints are one node from the start, so copies are never compared. Null and wordless texts have
    fingerprint 0 and are linked like any other. Rows without a key keep a null component of their own; rows that
    repeat a key share its component. Keys are whole numbers. Very long texts are hashed whole, a run of shingles at a time. Result
    columns replace inputs of their name; an empty table gives an empty result.
    """
    bits, doc, group = (free_name(df, n) for n in ("simhash__", "simhash_doc__", "component__"))
    known = printed(df, text, key, width).where("doc is not null")
    groups = classes(known, radius)
    reached = known.join(groups, "print").select(F.col("doc").alias(doc), F.col("print").alias(bits), F.col("component").alias(group))
    # A key whose rows differ in text ties their groups together only by name: the smallest component stands.
    one = cut(reached.groupBy(doc).agg(F.min_by(bits, F.struct(group, bits)).alias(bits), F.min(group).alias(group)))
    joined = df.join(one, F.col(f"`{key}`").cast("long") == F.col(doc), "left")
    return attach(joined, {"simhash": F.col(bits), "component_id": F.col(group)}).drop(doc, bits, group)


def classes(known: DataFrame, radius: int = 4) -> DataFrame:
    """(print, component) for the fingerprints of ``known`` (doc, print)."""
    prints = cut(known.groupBy("print").agg(F.min("doc").alias("node")))
    found = connected_components(link_fingerprints(prints, "node", "print", radius), "node", "other")
    return cut(prints.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component")))


def digests(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 4, radius: int = 4) -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id), one row for each row of ``df``, by its own text.

    Rows without a key have a fingerprint and a null component, and tie nothing together; rows that repeat a key with
    other texts have the fingerprint and the component of their text each. Null, empty and wordless texts have fingerprint 0 and are
    linked like others; very long texts are hashed whole; no other column is read, so none clashes; an empty table gives no row.
    """
    known = printed(df, text, key, width)
    groups = classes(known.where("doc is not null"), radius)
    component = F.when(F.col("doc").isNotNull(), F.col("component"))
    return known.join(groups, "print", "left").select(F.col("doc").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id"))
