"""Prefix trie of conversations: nodes named by digests, leaf counts and savings rolled up by pointer jumping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.llm.common import cut

#: Rows of a slab of the order, and the most slabs.
SLAB_ROWS, MOST_SLABS = 200_000, 8192
#: Ids of one chunk of a node's list of ends.
CHUNK_IDS = 256
WORD = r"[^\x20\x09-\x0D]+"
#: A node's name: two numbers of 64 bits that the digests of its turns and their places give.
NODE, PARENT = ("na", "nb"), ("pa", "pb")


def digest(*columns: Column) -> list[Column]:
    """Two numbers of 60 bits from the SHA-256 of strings; lengths in front keep their borders."""
    parts = [x for c in columns for x in (F.octet_length(c).cast("string"), F.lit(":"), c)]
    name = F.sha2(F.concat(*parts), 256)
    return [F.conv(F.substring(name, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(2)]


def turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, turn, role, da, db, words): what the trie needs of each turn, so that no text moves.

    Null roles and texts are empty ones; rows without a conversation belong to none and are left out. Other columns, of any
    name, are not read.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), said[0].alias("role"), said[1].alias("text"))
    names = digest(F.col("role"), F.col("text"))
    return rows.select("conv_id", "turn", "role", names[0].alias("da"), names[1].alias("db"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def along(rows: DataFrame, order: Sequence[str], values: dict[str, Column], xor: bool = False) -> DataFrame:
    """``rows`` with totals of ``values`` over the rows of the same conversation up to and with each one, in ``order``.

    Rows are dealt to slabs of the order of conversation and ``order``, so a conversation that holds a third of all rows is
    many tasks. Only a slab's first and last conversation can go on in others: their totals, two a slab at most, are
    carried over and broadcast. Rows that are equal in all of ``order`` are told apart at random, once for all, as what is dealt is
    written down.
    """
    total = F.bit_xor if xor else F.sum
    rows = cut(rows.withColumns({f"v_{k}": v for k, v in values.items()}).withColumn("salt", F.rand(11)))
    slabs = max(1, min(MOST_SLABS, rows.count() // SLAB_ROWS))
    dealt = rows.repartitionByRange(slabs, "conv_id", *order, "salt") if slabs > 1 else rows.coalesce(1)
    dealt = cut(dealt.withColumn("slab", F.spark_partition_id()))
    edges = dealt.groupBy("slab").agg(F.min("conv_id").alias("low"), F.max("conv_id").alias("high"))
    edge = dealt.join(F.broadcast(edges), "slab").where("conv_id = low or conv_id = high").groupBy("slab", "conv_id").agg(*(total(f"v_{k}").alias(f"v_{k}") for k in values))
    earlier = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select("slab", "conv_id", *(F.coalesce(total(f"v_{k}").over(earlier), F.lit(0)).alias(f"c_{k}") for k in values))
    inside = Window.partitionBy("slab", "conv_id").orderBy(*order, "salt").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(F.broadcast(carried), ["slab", "conv_id"], "left")
    put = lambda a, b: a.bitwiseXOR(b) if xor else a + b
    return joined.select(*rows.drop("salt", *(f"v_{k}" for k in values)).columns, *(put(F.coalesce(f"c_{k}", F.lit(0)), total(f"v_{k}").over(inside)).alias(k) for k in values))


def ranked(said: DataFrame) -> DataFrame:
    """Rows (conv_id, place, da, db, words) of ``turns``, places from 1 by turn (null first).

    Rows of one turn come by role, then by the digest of role and text; equal rows are turns of their own.
    """
    return cut(along(said, ["turn", "role", "da", "db"], {"place": F.lit(1).cast("long")}).select("conv_id", "place", "da", "db", "words"))


def taken_over(key: Column, most: int = 4) -> Column:
    """How many turns a conversation takes from another: the unsigned crc32 of its decimal key modulo ``most``."""
    return F.crc32(key.cast("string").cast("binary")) % most


def branched(places: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(turns as ``ranked`` gives them, conversations with their length) of conversations that begin as others do.

    Conversation c takes its first h turns from c - c % ``every`` (fewer or none where there are none), then goes on with its own turns
    after its first h; h is ``taken_over``. Conversations that are left without a turn are in the second table.
    """
    own = places.groupBy("conv_id").agg(F.count(F.lit(1)).alias("held"))
    own = own.select("conv_id", "held", taken_over(F.col("conv_id"), most).alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    first = places.where((F.col("conv_id") % every == 0) & (F.col("place") < most)).groupBy(F.col("conv_id").alias("base")).agg(F.collect_list(F.struct("place", "da", "db", "words")).alias("begins"))
    own = own.join(first, "base", "left").withColumn("begins", F.filter(F.coalesce("begins", F.array()), lambda t: t.place <= F.col("h")))
    own = cut(own.select("conv_id", "h", "begins", F.size("begins").cast("long").alias("got"), F.greatest(F.col("held") - F.col("h"), F.lit(0)).alias("kept")))
    begun = own.select("conv_id", F.inline("begins"))
    on = places.join(own.select("conv_id", "h", "got"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("got")).alias("place"), "da", "db", "words")
    return begun.unionByName(on), own.select("conv_id", (F.col("got") + F.col("kept")).alias("length"))


def members(places: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conversation and each of its prefixes, the empty one too: node, parent, depth, words of the last turn, ``ended``.

    A node's name is the exclusive or of its turns' digests, each mixed with its place, so names of prefixes are a running total, and taking
    the last turn out of it gives the parent's. The root's name is (0, 0).
    """
    mixed = places.select("conv_id", "place", "words", *(F.xxhash64(F.lit(k), "place", "da", "db").alias(f"m{k}") for k in range(2)))
    run = along(mixed, ["place"], {n: F.col(f"m{k}") for k, n in enumerate(NODE)}, xor=True)
    deep = run.select("conv_id", F.col("place").alias("depth"), "words", *NODE, *(F.col(n).bitwiseXOR(F.col(f"m{k}")).alias(p) for k, (n, p) in enumerate(zip(NODE, PARENT, strict=True))))
    deep = deep.join(conversations, "conv_id").withColumn("ended", F.col("depth") == F.col("length")).drop("length")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    roots = conversations.select("conv_id", zero.alias("depth"), zero.alias("words"), *(zero.alias(n) for n in NODE), *(none.alias(p) for p in PARENT), (F.col("length") == 0).alias("ended"))
    return cut(deep.unionByName(roots))


def rolled_up(nodes: DataFrame, values: Sequence[str], depth: int) -> DataFrame:
    """``nodes`` (NODE, PARENT, values) with each value summed over the node's subtree, in log2(``depth``) rounds.

    After k rounds a node holds the total of its descendants less than 2^k below it and points at its ancestor 2^k above. A round
    adds to each node what those who point at it hold, which completes 2^(k+1), and doubles the pointers. Totals are summed map-side
    before they are joined; nodes that share a pointer are the side of the join that adaptive execution splits. Each round
    is written down.
    """
    now = cut(nodes.select(*NODE, *PARENT, *values))
    for k in range(depth.bit_length()):
        sent = now.where("pa is not null").groupBy(*PARENT).agg(*(F.sum(v).alias(f"sent_{v}") for v in values))
        sent = sent.select(*(F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)), *(f"sent_{v}" for v in values))
        got = now.join(sent, list(NODE), "left").select(*NODE, *PARENT, *((F.col(v) + F.coalesce(f"sent_{v}", F.lit(0))).alias(v) for v in values))
        if 2 << k <= depth:
            above = now.select(*(F.col(n).alias(p) for p, n in zip(PARENT, NODE, strict=True)), *(F.col(p).alias(f"next_{p}") for p in PARENT))
            got = got.join(above, list(PARENT), "left").select(*NODE, *(F.col(f"next_{p}").alias(p) for p in PARENT), *values)
        now = cut(got)
    return now.select(*NODE, *values)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids in order of node and id as rows (node, first id, up to CHUNK_IDS of them joined by commas)."""
    node, ids = None, []

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])], ["na", "nb", "first_id", "ids"])

    for batch in batches:
        for a, b, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != (a, b) or len(ids) == CHUNK_IDS:
                if ids:
                    yield row()
                node, ids = (a, b), []
            ids.append(key)
    if ids:
        yield row()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's list from its chunks in order; only the hash's state is held."""
    node, state = None, hashlib.sha256()

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()])], ["na", "nb", "ends_sha256"])

    for batch in batches:
        for a, b, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node == (a, b):
                state.update(b",")
            else:
                if node is not None:
                    yield row()
                node, state = (a, b), hashlib.sha256()
            state.update(ids.encode())
    if node is not None:
        yield row()


def ends(rows: DataFrame) -> DataFrame:
    """Rows (NODE, ends_sha256) of the nodes at which conversations end: the hash of their keys in order, joined by commas.

    Such a hash is a chain: it can't be put together from parts. What can is put apart: keys are ordered by ranges, so that a
    node at which a third of all conversations end is many tasks, and packed there to chunks; the task that hashes a node
    streams its chunks, a few hundredths of its rows, and holds none of them.
    """
    own = rows.where("ended").select(*NODE, "conv_id")
    chunks = own.repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(_packed, "na long, nb long, first_id long, ids string")
    return chunks.repartition(*NODE).sortWithinPartitions(*NODE, "first_id").select(*NODE, "ids").mapInArrow(_hashed, "na long, nb long, ends_sha256 string")


def trie(places: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``places`` (conv_id, place, da, db, words) and ``conversations`` (conv_id, length).

    conv_id is the smallest of the conversations that begin with the node's turns, n_convs their number; depth, parent_conv_id, n_children;
    n_leaves, childless nodes in the subtree; saved_tokens, the sum over the subtree of (n_convs - 1) times the words of a node's last
    turn; ends_sha256, the hash of the keys of the conversations that end there. Conversations without a turn end at the root,
    which has no parent. Without a conversation there is no node.
    """
    rows = members(places, conversations)
    nodes = rows.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("words").alias("words"), *(F.min(p).alias(p) for p in PARENT))
    nodes = cut(nodes)
    kids = nodes.where("pa is not null").groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(kids.select(*(F.col(p).alias(n) for p, n in zip(PARENT, NODE, strict=True)), "n_children"), list(NODE), "left").na.fill(0, ["n_children"])
    nodes = cut(nodes.withColumns({"n_leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}))
    totals = rolled_up(nodes, ["n_leaves", "saved_tokens"], nodes.agg(F.max("depth")).first()[0] or 0)
    above = nodes.select(*(F.col(n).alias(p) for p, n in zip(PARENT, NODE, strict=True)), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.drop("n_leaves", "saved_tokens").join(totals, list(NODE)).join(ends(rows), list(NODE), "left").join(above, list(PARENT), "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, **columns: str) -> DataFrame:
    """The trie of conversations as they stand; ``columns`` names key, turn, role and text."""
    places = ranked(turns(conversations, **columns))
    return trie(places, places.groupBy("conv_id").agg(F.max("place").alias("length")))
