"""Sharding by a two-pass external shuffle. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeframe.llm.common import attach, cut, free_name, numbered, running, shared_folder

#: A table of buckets up to this many rows is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 65_536
#: Bytes of text of a bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 64 << 20, 256


def assign(df: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", seed: int = 7, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with size, law, shard and slot: a uniform permutation of all rows, cut into ``shards`` equal slices.

    Pass one scatters rows by a seeded hash of key and text into buckets of about ``bucket_bytes``, so rows without a
    key or with a common one fall apart by their texts, and rows equal in both, which are numbered, by their numbers. Pass two permutes each bucket: the n places of a bucket are
    an array that Spark's shuffle() puts in Fisher-Yates order, and the row that is i-th by another hash takes the
    i-th place. The array is made from spark.range with a fixed partitioning, so a recomputed task draws the same
    order. Law `rows`: shard sizes differ by one at most. Null keys or texts are rows like others (size: text
    bytes plus 1), empty and very long texts too; an empty table gives an empty result. Result columns replace inputs of their name.
    """
    spark = df.sparkSession
    bucket, place, mark, both, number, b, base, places = (free_name(df, f"shard_{n}") for n in ("bucket", "place", "mark", "both", "number", "b", "base", "places"))
    name, words = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    told = numbered(df.withColumns({mark: F.xxhash64(words, F.lit(seed)), both: F.xxhash64(name, words)}), [mark, both], number)
    sized = attach(told, {"size": F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + 1})
    total = sized.agg(F.sum("size")).first()[0] or 0
    n = max(LEAST_BUCKETS, -(-total // max(1, bucket_bytes)))
    scattered = sized.withColumn(bucket, F.pmod(F.xxhash64(name, F.col(mark), F.col(number), F.lit(seed)), F.lit(n)).cast("int"))
    counts = cut(scattered.groupBy(F.col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n")))
    starts = cut(running(counts, [F.col("b")], {"base": F.col("n")}))
    rows = counts.agg(F.sum("n")).first()[0] or 0
    dealt = spark.range(0, n, 1, max(1, min(n, 1024))).select(F.col("id").cast("int").alias("b"))
    orders = dealt.join(F.broadcast(starts) if n <= BROADCAST_ROWS else starts, "b").select(
        F.col("b").alias(b), F.col("base").alias(base), F.shuffle(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(seed)).alias(places)
    )
    turn = Window.partitionBy(bucket).orderBy(F.xxhash64(name, F.col(mark), F.col(number), F.lit(seed + 1)), F.col(f"`{key}`"), F.col("size"), F.col(mark), F.col(number))
    queued = scattered.withColumn(place, F.row_number().over(turn))
    joined = queued.join(orders, F.col(bucket) == F.col(b))
    joined = joined.withColumn(place, F.col(base) + F.element_at(places, F.col(place).cast("int")))
    first = f"((`{place}` * {shards}) div {max(1, rows)})"
    slot = F.col(place) - F.expr(f"({first} * {rows} + {shards - 1}) div {shards}")
    return attach(joined, {"law": F.lit("rows"), "shard": F.expr(first).cast("int"), "slot": slot.cast("long")}).drop(bucket, place, mark, both, number, b, base, places)


def write_shards(df: DataFrame, path: str | None = None, **options) -> str:
    """Write ``df`` with its places as Parquet below ``path`` (a new shared folder unless given), which is returned.

    A bucket's places are one stretch of the permutation, so a task writes the buckets that it has permuted as they are, in slot
    order, to the folders of their shards; rows move once, when they are scattered.
    """
    path = path or shared_folder(df.sparkSession, "shards")
    assign(df, **options).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return path
