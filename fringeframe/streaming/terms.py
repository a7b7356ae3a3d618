"""Additive terms, gaps and chunks over a stream of events files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from fringeframe.sources.adapter import seconds

#: Slabs of time that are closed at once are this many times the longest step.
SLAB_STEPS = 16
PAIR = "baseline string, t0 double, t1 double, d double"
#: The state store that lists, timers and reading the state back need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def event_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """(event_id, ts, baseline, time_s, value) of Parquet files as they arrive."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    instant = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col("ts")).cast("timestamp")  # ts has no zone and is UTC
    return stream.select("event_id", instant.alias("ts"), F.col("event_type").alias("baseline"), seconds("ts").alias("time_s"), "value")


def running_terms(stream: DataFrame) -> DataFrame:
    """n, sum and sum of squares per baseline; the state is a row per baseline."""
    return stream.groupBy("baseline").agg(F.count("value").alias("n"), F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"))


def tumbling(stream: DataFrame, seconds: int, late: str = "1 hour") -> DataFrame:
    """Counts and means in windows; late rows beyond the watermark go."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds"), "baseline").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))


def sessions(stream: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Runs of events without a gap, per baseline."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "baseline").agg(F.count(F.lit(1)).alias("n"))


def neighbours(rows: pd.DataFrame, low: float, high: float, max_gap: float) -> pd.DataFrame:
    """Differences of neighbours in time whose second sample lies in [low, high), from the rows of a slab in any order."""
    rows = rows.sort_values(["time_s", "event_id"])
    t, v = rows.time_s.to_numpy(), rows.value.to_numpy()
    kept = (t[1:] - t[:-1] <= max_gap) & (t[1:] >= low) & (t[1:] < high)
    return pd.DataFrame({"t0": t[:-1][kept], "t1": t[1:][kept], "d": (v[1:] - v[:-1])[kept]})


class SlabPairs(StatefulProcessor):
    """Rows of a baseline's slab are held as they come, in any order; the slab closes when the watermark passes its end."""

    def __init__(self, slab_s: float, max_gap: float):
        self.slab_s, self.max_gap = slab_s, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", "event_id long, time_s double, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if not self.rows.exists():
            self.handle.registerTimer(int((key[1] + 1) * self.slab_s * 1000))
        for frame in rows:
            self.rows.appendList(list(frame[["event_id", "time_s", "value"]].itertuples(index=False, name=None)))
        yield pd.DataFrame(columns=["baseline", "t0", "t1", "d"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame(list(self.rows.get()), columns=["event_id", "time_s", "value"])
        self.rows.clear()
        found = neighbours(held, key[1] * self.slab_s, (key[1] + 1) * self.slab_s, self.max_gap)
        found.insert(0, "baseline", key[0])
        yield found

    def close(self) -> None:
        pass


def slabbed(rows: DataFrame, max_gap: float) -> DataFrame:
    """Each row in the slab of its time, and in the next one too if a neighbour there could pair with it.

    A slab is SLAB_STEPS longest steps, so it is complete by itself, a baseline with a third of all rows is many states, and
    about one row in SLAB_STEPS is there twice.
    """
    slab = SLAB_STEPS * max_gap
    first, last = (F.floor((F.col("time_s") + x) / F.lit(slab)) for x in (F.lit(0.0), F.lit(max_gap)))
    return rows.withColumn("slab", F.explode(F.when(first == last, F.array(first)).otherwise(F.array(first, last))))


def stream_pairs(stream: DataFrame, max_gap: float, late: str = "1 hour") -> DataFrame:
    """(baseline, t0, t1, d): differences of neighbours at most ``max_gap`` seconds apart, whatever the order in which rows come.

    A row takes its place as long as the watermark (``late`` behind the newest row) hasn't passed it. A slab's pairs are
    emitted when the watermark passes its end; what is still open when a run ends is given by ``open_pairs``. Rows older
    than the watermark are dropped by Spark. The session's state store becomes the one in STORE.
    """
    slab = SLAB_STEPS * max_gap
    stream.sparkSession.conf.set(*STORE)
    rows = slabbed(stream.withWatermark("ts", late), max_gap)
    return rows.groupBy("baseline", "slab").transformWithStateInPandas(SlabPairs(slab, max_gap), PAIR, "append", "eventTime")


def open_pairs(spark: SparkSession, checkpoint: str, max_gap: float) -> DataFrame:
    """The pairs of the slabs that a run has left open, from the state in its checkpoint; the state stays as it is."""
    slab = SLAB_STEPS * max_gap
    held = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "rows").option("flattenCollectionTypes", True).load()
    rows = held.select("key.*", "list_element.*")

    def solve(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = neighbours(frame, key[1] * slab, (key[1] + 1) * slab, max_gap)
        found.insert(0, "baseline", key[0])
        return found

    return rows.groupBy("baseline", "slab").applyInPandas(solve, PAIR)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there into a memory table and return it; for small results."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def landed(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an appending stream over what is there into Parquet files and return them."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
