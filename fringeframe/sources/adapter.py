"""The driver's tables seen as visibilities: one sample per lineitem row, a time series from events, matrices from embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that make a sample's place unique, in the order of every tie-break.
ROW_KEY = ("ok", "ln", "pk", "sk", "px")
#: Hz: first channel of window 0, step between windows, step between channels.
FREQUENCY = (230e9, 2e9, 2e8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(column: str) -> Column:
    """A timestamp without zone as seconds since 1970 in UTC, whatever the session's zone."""
    ts = F.col(column)
    whole = F.unix_date(ts.cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = whole * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return micros / F.lit(1e6)


def frequency(spw: str = "spw", chan: str = "chan") -> Column:
    first, window, step = FREQUENCY
    return F.lit(first) + F.col(spw) * F.lit(window) + F.col(chan) * F.lit(step)


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vis_sample joined with its row: key, antennas, time, window, channel, uvw in metres, value, noise, flag, weight."""
    a, b = F.col("l_suppkey") % 10, F.col("l_partkey") % 10
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_extendedprice").alias("px"),
        F.least(a, b).cast("int").alias("ant1"),
        F.greatest(a, b).cast("int").alias("ant2"),
        seconds("l_shipdate").alias("time_s"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("spw"),
        (F.col("l_linenumber") - 1).alias("chan"),
        ((F.col("l_suppkey") % 41 - 20).cast("double") * 5.0).alias("u_m"),
        ((F.col("l_partkey") % 37 - 18).cast("double") * 5.0).alias("v_m"),
        (F.col("l_extendedprice") / 1e5).alias("re"),
        (F.col("l_quantity") / 5e1 - 5e-1).alias("im"),
        (F.lit(1e-2) + F.col("l_tax")).alias("sig_re"),
        (F.lit(1e-2) + F.col("l_discount")).alias("sig_im"),
        (F.col("l_returnflag") == "R").alias("flag"),
        (F.lit(1e0) + F.col("l_quantity")).alias("weight"),
        F.col("l_returnflag").alias("hand"),
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a time series for each event_type: baseline, time_s, value."""
    return table(spark, sf_dir, "events").select(F.col("event_id"), F.col("event_type").alias("baseline"), seconds("ts").alias("time_s"), F.col("value"), F.col("user_id"))


#: The adapter as SQL for DuckDB, the prefix of the oracles.
VIS_SQL = """vis as (
  select l_orderkey ok, l_linenumber ln, l_partkey pk, l_suppkey sk, l_extendedprice px,
         cast(least(l_suppkey % 10, l_partkey % 10) as integer) ant1, cast(greatest(l_suppkey % 10, l_partkey % 10) as integer) ant2,
         epoch_us(l_shipdate) / 1e6 time_s, case when l_linestatus = 'F' then 0 else 1 end spw, l_linenumber - 1 chan,
         cast(l_suppkey % 41 - 20 as double) * 5e0 u_m, cast(l_partkey % 37 - 18 as double) * 5e0 v_m,
         l_extendedprice / 1e5 re, l_quantity / 5e1 - 5e-1 im, 1e-2 + l_tax sig_re, 1e-2 + l_discount sig_im,
         l_returnflag = 'R' flag, 1e0 + l_quantity weight, l_returnflag hand
  from lineitem)"""
SERIES_SQL = "series as (select event_id, event_type baseline, epoch_us(ts) / 1e6 time_s, value, user_id from events)"
FREQUENCY_SQL = "(230e9 + spw * 2e9 + chan * 2e8)"
