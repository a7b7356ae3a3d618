"""Mixing sources to target weights: whole copies plus one hash-seeded Bernoulli copy. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fringeframe.llm.common import attach, cut, free_name, numbered, running

#: A table of targets up to this many sources is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 100_000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: float = 3.0) -> DataFrame:
    """``sizes`` (source, source_size; one row per source) with the target of each source.

    Targets share ``share`` of all sizes by weight, stop at ``most`` times the source's size, and what is
    cut off goes to the others by weight: the level t at which sum(min(most * size, weight * t)) is the
    wanted total. Sources in order of most * size / weight reach their limit one after the other, so
    running sums give t without a loop. Sources without a word get 0. The input is already one row per
    source; it is ordered in slabs, so that no task sees all sources.
    """
    named = [F.col("source").isNull(), F.col("source")]
    table = F.array(*(F.lit(float(w)) for w in weights))
    ranked = running(sizes, named, {"rank": F.lit(1).cast("long")})
    ranked = ranked.withColumn("weight", F.element_at(table, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    filled = cut(running(ranked, [F.col("limit") / F.col("weight"), *named], {"limits": F.col("limit"), "weights": F.col("weight")}))
    total = filled.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(total["size"] or 0)) * F.lit(float(share)) - F.col("limits")) / (F.lit(float(total["weight"] or 0)) - F.col("weights"))
    # The first source that its share doesn't fill sets the level of all after it.
    open_ = filled.withColumn("level", level).where(F.col("weight") * F.col("level") <= F.col("limit"))
    first = open_.agg(F.min_by("level", F.struct(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source")))).first()[0]
    share_of = F.col("limit") if first is None else F.least(F.col("limit"), F.col("weight") * F.lit(first))
    return filled.select("source", "source_size", share_of.alias("target"))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: Sequence[float] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """``df`` with size, source_size, target and copies: how often the mix takes each document.

    copies = floor(rate), plus one where the document's hash in [0, 1) is below the rate's fraction; rate is
    target / source_size. The hash is of key and text, so reruns agree, and rows without a key or with a common one draw
    each for itself; rows equal in both are numbered and draw by their number too. Null and empty texts have size 0 and are taken by the same
    law, very long ones like others; an empty table gives an empty result; result columns replace inputs of their name.
    Rows are never grouped: sizes are summed per source map-side first, and only that small table is ordered.
    """
    tag, mark_a, mark_b, turn, at, total, aim = (free_name(df, f"mix_{n}") for n in ("source", "mark_a", "mark_b", "turn", "key", "total", "target"))
    words = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marks = {mark_a: F.xxhash64(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), words), mark_b: F.xxhash64(F.lit(1), words)}
    sized = attach(numbered(df.withColumns(marks), [mark_a, mark_b], turn), {"size": word_count(F.col(f"`{text}`")), tag: F.col(f"`{source}`")})
    sums = sized.groupBy(F.col(tag).alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(sums, weights).select(F.col("source").alias(at), F.col("source_size").alias(total), F.col("target").alias(aim))
    targets = cut(targets)
    if targets.count() <= BROADCAST_ROWS:
        targets = F.broadcast(targets)
    joined = sized.join(targets, F.col(tag).eqNullSafe(F.col(at)), "left")
    rate = F.when(F.col(total) > 0, F.col(aim) / F.col(total)).otherwise(F.lit(0.0))
    copies = (F.floor(rate) + (draw(F.col(f"`{key}`"), F.col(f"`{text}`"), F.col(turn), seed) < rate - F.floor(rate)).cast("long")).cast("long")
    out = attach(joined, {"source_size": F.col(total), "target": F.col(aim), "copies": copies})
    return out.drop(tag, mark_a, mark_b, turn, at, total, aim)


def draw(key: Column, text: Column, turn: Column, seed: str) -> Column:
    """A number in [0, 1) from a row's key and text, and from its number if others are equal in both."""
    name = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.when(turn > 0, turn.cast("string")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def emit(mixed: DataFrame) -> DataFrame:
    """One row per copy of what ``mix`` returns; rows with no copy go."""
    return mixed.where("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
