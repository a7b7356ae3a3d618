"""Filter interaction audit: what each filter of a chain removes, alone, in any order and in any company."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import lcm

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Limits of the filters: words, percent of distinct words, percent of capitals.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 100, 80, 10
WORD, MARKUP = r"[^\x20\x09-\x0D]+", "[#$%&*|]"
#: What is counted at an intersection, and the name of the loss that it gives.
WEIGHTS = {"n": "removed", "good": "good_lost", "toxic": "toxic_lost"}


def text_failures(text: Column, words: Column) -> dict[str, Column]:
    """The filters that a text fails by itself; ``words`` are its words."""
    distinct, n = F.size(F.array_distinct(words)), F.size(words)
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": n < LEAST_WORDS, "B": distinct * 100 < n * LEAST_DISTINCT, "C": capitals * 100 > F.length(text) * MOST_CAPITALS, "D": text.rlike(MARKUP)}


def bits(failed: Mapping[str, Column]) -> Column:
    """Failures as bits of a number, the first filter the lowest."""
    total = F.lit(0)
    for k, column in enumerate(failed.values()):
        total = total + F.when(column, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Rows (part, mask, n, good, toxic): documents of a part that fail the filters of a mask (A is 1, E is 16) and no others.

    A text leaves its scan as a digest and four bits. Rows that are equal in key, part and text are counted before the
    labels are joined, rows of one text, part and label class after it, so a text that a third of all rows hold is a
    few counted rows before anything is joined by it: E keeps the rows with a text's smallest key and fails the others.

    Null texts and parts are empty ones. A row without a key has no label, fails no E and makes none fail. Rows that repeat
    a key are each counted, and none of them is smaller than the other. A key that is labelled repeatedly is good, or
    toxic, if one of its labels says so; labels other than 1, null ones too, say nothing. Very long texts are read whole, empty
    tables give no rows, other columns of any name are not read.
    """
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = rows.select("key", "part", "text", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"))
    rows = rows.select("key", "part", F.unhex(F.sha2("text", 256)).alias("digest"), bits(text_failures(F.col("text"), F.col("words"))).alias("own"))
    rows = rows.groupBy("key", "part", "digest", "own").agg(F.count(F.lit(1)).alias("n"))
    says = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("key")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    rows = rows.join(says, "key", "left").na.fill(False, ["is_good", "is_toxic"])
    known = F.when(F.col("key").isNotNull(), F.col("n")).otherwise(F.lit(0))
    groups = rows.groupBy("digest", "own", "part", "is_good", "is_toxic").agg(F.sum("n").alias("n"), F.sum(known).alias("known"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "n"))).alias("first"))
    least = groups.groupBy("digest").agg(F.min("first.key").alias("least"))
    # A key with several rows of one text and part was counted before; its count came along with the smallest key.
    fails = F.col("known") - F.when(F.col("first.key") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = groups.join(least, "digest").withColumn("fails", F.coalesce(fails, F.lit(0)))
    both = split.select("part", "is_good", "is_toxic", F.explode(F.array(F.struct(F.col("own").alias("mask"), (F.col("n") - F.col("fails")).alias("n")), F.struct((F.col("own") + 16).alias("mask"), F.col("fails").alias("n")))).alias("cell"))
    n = F.col("cell.n")
    return both.groupBy("part", F.col("cell.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("is_good"), n).otherwise(F.lit(0))).alias("good"), F.sum(F.when(F.col("is_toxic"), n).otherwise(F.lit(0))).alias("toxic"))


def joint_failures(counted: DataFrame, filters: int = 5) -> DataFrame:
    """One row per part with an array for each weight: at place S, what fails every filter of S (at place 0: everything).

    The product of a document's flags over S is 1 exactly if its mask holds S.
    """
    held = [F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(F.lit(s)) == s, F.col(w))), F.lit(0)) for w in WEIGHTS for s in range(1 << filters)]
    size = 1 << filters
    return counted.groupBy("part").agg(*(h.alias(f"h{k}") for k, h in enumerate(held))).select("part", *(F.array(*(f"h{i * size + s}" for s in range(size))).alias(w) for i, w in enumerate(WEIGHTS)))


def sign(mask: Column) -> Column:
    return F.lit(1) - F.lit(2) * (F.bit_count(mask) % 2)


def survivors(joint: Column, filters: int = 5) -> Column:
    """What passes all filters of each set, by inclusion and exclusion over the joint failures of its subsets."""
    sets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    return F.transform(sets, lambda t: F.aggregate(sets, F.lit(0).cast("long"), lambda total, s: total + F.when(s.bitwiseAND(t) == s, sign(s) * F.get(joint, s)).otherwise(F.lit(0))))


def over_supersets(joint: Column, one: Column, share: Column | None, filters: int = 5) -> Column:
    """Alternating sum of joint failures over the sets that hold the bit ``one``: with a share of each set its dividends, without
    one what fails that filter and no other."""
    sets = F.sequence(F.lit(0), F.lit((1 << filters) - 1))
    part = (lambda s: F.lit(1)) if share is None else (lambda s: F.get(share, F.bit_count(s)))
    return F.aggregate(sets, F.lit(0).cast("long"), lambda total, s: total - F.when(s.bitwiseAND(one) == one, sign(s) * F.get(joint, s) * part(s)).otherwise(F.lit(0)))


def audit(counted: DataFrame, names: str = "ABCDE") -> DataFrame:
    """Per part, order of all filters and step, from the counts of ``cells``.

    All numbers come from the joint failures of each set of filters. Survivors of a set are their alternating sum over its subsets;
    a step removes the difference of two survivors. The Harsanyi dividend of a set in the game "documents removed" is its joint failures
    with alternating sign, and a filter's Shapley value its equal share of every dividend that it takes part in; it is returned
    times the number of orders, which makes it whole: the sum over all orders of what the filter removes. A part of the
    result has one row in each order and step, zeros included; no part, no rows.
    """
    k = len(names)
    orders = ["".join(p) for p in permutations(names)]
    assert len(orders) % lcm(*range(1, k + 1)) == 0
    shares = F.array(F.lit(0), *(F.lit(len(orders) // size) for size in range(1, k + 1)))
    joint = joint_failures(counted, k)
    parts = joint.select("part", "n", *(survivors(F.col(w), k).alias(f"kept_{w}") for w in WEIGHTS))
    one_of = [F.lit(1 << i) for i in range(k)]
    parts = parts.withColumns({"alone": F.array(*(over_supersets(F.col("n"), one, None, k) for one in one_of)), "shapley_of": F.array(*(over_supersets(F.col("n"), one, shares, k) for one in one_of))})
    bit_of = F.create_map(*(F.lit(x) for i, letter in enumerate(names) for x in (letter, 1 << i)))
    steps = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    steps = steps.withColumn("path", F.transform(F.split("filter_order", ""), lambda letter: bit_of[letter])).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    steps = steps.withColumns({"bit": F.get("path", F.col("step") - 1), "before": F.aggregate(F.slice("path", F.lit(1), F.col("step") - 1), F.lit(0), lambda total, x: total + x), "place": F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1))) - 1})
    lost = {name: (F.get(f"kept_{w}", F.col("before")) - F.get(f"kept_{w}", F.col("before") + F.col("bit"))).alias(name) for w, name in WEIGHTS.items()}
    fails = F.get("n", F.col("bit"))
    return steps.select(
        "part", "filter_order", "step", F.get("kept_n", F.col("before") + F.col("bit")).alias("kept"), lost["removed"], (fails - lost["removed"]).alias("redundant"),
        F.get("alone", F.col("place")).alias("unique_fails"), lost["good_lost"], lost["toxic_lost"], F.get("shapley_of", F.col("place")).alias("shapley"),
    )
