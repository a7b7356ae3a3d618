"""Search of the best parameters on grids that narrow round by round, for many keys at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def nested_argmax(statistics: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]], score: Column, steps: int = 8, rounds: int = 4) -> DataFrame:
    """(keys, parameters, score): for each row of ``statistics`` (one for each key) the parameters of largest ``score``.

    Each round lays a grid of ``steps`` + 1 places over the range of every parameter; a trial is a row, and the best of a key's trials is found by an
    aggregate, of equal ones the one of smallest parameters. The next round's grid reaches one step of this one to either side of it, inside the first
    range. ``score`` is an expression of the statistics and the parameters; trials whose score is null or NaN never win. Keys don't wait for each other, and
    nothing but the keys' rows goes from one round to the next.
    """
    names = list(ranges)
    now = statistics.withColumns({f"{n}_low": F.lit(float(a)) for n, (a, _) in ranges.items()} | {f"{n}_high": F.lit(float(b)) for n, (_, b) in ranges.items()})
    best = None
    for _ in range(rounds):
        trials = now
        for n in names:
            trials = trials.withColumn("k_", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn(n, F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * F.col("k_") / F.lit(float(steps))).drop("k_")
        scored = trials.withColumn("score", score).where("score is not null and not isnan(score)")
        order = F.struct(F.col("score"), *(-F.col(n) for n in names))
        top = scored.groupBy(*keys).agg(F.max_by(F.struct("score", *names, *(c for n in names for c in (f"{n}_low", f"{n}_high"))), order).alias("t_"))
        best = top.select(*keys, "t_.*")
        bounds = {}
        for n, (a, b) in ranges.items():
            step = (F.col(f"{n}_high") - F.col(f"{n}_low")) / F.lit(float(steps))
            bounds |= {f"{n}_low": F.greatest(F.col(n) - step, F.lit(float(a))), f"{n}_high": F.least(F.col(n) + step, F.lit(float(b)))}
        now = statistics.join(best.select(*keys, *(v.alias(k) for k, v in bounds.items())), list(keys))
    return best.select(*keys, *names, "score")
