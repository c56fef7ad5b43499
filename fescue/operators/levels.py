"""The coefficients of an effect's levels given everything else, for all levels at once: each is the root of its own score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, uncut


def solve_levels(rows: DataFrame, key: str, family, weight: Column, tol: float = 1e-10, most: int = 100) -> DataFrame:
    """key, c0: for each level the number that, added to _eta of its rows, makes its score of _y zero.

    A level's score falls in that number, and its root lies between the link of the level's mean outcome less the largest and
    less the smallest _eta. A table of levels holds the number and both bounds. A turn sums scores and expected information
    by level, in one aggregate for all of them, moves a bound to where the score was taken and steps by Newton; a step that
    leaves the bounds, or is over half as long as the one before, goes to their middle. Levels without a finite root
    (outcomes all 0, or all 1 for logit) have to be removed before; RuntimeError if some do not settle."""
    first = rows.groupBy(F.col(key).alias("key")).agg((F.sum(weight * F.col("_y")) / F.sum(weight)).alias("m"), F.min("_eta").alias("least"), F.max("_eta").alias("largest"), (F.sum(weight * F.col("_eta")) / F.sum(weight)).alias("mid"))
    at = family.link(F.col("m"))
    # The link of probit is an approximate one.
    slack = F.lit(0.1) + 0.6 * F.abs(at)
    now = cut(first.select("key", (at - F.col("mid")).alias("c"), (at - F.col("largest") - slack).alias("lo"), (at - F.col("least") + slack).alias("hi")).withColumn("was", F.col("hi") - F.col("lo")), "levels")
    for _ in range(most):
        eta = F.col("_eta") + F.col("c")
        mu = family.inverse(eta)
        score = family.slope(eta) / family.variance(mu)
        met = rows.select(F.col(key).alias("key"), "_y", "_eta", weight.alias("_w_")).join(now, "key")
        sums = met.groupBy("key").agg(F.max("c").alias("c"), F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("was").alias("was"), F.sum(F.col("_w_") * score * (F.col("_y") - mu)).alias("s"), F.sum(F.col("_w_") * score * family.slope(eta)).alias("i"))
        held = sums.withColumns({"lo": F.when(F.col("s") >= 0, F.col("c")).otherwise(F.col("lo")), "hi": F.when(F.col("s") <= 0, F.col("c")).otherwise(F.col("hi"))})
        step = F.col("c") + F.try_divide("s", "i")
        good = (step >= F.col("lo")) & (step <= F.col("hi")) & (F.abs(step - F.col("c")) <= F.col("was") / 2)
        to = F.when(good, step).otherwise((F.col("lo") + F.col("hi")) / 2)
        after = cut(held.select("key", to.alias("c"), "lo", "hi", F.abs(to - F.col("c")).alias("was")), "levels")
        uncut(now)
        now = after
        moved = now.agg(F.max(F.col("was") / (1 + F.abs("c")))).first()[0]
        if moved is None or moved < tol:
            return now.select("key", F.col("c").alias("c0"))
    raise RuntimeError(f"levels of {key} do not settle: the last step was {moved}")
