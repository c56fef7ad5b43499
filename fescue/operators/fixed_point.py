"""The coefficients of several effects given everything else: sweeps over tables of levels, extrapolated between turns."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, uncut

#: The longest step of a level in one sweep, where steps are Newton's.
STRIDE = 2.0


def _closed(name: str):
    """Of families whose levels have a root in closed form: what a row adds to a cell's e and t, what a cell adds to a level's sum
    when the other effects add o to the predictor, and the root from that sum and the level's t. None for other families."""
    y, eta, w, e, t = F.col("_y"), F.col("_eta"), F.col("_w_"), F.col("e"), F.col("t")
    if name == "poisson":
        return w * F.exp(eta), w * y, lambda o: e * F.exp(o), lambda total, own: F.log(own / total)
    if name == "Gamma":
        return w * y * F.exp(-eta), w, lambda o: e * F.exp(-o), lambda total, own: F.log(total / own)
    if name == "gaussian":
        return w * (y - eta), w, lambda o: e - t * o, lambda total, own: total / own
    return None


class _Sweeps:
    """A table for each effect: key, t, and the coefficients c now, b one sweep ago and a two sweeps ago."""

    def __init__(self, rows: DataFrame, keys: list[str], family, weight: Column, start: dict[str, DataFrame]):
        self.family, self.form = family, _closed(family.name)
        self.cells = rows.select(*keys, "_y", "_eta", weight.alias("_w_"))
        if self.form:
            # All that later sweeps read of the rows: two sums for each combination of levels.
            self.cells = cut(self.cells.groupBy(*keys).agg(F.sum(self.form[0]).alias("e"), F.sum(self.form[1]).alias("t")), "cells")
        held = {}
        for key in keys:
            own = F.sum("t") if self.form else F.sum("_w_")
            first = self.cells.groupBy(F.col(key).alias("key")).agg(own.alias("t"))
            if key in start:
                first = first.join(start[key].select("key", F.col("c0").alias("c")), "key", "left").select("key", "t", F.coalesce("c", F.lit(0.0)).alias("c"))
            else:
                first = first.withColumn("c", F.lit(0.0))
            held[key] = cut(first.select("key", "t", "c", F.col("c").alias("b"), F.col("c").alias("a")), "levels")
        # The effect with the most levels follows from the others, so that it takes no part in extrapolation.
        self.keys = sorted(keys, key=lambda k: held[k].count())
        self.held, self.now = held, dict(held)

    def update(self, key: str) -> None:
        met = self.cells
        joined = [k for k in self.keys if k != key or not self.form]
        for k in joined:
            met = met.join(self.now[k].select(F.col("key").alias(f"_key_{k}"), F.col("c").alias(f"_c_{k}")), F.col(k) == F.col(f"_key_{k}"))
        given = sum((F.col(f"_c_{k}") for k in joined), F.lit(0.0))
        by = met.groupBy(F.col(key).alias("key"))
        if self.form:
            sums, to = by.agg(F.sum(self.form[2](given)).alias("_total")), self.form[3](F.col("_total"), F.col("t"))
        else:
            eta = F.col("_eta") + given
            mu = self.family.inverse(eta)
            pull = F.col("_w_") * self.family.slope(eta) / self.family.variance(mu)
            sums = by.agg(F.sum(pull * (F.col("_y") - mu)).alias("_score"), F.sum(pull * self.family.slope(eta)).alias("_info"))
            to = F.col("c") + F.greatest(F.least(F.try_divide("_score", "_info"), F.lit(STRIDE)), F.lit(-STRIDE))
        after = cut(sums.join(self.now[key], "key").select("key", "t", to.alias("c"), F.col("c").alias("b"), F.col("b").alias("a")), "levels")
        uncut(self.held[key])
        self.held[key] = self.now[key] = after

    def sweep(self) -> None:
        for key in [self.keys[-1], *self.keys[:-1]]:
            self.update(key)

    def movement(self) -> tuple[float, float, float]:
        """Largest last step, and the two products that the extrapolation needs, in one job over all tables."""
        last, turn = F.col("c") - F.col("b"), F.col("c") - 2 * F.col("b") + F.col("a")
        every = reduce(DataFrame.unionByName, [self.now[k].select("c", "b", "a", F.lit(k != self.keys[-1]).alias("_in")) for k in self.keys])
        count = lambda x: F.sum(F.when(F.col("_in"), x).otherwise(0.0))
        got = every.agg(F.max(F.abs(last) / (1 + F.abs("c"))), count(last * turn), count(turn * turn), F.count_if(F.col("c").isNull() | F.isnan("c") | (F.abs("c") == float("inf")))).first()
        if got[3]:
            raise RuntimeError(f"{got[3]} levels have no finite coefficient")
        return got[0] or 0.0, got[1], got[2]

    def extrapolate(self, share: float) -> None:
        for k in self.keys[:-1]:
            self.now[k] = self.held[k].withColumn("c", F.col("c") - share * (F.col("c") - F.col("b")))


def solve_effects(rows: DataFrame, keys: list[str], family, weight: Column, start: dict[str, DataFrame] | None = None, tol: float = 1e-10, most: int = 500, extrapolated: bool = True) -> tuple[dict[str, DataFrame], int]:
    """For each of keys a table key, c0 of the numbers that, added to _eta of their rows, make the scores of _y zero in every level of
    every effect; and how many sweeps that took.

    A sweep gives each effect in turn the root of its levels' scores given the other effects. Poisson, Gamma (log link) and
    gaussian have it in closed form from sums by combination of levels, which the rows are read for once; for other families a
    sweep takes a Newton step of each level. After two sweeps the last one's steps are extended as far as the two
    together tell (Irons and Tuck's rule over all levels at once). No regression and no pass over the regressors is made.

    Shuffles of a sweep with Q effects: for each effect one of its sums by level and, for each table of levels too large to
    be broadcast, one of that table and one of the cells; so Q (2 Q - 1) at most, and Q where the tables are small. A
    level that holds much of the cells is summed in part before its shuffle, and adaptive execution splits its join.

    Levels without a finite root have to be removed before. RuntimeError where the steps do not fall below tol in most turns."""
    work, moved = _Sweeps(rows, keys, family, weight, start or {}), float("inf")
    for turn in range(most):
        work.sweep()
        work.sweep()
        moved, top, bottom = work.movement()
        if moved < tol:
            if work.form:
                uncut(work.cells)
            return {k: t.select("key", F.col("c").alias("c0")) for k, t in work.held.items()}, 2 * (turn + 1)
        if extrapolated and bottom and np.isfinite(top / bottom):
            work.extrapolate(top / bottom)
    raise RuntimeError(f"the effects {', '.join(keys)} do not settle in {2 * most} sweeps: the last step was {moved}")
