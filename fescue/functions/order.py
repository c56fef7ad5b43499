"""Ranks, quantiles and grids of values, without a task that sees all of them."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Values between two bounds that are few enough to be sorted on the driver.
FEW = 20_000
#: Accuracy of the sketches that propose bounds.
ACCURACY = 10_000


def dense_ranks(keys: DataFrame, by: list[str], name: str) -> DataFrame:
    """keys, which are distinct, with 1, 2, ... in the order of by. They are ranked within parts of their range, so no task ranks
    them all; the parts' sizes are a row for each task."""
    # Written once, so that both uses see the same parts.
    parts = cut(keys.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "keys")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_first"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    out = parts.withColumn("_place", place).join(F.broadcast(first), "_part")
    return out.withColumn(name, (F.col("_first") + F.col("_place")).cast("long")).drop("_part", "_place", "_first")


def quantiles(df: DataFrame, c: Column | str, shares: list[float]) -> list[float | None]:
    """Exact quantiles by linear interpolation, nulls and NaN apart; None for a table without values.

    Bounds on both sides of a wanted rank are proposed by a sketch and counted exactly; only what lies between them is looked at
    in the next turn, until a rank falls on a bound or few values are left. A sketch narrows the rest some 2,500 times, so a
    few turns do for any table, whatever its ties and tails; the values that reach the driver are FEW at most for each rank."""
    c = F.col(c) if isinstance(c, str) else c
    values = df.select(c.cast("double").alias("v")).where("v is not null and not isnan(v)")
    n, low, high = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if not n:
        return [None] * len(shares)
    at = [min(max(s, 0.0), 1.0) * (n - 1) for s in shares]
    found = {0: low, n - 1: high}
    # rank: (bounds that the value lies between, values up to the lower bound, values between)
    open_ = {r: (low, high, None, None) for p in at for r in (floor(p), ceil(p)) if r not in found}
    if open_:
        ends = values.agg(F.count_if(F.col("v") == low), F.count_if(F.col("v") == high)).first()
        open_ = {r: (low, high, ends[0], n - ends[0] - ends[1]) for r in open_}
    while open_:
        for r, (a, b, below, between) in list(open_.items()):
            if r < below or r >= below + between:
                found[r] = a if r < below else b
                del open_[r]
        small = {r: x for r, x in open_.items() if x[3] <= FEW}
        for a, b, below, _ in set(small.values()):
            inside = np.sort([x[0] for x in values.where((F.col("v") > a) & (F.col("v") < b)).collect()])
            for r in [r for r, x in small.items() if x[:2] == (a, b)]:
                found[r] = float(inside[r - below])
                del open_[r]
        if not open_:
            break
        order = list(open_.items())
        asked = []
        for r, (a, b, below, between) in order:
            share, slack = (r - below + 0.5) / between, 2 / ACCURACY
            near = F.array(F.lit(max(share - slack, 0.0)), F.lit(min(share + slack, 1.0)))
            asked.append(F.percentile_approx(F.when((F.col("v") > a) & (F.col("v") < b), F.col("v")), near, F.lit(ACCURACY)))
        bounds = values.agg(*asked).first()
        counts = values.agg(*[f for k in range(len(order)) for b in bounds[k] for f in (F.count_if(F.col("v") < b), F.count_if(F.col("v") == b))]).first()
        for k, (r, (a, b, below, between)) in enumerate(order):
            under_p, at_p, under_q, at_q = counts[4 * k : 4 * k + 4]
            p, q = bounds[k]
            if r < under_p:
                open_[r] = (a, p, below, under_p - below)
            elif r < under_p + at_p:
                found[r] = p
                del open_[r]
            elif r < under_q:
                open_[r] = (p, q, under_p + at_p, under_q - under_p - at_p)
            elif r < under_q + at_q:
                found[r] = q
                del open_[r]
            else:
                open_[r] = (q, b, under_q + at_q, below + between - under_q - at_q)
    return [found[floor(p)] + (p - floor(p)) * (found[ceil(p)] - found[floor(p)]) if p != floor(p) else found[floor(p)] for p in at]


def _divisors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = 0
    for batch in batches:
        out = int(np.gcd.reduce(batch.column(0).to_numpy(), initial=out))
    yield pa.RecordBatch.from_pydict({"d": pa.array([out], pa.int64())})


def grid(df: DataFrame, t: Column) -> tuple[float, int]:
    """The least value of t, and the greatest common divisor of all distances to it (1 where there are none): a task folds its own
    values, so one number for each task reaches the driver. Raises ValueError where a distance is no whole number."""
    times = df.select(t.cast("double").alias("t")).where("t is not null")
    start = times.agg(F.min("t")).first()[0]
    if start is None:
        return 0.0, 1
    away = times.select((F.col("t") - start).alias("t")).distinct()
    if away.where("t != round(t)").limit(1).count():
        raise ValueError("a unitary step needs times that are whole numbers")
    return start, gcd(*[r[0] for r in away.select(F.col("t").cast("long")).mapInArrow(_divisors, "d long").distinct().collect()]) or 1
