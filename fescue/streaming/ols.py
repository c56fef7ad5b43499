"""Least squares over a stream: cross-products add up, so the state is K by K and a late row is as good as an early one."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product_sums(stream: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A streaming aggregate with the sum of every product of two of the columns (name: expression) and of them alone."""
    cols = [F.lit(1.0), *[F.expr(e).cast("double") for e in columns.values()]]
    names = ["1", *columns]
    sums = [F.sum(cols[i] * cols[j]).alias(f"{names[i]}*{names[j]}") for i in range(len(cols)) for j in range(i, len(cols))]
    return stream.agg(*sums)


def coefficients(sums, columns: dict[str, str], outcome: str) -> dict[str, float]:
    """The fit that a row of product_sums stands for."""
    names = ["1", *columns]
    g = np.array([[sums[f"{a}*{b}"] if f"{a}*{b}" in sums.asDict() else sums[f"{b}*{a}"] for b in names] for a in names], float)
    x = [k for k, n in enumerate(names) if n != outcome]
    beta = np.linalg.solve(g[np.ix_(x, x)], g[np.ix_(x, [names.index(outcome)])][:, 0])
    return {"(Intercept)" if names[k] == "1" else names[k]: float(b) for k, b in zip(x, beta)}


def fit_stream(stream: DataFrame, columns: dict[str, str], outcome: str, table: str) -> dict[str, float]:
    """Runs over what the stream has now (all of it, in as many batches as it takes) and returns the coefficients."""
    spark = stream.sparkSession
    q = product_sums(stream, columns).writeStream.outputMode("complete").format("memory").queryName(table).trigger(availableNow=True).start()
    q.awaitTermination()
    return coefficients(spark.table(table).first(), columns, outcome)
