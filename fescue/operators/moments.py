"""Sums of products over all rows, in one aggregate; what reaches the driver is as wide as the model, however long the table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns up to which the products are summed in generated code; a wider matrix is summed in each task by numpy.
WIDE = 24


def gram(df: DataFrame, cols: list[str], weight: str | None = None) -> np.ndarray:
    return counted_gram(df, cols, weight)[0]


def counted_gram(df: DataFrame, cols: list[str], weight: str | None = None) -> tuple[np.ndarray, int]:
    """Sum of weight * c_i * c_j over the rows, for all pairs of columns (doubles without nulls), and the number of rows."""
    m = len(cols)
    if m <= WIDE:
        w = F.col(weight) if weight else F.lit(1.0)
        sums = [F.sum(w * F.col(cols[i]) * F.col(cols[j])) for i in range(m) for j in range(i, m)]
        found = df.agg(*[s.alias(f"s{k}") for k, s in enumerate(sums)], F.count("*")).first()
        out, k = np.zeros((m, m)), 0
        for i in range(m):
            for j in range(i, m):
                out[i, j] = out[j, i] = found[k] or 0.0
                k += 1
        return out, found[k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((m, m)), 0
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += len(x)
            total += (x[:, :m] * (x[:, m:] if weight else 1.0)).T @ x[:, :m]
        i, j = np.triu_indices(m)
        i, j, v = np.append(i, m), np.append(j, m), np.append(total[i, j], n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(v)], names=["i", "j", "v"])

    out = np.zeros((m + 1, m + 1))
    for i, j, v in df.select(*cols, *([weight] if weight else [])).mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out[:m, :m], int(out[m, m])


def usable(c: Column) -> Column:
    """Not null, not NaN, not infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def drop_collinear(g: np.ndarray, tol: float = 1e-9, noise: np.ndarray | float = 0.0, share: float = 1e-10) -> list[int]:
    """Columns that stay when each is taken in turn and one whose pivot is below tol, or below share of the sum of squares that the
    effects leave of it, or below the rounding error of that sum, is dropped."""
    a, kept = np.array(g, float), []
    floor = np.maximum(np.maximum(tol, share * np.diag(g)), noise)
    for j in range(len(a)):
        if a[j, j] > floor[j]:
            kept.append(j)
            a -= np.outer(a[:, j], a[j]) / a[j, j]
    return kept


def pseudo_inverse(a: np.ndarray, share: float = 1e-11) -> np.ndarray:
    """Of a symmetric matrix; directions with next to no weight are left out."""
    if not len(a):
        return a
    values, vectors = np.linalg.eigh((a + a.T) / 2)
    good = values > share * max(values.max(), 0)
    return (vectors[:, good] / values[good]) @ vectors[:, good].T
