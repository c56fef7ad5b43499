"""Tables looked over: distinct values, keys of two tables held against each other, ids, sizes, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.order import dense_ranks


def n_unique(df: DataFrame, *what: str, where: dict[str, str] | None = None) -> DataFrame:
    """One row: .N rows, .U distinct rows, a column or columns joined by ^ for their distinct values, NA(x) for nulls of x; a name
    with a condition in where counts the rows that meet it."""
    where, out = where or {}, []
    for w in what:
        base = w.split("[")[0]
        cond = F.expr(where[w]) if w in where else F.lit(True)
        if base == ".N":
            out.append(F.count_if(cond).alias(w))
        elif base == ".U":
            out.append(F.count_distinct(F.when(cond, F.struct(*df.columns))).alias(w))
        elif base == ".NA":
            out.append(F.count_if(cond & _any_null(df, df.columns)).alias(w))
        elif base.startswith("NA("):
            out.append(F.count_if(cond & _any_null(df, [base[3:-1]])).alias(w))
        else:
            keys = base.split("^")
            out.append(F.count_distinct(F.when(cond & ~_any_null(df, keys), F.struct(*keys))).alias(w))
    return df.agg(*out)


def _any_null(df: DataFrame, cols: list[str]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.col(c).isNull()
        if df.schema[c].dataType.typeName() in ("double", "float"):
            out = out | F.isnan(c)
    return out


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """key, only_a, only_b, common: distinct values of each key (columns joined by ^) in one table, the other, both."""
    out = None
    for k in keys:
        cols = k.split("^")
        # A key column may have any name, so the key is one value beside the mark.
        x, y = (df.where(~_any_null(df, cols)).select(F.struct(*cols).alias("key"), F.lit(mark).alias("mark")).distinct() for df, mark in ((a, 1), (b, 2)))
        seen = x.union(y).groupBy("key").agg(F.sum("mark").alias("mark"))
        told = {"only_a": 1, "only_b": 2, "common": 3}
        row = seen.agg(*[F.count_if(F.col("mark") == m).alias(name) for name, m in told.items()]).select(F.lit(k).alias("key"), *told)
        out = row if out is None else out.union(row)
    return out


def dictionary(tables: list[DataFrame], *cols: str, name: str = "id", order: str | None = None) -> DataFrame:
    """One dictionary for several tables: each combination of the columns that any of them holds, with 1, 2, ... in the order of its
    values. With order (an expression over each table's rows, such as a time), in the order in which the combinations are first
    seen: a table's before the next one's, the least value of order first, equal ones by their values, however the tables
    are cut. Combinations with a null or NaN have no entry."""
    seen = None
    for k, df in enumerate(tables):
        rows = df.where(~_any_null(df, list(cols)))
        met = [F.lit(k).alias("_table")] + ([F.expr(order).alias("_when")] if order else [])
        part = rows.select(F.struct(*cols).alias("key"), *(met if order else []))
        seen = part if seen is None else seen.union(part)
    if order:
        keys = seen.groupBy("key").agg(F.min(F.struct("_table", "_when")).alias("_seen"))
        ids = dense_ranks(keys, ["_seen", "key"], "_id")
    else:
        ids = dense_ranks(seen.distinct(), ["key"], "_id")
    return ids.select(*[F.col("key")[c].alias(c) for c in cols], F.col("_id").alias(name))


def to_integer(df: DataFrame, *cols: str, name: str = "id", order: str | None = None, items: DataFrame | None = None) -> DataFrame:
    """df with 1, 2, ... for the distinct values of the columns in their order, or in that of their first row by order; null where one
    of them is. items: a dictionary() that is used in place of the table's own; values that it does not hold give null."""
    ids = dictionary([df], *cols, name=name, order=order) if items is None else items
    return df.join(ids, list(cols), "left")


def dims(df: DataFrame) -> tuple[int, int]:
    return df.count(), len(df.columns)


def plan_size(df: DataFrame) -> int:
    """Bytes that Spark expects the table to have."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sample_rows(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n rows by a hash of the row and the seed: the same rows however the table is cut; each task keeps n at most."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns).limit(n)


def duplicates(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")


def removable_levels(df: DataFrame, key: str, y: str | None = None) -> DataFrame:
    """Levels with one row, or with outcomes that are all 0."""
    cells = df.groupBy(F.expr(key).alias("level")).agg(F.count("*").alias("n"), *([F.min(F.expr(y)).alias("low"), F.max(F.expr(y)).alias("high")] if y else []))
    bad = (F.col("n") == 1) | ((F.col("low") == 0) & (F.col("high") == 0)) if y else F.col("n") == 1
    return cells.where(bad).select("level", "n")
