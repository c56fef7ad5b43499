"""Small helpers shared by the text operators."""

from __future__ import annotations

import gc
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import cut, new_path, uncut

__all__ = ["ascii_lower", "components", "cut", "key128", "new_path", "released", "shield", "top_rows", "uncut", "words"]

#: The six ASCII white-space characters that separate words.
SPACE = " \t\n\x0b\x0c\r"
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shield(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame, list[str]], DataFrame]]:
    """docs with every column but the used ones under a name that no operator uses, and a function that puts the names back, in
    their order, with the operator's own columns after them; of columns that docs has under these names, the operator's stay."""
    rest = {c: f"__in{k}" for k, c in enumerate(docs.columns) if c not in used}

    def back(out: DataFrame, made: list[str]) -> DataFrame:
        kept = [F.col(rest[c]).alias(c) if c in rest else F.col(f"`{c}`") for c in docs.columns if c not in made]
        return out.select(*kept, *made)

    return docs.select(*[F.col(f"`{c}`").alias(rest.get(c, c)) for c in docs.columns]), back


def released(spark: SparkSession) -> None:
    """Frees the disk of shuffles that no table needs any more; Spark removes them when the driver's garbage is collected, which
    a small driver may not do for hours. What Python lets go of, the JVM learns of a little later, so it takes two rounds."""
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case and nothing else; lower() does just that where every character is one byte."""
    return F.when(F.char_length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words(c: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), SPACES), "")


def key128(*cs: Column | str) -> Column:
    """128 bits that stand for the values: two hashes of 64 bits that differ in what is hashed first."""
    return F.struct(F.xxhash64(*cs).alias("a"), F.xxhash64(F.lit(7), *cs).alias("b"))


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank", parts: int = 64) -> DataFrame:
    """The first k rows of each key in the given order, with their rank (int, from 1). A key's rows are dealt into parts by a
    hash first, so that no task ever has more of them than its part, or than parts times k."""
    first = Window.partitionBy(*keys, "__part").orderBy(*order)
    some = df.withColumn("__part", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(parts)).cast("int"))
    some = some.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= k).drop("__part", "__rank")
    return some.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of edges (u, v long): node, label (the smallest node that can be reached).

    Labels move along edges and onto the label's own node, then each label is replaced by its label's label, so the
    number of rounds grows with the logarithm of the longest path. Every round joins tables read from the shared
    folder, whose large partitions Spark can split, and pre-aggregates before it shuffles. An empty table gives none.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = cut(both.where("u <> v").distinct(), "edges")
    now = cut(e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    total = None
    for _ in range(most_rounds):
        got = now.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if got == total:
            break
        total = got
        near = e.join(now.select(F.col("node").alias("v"), "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("near"))
        best = cut(now.join(near, "node").select("node", "label", F.least("label", "near").alias("best")), "best")
        moved = best.select("node", F.col("best").alias("label")).union(best.select(F.col("label").alias("node"), F.col("best").alias("label")))
        hooked = cut(moved.groupBy("node").agg(F.min("label").alias("label")), "hooked")
        jump = hooked.alias("a").join(hooked.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.col("far").alias("label"))
        after = cut(jump, "labels")
        uncut(best, hooked, now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    uncut(e)
    return now
