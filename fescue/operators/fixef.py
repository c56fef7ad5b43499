"""Coefficients of absorbed effects, made comparable within connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, uncut


def _components(df: DataFrame, a: str, b: str, most: int = 60) -> DataFrame:
    """level of a -> component (the least level of a that is linked through shared levels of b). Raises if it takes over most turns."""
    pairs = cut(df.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).distinct(), "pairs")
    now, last = cut(pairs.select("a").distinct().withColumn("label", F.col("a")), "labels"), None
    for _ in range(most):
        got = now.agg(F.sum(F.xxhash64("a", "label").cast("decimal(38,0)"))).first()[0]
        if got == last:
            break
        last = got
        low = pairs.join(now, "a").groupBy("b").agg(F.min("label").alias("low"))
        near = pairs.join(low, "b").groupBy("a").agg(F.min("low").alias("label"))
        jump = near.join(near.select(F.col("a").alias("label"), F.col("label").alias("far")), "label").select("a", F.col("far").alias("label"))
        after = cut(jump, "labels")
        uncut(now)
        now = after
    else:
        raise RuntimeError(f"components did not settle in {most} turns")
    uncut(pairs)
    return now


def references(model) -> list[int]:
    """Redundant levels of each effect: none of the first, of each further one as many as there are components with the first."""
    out = []
    for k, e in enumerate(model.sample.effects):
        out.append(0 if k == 0 or not e.level else _components(model.sample.df, f"_f{k}", "_f0").select("label").distinct().count())
    return out


def recover(model) -> dict[str, DataFrame]:
    s = model.sample
    tables = {blocks[0].key: (blocks, t) for blocks, t in model.effect_tables() if len(model.effect_tables()) <= len(s.effects)} if s.effects else {}
    if not tables:
        merged: dict = {}
        for blocks, t in model.effect_tables():
            merged.setdefault(blocks[0].key, []).append((blocks[0], t))
        for key, parts in merged.items():
            out = parts[0][1]
            for i, (_, t) in enumerate(parts[1:], 1):
                out = out.join(t.select("key", F.col("c0").alias(f"c{i}")), "key", "left")
            tables[key] = ([b for b, _ in parts], out)
    names, found = [f"_f{k}" for k in range(len(s.effects))], {}
    plain = len(names) > 1 and not any(b.unit for b in s.blocks)
    for k, name in enumerate(names):
        found[s.effects[k].name] = tables[name][1]
    if not plain:
        return found
    for k in range(1, len(names)):
        # In each component the least level of the further effect becomes 0, and the first effect takes its value up.
        part = _components(s.df, names[k], names[0])
        mine = found[s.effects[k].name].withColumn("a", F.col("key").cast("string")).join(part, "a")
        base = mine.groupBy("label").agg(F.min_by("c0", "a").alias("base"))
        found[s.effects[k].name] = mine.join(base, "label").select("key", (F.col("c0") - F.col("base")).alias("c0"))
        of = s.df.select(F.col(names[0]).alias("key"), F.col(names[k]).cast("string").alias("a")).distinct().join(part, "a").join(base, "label").groupBy("key").agg(F.first("base").alias("base"))
        first = found[s.effects[0].name]
        found[s.effects[0].name] = first.join(of, "key").select("key", (F.col("c0") + F.col("base")).alias("c0"))
    return found


def describe(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("n"), F.avg("c0").alias("mean"), F.var_samp("c0").alias("variance"), F.min("c0").alias("least"), F.max("c0").alias("most"))


def extremes(table: DataFrame, n: int = 5) -> DataFrame:
    """The n lowest and the n highest levels."""
    return table.orderBy("c0", "key").limit(n).union(table.orderBy(F.desc("c0"), "key").limit(n))
