"""Fixed effects taken out of columns by group sums: no dummy column is ever made.

With M the projection off the effects, x'My = x'y - x'D a, where a are the effects' coefficients for y. So the cross-products
of the columns without the effects follow from raw cross-products, group sums and coefficients; rows are only touched again
where a result has rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut, uncut
from .moments import counted_gram, gram, pseudo_inverse

#: Columns up to which the products of a single grouping are summed along with its sums.
NARROW = 8
#: Turns in which a squared residual that is near rounding error has to be halved; one that is not goes on for as long as it takes.
PATIENCE = 48
#: Share of a column's sum of squares that the effects leave below which it is absorbed a second time.
DOUBT = 1e-6
#: Rounding errors: of a sum of products, as a share of the sum of squares; of a value that coefficients were taken from.
SUMMED, ROUNDED = 1e-13, 1e-12
#: Levels of all effects but the largest up to which they are solved for exactly on the driver.
DENSE = 1_200
#: Rows of a block that stays where it is while effects are solved for in turns, and fewest rows that are worth a block.
CELLS, FEWEST = 1 << 19, 20_000


@dataclass(frozen=True)
class Block:
    """One coefficient for each value of key, for the column unit (1 where it is None)."""

    key: str
    unit: str | None = None
    effect: int = 0


@dataclass
class Absorbed:
    gram: np.ndarray
    raw: np.ndarray
    tables: list[tuple[list[Block], DataFrame]]
    cols: list[str]
    iterations: int = 0
    rows: int = 0
    levels: dict = field(default_factory=dict)  # of a key, where they were counted on the way
    noise: np.ndarray | None = None  # sums of squares up to which nothing is left of a column

    def without(self, df: DataFrame, prefix: str = "_m_", only: list[str] | None = None) -> DataFrame:
        """df with a column prefix + name for each column (of only), free of the effects. The coefficients meet the rows by key."""
        asked = [(i, c) for i, c in enumerate(self.cols) if only is None or c in only]
        out, taken = df, {c: F.col(c) for _, c in asked}
        for k, (blocks, table) in enumerate(self.tables):
            key = blocks[0].key
            named = table.select(F.col("key").alias(f"_key{k}"), *[F.col(f"a{b}_{i}").alias(f"_a{k}_{b}_{i}") for b in range(len(blocks)) for i, _ in asked])
            out = out.join(named, F.col(key) == F.col(f"_key{k}"), "left")
            for i, c in asked:
                for b, block in enumerate(blocks):
                    unit = F.col(block.unit) if block.unit else F.lit(1.0)
                    taken[c] = taken[c] - F.col(f"_a{k}_{b}_{i}") * unit
        return out.select(*df.columns, *[taken[c].alias(prefix + c) for _, c in asked])


def absorb(df: DataFrame, blocks: list[Block], cols: list[str], weight: str | None = None, tol: float = 1e-9, most: int = 2_000, dense: int = DENSE) -> Absorbed:
    """Sums of products less what the effects explain lose their digits where next to nothing of a column is left by the effects.
    Such columns are replaced by what the first coefficients leave of them, which the effects explain no less and no more,
    and are absorbed again; the coefficients of both rounds add up. What varies within a level is then found however far
    levels lie apart, with several effects, slopes and weights too. The rows are read a second time only where it is needed."""
    out = _absorb(df, blocks, cols, weight, tol, most, dense)
    whole, left = np.diag(out.raw), np.diag(out.gram)
    out.noise = SUMMED * whole
    doubt = np.flatnonzero(left < DOUBT * whole) if blocks else []
    if not len(doubt):
        return out
    again = [cols[k] for k in doubt]
    rest = out.without(df, "_left_", again)
    second = _absorb(rest.withColumns({c: F.col("_left_" + c) for c in again}).select(*df.columns), blocks, cols, weight, tol, most, dense)
    tables = []
    for held, table in second.tables:
        old = next(t for b, t in out.tables if b == held)
        names = [f"a{b}_{i}" for b in range(len(held)) for i in range(len(cols))]
        both = table.select("key", *names).join(old.select(F.col("key").alias("_old"), *[F.col(n).alias("_" + n) for n in names]), F.col("key") == F.col("_old"))
        tables.append((held, both.select("key", *[(F.col(n) + F.col("_" + n) if int(n.split("_")[1]) in doubt else F.col(n)).alias(n) for n in names])))
    # What is smaller than the rounding error of the columns as they came in is none of theirs.
    noise = SUMMED * np.diag(second.raw)
    noise[doubt] += ROUNDED**2 * whole[doubt]
    return Absorbed(second.gram, out.raw, tables, cols, out.iterations + second.iterations, out.rows, out.levels or second.levels, noise)


def _absorb(df: DataFrame, blocks: list[Block], cols: list[str], weight: str | None, tol: float, most: int, dense: int) -> Absorbed:
    keys = list(dict.fromkeys(b.key for b in blocks))
    base, df = df, df.withColumn("_wt", F.col(weight) if weight else F.lit(1.0))
    if len(keys) == 1 and len(blocks) == 1 and not blocks[0].unit and len(cols) <= NARROW:
        return _means(df, blocks[0], cols)
    raw, n = counted_gram(base, cols, weight)
    if not blocks:
        return Absorbed(raw, raw, [], cols, rows=n)
    if len(keys) == 1:
        out = _one(df, blocks, cols, raw)
    else:
        out = None if any(b.unit for b in blocks) else _exact(df, keys, cols, raw, dense)
        out = out or _iterated(df, blocks, cols, raw, n, tol, most)
    out.rows = n
    return out


def _means(df: DataFrame, block: Block, cols: list[str]) -> Absorbed:
    """One effect without slopes: products and sums of each group, and from these all that is asked for, in one pass."""
    m, w, c = len(cols), F.col("_wt"), [F.col(x) for x in cols]
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    # Written once: whatever needs the means later reads these sums, not the rows.
    cells = df.groupBy(F.col(block.key).alias("key")).agg(F.sum(w).alias("w"), F.count("*").alias("n"), *[F.sum(w * c[i]).alias(f"s{i}") for i in range(m)], *[F.sum(w * c[i] * c[j]).alias(f"p{i}_{j}") for i, j in pairs])
    cells = cut(cells, "cells")
    sums = [F.sum(f"p{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"p{i}_{j}") - F.col(f"s{i}") * F.col(f"s{j}") / F.col("w")) for i, j in pairs]
    found = cells.agg(*[s.alias(f"x{k}") for k, s in enumerate(sums)], F.count("*"), F.sum("n")).first()
    raw, left = np.zeros((m, m)), np.zeros((m, m))
    for k, (i, j) in enumerate(pairs):
        raw[i, j] = raw[j, i] = found[k] or 0.0
        left[i, j] = left[j, i] = found[len(pairs) + k] or 0.0
    table = cells.select("key", *[(F.col(f"s{i}") / F.col("w")).alias(f"a0_{i}") for i in range(m)])
    return Absorbed(left, raw, [([block], table)], cols, rows=found[-1] or 0, levels={block.key: found[-2]})


def _one(df: DataFrame, blocks: list[Block], cols: list[str], raw: np.ndarray) -> Absorbed:
    """One grouping: means, or small normal equations of each group where there are slopes."""
    unit = [F.col(b.unit) if b.unit else F.lit(1.0) for b in blocks]
    m, q, w = len(cols), len(blocks), F.col("_wt")
    sums = [F.sum(w * unit[a] * unit[b]).alias(f"u{a}_{b}") for a in range(q) for b in range(q)] + [F.sum(w * unit[b] * F.col(c)).alias(f"s{b}_{i}") for b in range(q) for i, c in enumerate(cols)]
    cells = cut(df.groupBy(F.col(blocks[0].key).alias("key")).agg(*sums), "cells")
    if q == 1:
        table = cells.select("key", *[F.try_divide(f"s0_{i}", "u0_0").alias(f"a0_{i}") for i in range(m)], *[f"s0_{i}" for i in range(m)])
    else:

        def solve(batches):
            for x in batches:
                u = np.stack([x[f"u{a}_{b}"].to_numpy() for a in range(q) for b in range(q)], axis=1).reshape(-1, q, q)
                s = np.stack([x[f"s{b}_{i}"].to_numpy() for b in range(q) for i in range(m)], axis=1).reshape(-1, q, m)
                scale = np.sqrt(np.maximum(np.einsum("gbb->gb", u), 1e-300))
                inner = np.linalg.pinv(u / scale[:, :, None] / scale[:, None, :], rcond=1e-9, hermitian=True)
                a = (inner @ (s / scale[:, :, None])) / scale[:, :, None]
                yield pd.concat([x[["key"]], pd.DataFrame(a.reshape(-1, q * m), columns=[f"a{b}_{i}" for b in range(q) for i in range(m)]), x[[f"s{b}_{i}" for b in range(q) for i in range(m)]]], axis=1)

        kind = df.schema[blocks[0].key].dataType.simpleString()
        names = [f"{x}{b}_{i}" for x in "as" for b in range(q) for i in range(m)]
        table = cells.mapInPandas(solve, f"key {kind}, " + ", ".join(f"{n} double" for n in names))
    return Absorbed(raw - _explained(table, q, m), raw, [(blocks, table)], cols)


def _explained(table: DataFrame, q: int, m: int) -> np.ndarray:
    """Sum over groups of sums times coefficients."""
    sums = [F.sum(sum((F.col(f"s{b}_{i}") * F.col(f"a{b}_{j}") for b in range(q)), F.lit(0.0))) for i in range(m) for j in range(i, m)]
    found, out, k = table.agg(*[s.alias(f"x{n}") for n, s in enumerate(sums)]).first(), np.zeros((m, m)), 0
    for i in range(m):
        for j in range(i, m):
            out[i, j] = out[j, i] = found[k] or 0.0
            k += 1
    return out


def _exact(df: DataFrame, keys: list[str], cols: list[str], raw: np.ndarray, dense: int) -> Absorbed | None:
    """Means of the largest grouping are taken out by group sums; what they leave of the other effects, a matrix with a row for
    each of their levels, is solved for on the driver. Levels that only tell components apart drop out. The rows are read
    once, into sums by combination of levels. None if the other effects have over dense levels."""
    m, spark = len(cols), df.sparkSession
    found = df.agg(*[F.approx_count_distinct(k).alias(k) for k in keys]).first()
    keys = sorted(keys, key=lambda k: -found[k])
    if sum(found[k] for k in keys[1:]) > dense:
        return None
    big, small, kinds = keys[0], keys[1:], {k: df.schema[k].dataType.simpleString() for k in keys}
    w = F.col("_wt")
    sums = [F.sum("w").alias("w")] + [F.sum(f"s{i}").alias(f"s{i}") for i in range(m)]
    every = cut(df.groupBy(*keys).agg(F.sum(w).alias("w"), *[F.sum(w * F.col(c)).alias(f"s{i}") for i, c in enumerate(cols)]), "cells")
    cells = every.groupBy(F.col(big).alias("key")).agg(*sums)
    ends, index = [], {}
    # A level of each further effect, and for each two of them the weight they share; DENSE rows or so, and their pairs.
    for k in small:
        for r in every.groupBy(F.col(k).alias("key")).agg(*sums).collect():
            index[k, r["key"]] = len(ends)
            ends.append([r["w"], *[r[f"s{i}"] for i in range(m)]])
    n, ends = len(ends), np.array(ends)
    s, b = np.diag(ends[:, 0]), ends[:, 1:]
    for x in range(len(small)):
        for y in range(x + 1, len(small)):
            for r in every.groupBy(small[x], small[y]).agg(F.sum("w").alias("w")).collect():
                i, j = index[small[x], r[0]], index[small[y], r[1]]
                s[i, j] = s[j, i] = r["w"]
    met = None
    for k in small:
        names = spark.createDataFrame([(key, i) for (who, key), i in index.items() if who == k], f"_level {kinds[k]}, l int")
        part = every.groupBy(F.col(big).alias("key"), F.col(k).alias("_level")).agg(F.sum("w").alias("n")).join(F.broadcast(names), "_level").select("key", "l", "n")
        met = part if met is None else met.union(part)
    # The largest effect's part of each level's sums and, for each two levels, a sum over the groups that have both.
    met = cut(met.join(cells, "key"), "levels")
    right = met.select("key", F.col("l").alias("l2"), F.col("n").alias("n2"))
    for r in met.groupBy("l").agg(*[F.sum(F.col("n") * F.col(f"s{i}") / F.col("w")).alias(f"b{i}") for i in range(m)]).collect():
        b[r["l"]] -= [r[f"b{i}"] for i in range(m)]
    for r in met.select("key", "l", (F.col("n") / F.col("w")).alias("share")).join(right, "key").groupBy("l", "l2").agg(F.sum(F.col("share") * F.col("n2")).alias("v")).collect():
        s[r["l"], r["l2"]] -= r["v"]
    a = pseudo_inverse(s) @ b
    named = spark.createDataFrame([(i, *map(float, a[i])) for i in range(n)], "l int, " + ", ".join(f"c{i} double" for i in range(m)))
    shift = met.join(F.broadcast(named), "l").groupBy("key").agg(*[F.sum(F.col("n") * F.col(f"c{i}") / F.col("w")).alias(f"c{i}") for i in range(m)], F.max("w").alias("w"), *[F.max(f"s{i}").alias(f"s{i}") for i in range(m)])
    table = shift.select("key", *[(F.col(f"s{i}") / F.col("w") - F.col(f"c{i}")).alias(f"a0_{i}") for i in range(m)])
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    got = cells.agg(*[F.sum(F.col(f"s{i}") * F.col(f"s{j}") / F.col("w")).alias(f"x{i}_{j}") for i, j in pairs], F.count("*")).first()
    means = np.zeros((m, m))
    for k, (i, j) in enumerate(pairs):
        means[i, j] = means[j, i] = got[k] or 0.0
    tables = [([Block(big)], table)]
    for k in small:
        rows = [(key, *map(float, a[i])) for (who, key), i in index.items() if who == k]
        tables.append(([Block(k)], spark.createDataFrame(rows, f"key {kinds[k]}, " + ", ".join(f"a0_{i} double" for i in range(m)))))
    levels = {k: sum(who == k for who, _ in index) for k in small} | {big: got[-1]}
    return Absorbed(raw - means - b.T @ a, raw, tables, cols, levels=levels)


def _local(df: DataFrame, blocks: list[Block], keys: list[str], own: str | None, cols: list[str], parts: int) -> DataFrame:
    """The rows dealt into blocks by ranges of the first key, in which levels have numbers of their own. Of a block the table has its
    combinations of levels (k is -1: weight d, the levels' numbers c, with slopes each row and its units u) and its part of every level
    (k tells the effect: number code, key, weight d, sums b). All rows of a level of own lie in one block, and the others' sums are
    less what the means of own explain. Where nothing is taken out a level may be in several blocks."""
    m, units, key_of, limit = len(cols), [k for k, b in enumerate(blocks) if b.unit], [b.key for b in blocks], 4 * CELLS
    sums = ["d", *[f"b{i}" for i in range(m)]]
    by = [F.col(keys[0])] if own else [F.col(keys[0]), F.xxhash64(*keys, *cols, *[blocks[k].unit for k in units])]
    dealt = df.select(*keys, "_wt", *cols, *[blocks[k].unit for k in units if blocks[k].unit not in cols]).repartitionByRange(parts, *by)
    w = F.col("_wt")
    named = dealt.select(
        *[F.col(k).cast("string").alias(f"c{j}") for j, k in enumerate(keys)], w.alias("d"), *[(w * F.col(c)).alias(f"b{i}") for i, c in enumerate(cols)],
        *[F.col(blocks[k].unit).cast("double").alias(f"u{k}") for k in units],
    )
    names = [f"c{j}" for j in range(len(keys))]
    fields = [("block", pa.int32()), ("k", pa.int32()), ("code", pa.int32()), ("key", pa.string()), *[(x, pa.float64()) for x in sums], *[(x, pa.int32()) for x in names], *[(f"u{k}", pa.float64()) for k in units]]
    schema = pa.schema(fields)

    def filled(n: int, **have) -> pa.Table:
        return pa.table([pa.array(have[f.name], f.type) if f.name in have else pa.nulls(n, f.type) for f in schema], schema=schema)

    def merged(held: list) -> pa.Table:
        every = pa.Table.from_batches(held) if isinstance(held[0], pa.RecordBatch) else pa.concat_tables([x if isinstance(x, pa.Table) else pa.Table.from_batches([x]) for x in held])
        if units:
            return every
        return every.group_by(names).aggregate([(x, "sum") for x in sums]).rename_columns([*names, *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size, most = TaskContext.get().partitionId(), [], 0, limit
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size > most and not units:
                # Rows of equal levels become one, so that what is held is as long as there are combinations.
                held = [merged(held)]
                size, most = held[0].num_rows, max(limit, 2 * held[0].num_rows)
        if not held:
            return
        t = merged(held)
        n, codes, values = t.num_rows, {}, {}
        for j, key in enumerate(keys):
            told = t.column(f"c{j}").combine_chunks().dictionary_encode()
            codes[key], values[key] = told.indices.to_numpy(), told.dictionary
        d = t.column("d").to_numpy()
        b = [t.column(f"b{i}").to_numpy() for i in range(m)]
        u = {k: t.column(f"u{k}").to_numpy() for k in units}
        yield from filled(n, block=np.full(n, block), k=np.full(n, -1), d=d, **{f"c{j}": codes[key] for j, key in enumerate(keys)}, **{f"u{k}": x for k, x in u.items()}).to_batches(1 << 16)
        total = {}
        if own:
            at = codes[own]
            total["d"] = np.bincount(at, d)
            left = []
            for i in range(m):
                total[f"b{i}"] = np.bincount(at, b[i])
                mean = np.divide(total[f"b{i}"], total["d"], out=np.zeros_like(total["d"]), where=total["d"] > 0)
                left.append(b[i] - d * mean[at])
            b, k = left, key_of.index(own)
            yield from filled(len(total["d"]), block=np.full(len(total["d"]), block), k=np.full(len(total["d"]), k), code=np.arange(len(total["d"])), key=values[own], **total).to_batches(1 << 16)
        for k, key in enumerate(key_of):
            if key == own:
                continue
            at, unit, size = codes[key], u.get(k, 1.0), len(values[key])
            part = {"d": np.bincount(at, d * unit * unit, size), **{f"b{i}": np.bincount(at, b[i] * unit, size) for i in range(m)}}
            yield from filled(size, block=np.full(size, block), k=np.full(size, k), code=np.arange(size), key=values[key], **part).to_batches(1 << 16)

    kinds = {pa.int32(): "int", pa.string(): "string", pa.float64(): "double"}
    return named.mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in schema))


def _passes(blocks: list[Block], keys: list[str], taken: int, m: int):
    """What a block's task does with its cells and the coefficients met (k, key, code, p) of their levels: turn() gives the sums by level
    (k, key, q) of what the coefficients say, less its means by level of effect taken; means() gives these (block, code, t)."""
    column, slope = [f"c{keys.index(b.key)}" for b in blocks], [bool(b.unit) for b in blocks]

    def share(x: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.divide(x, d, out=np.zeros_like(x), where=d > 0)

    def said(cells: pd.DataFrame, met: pd.DataFrame) -> tuple[list, list, np.ndarray, np.ndarray]:
        codes = [cells[c].to_numpy() for c in column]
        units = [cells[f"u{k}"].to_numpy() if x else 1.0 for k, x in enumerate(slope)]
        t = np.zeros((m, len(cells)))
        for k, part in met.groupby("k"):
            x, code = np.zeros(codes[k].max() + 1), part["code"].to_numpy()
            for i in range(m):
                x[code] = part[f"p{i}"].to_numpy()
                t[i] += units[k] * x[codes[k]]
        return codes, units, cells["d"].to_numpy(), t

    def turn(cells: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        codes, units, d, t = said(cells, met)
        if taken >= 0:
            at = codes[taken]
            total = np.bincount(at, d)
            for i in range(m):
                t[i] -= share(np.bincount(at, d * t[i]), total)[at]
        out = [pd.DataFrame({"k": [], "key": [], **{f"q{i}": [] for i in range(m)}})] if met.empty else []
        for k, part in met.groupby("k"):
            code = part["code"].to_numpy()
            out.append(part[["k", "key"]].assign(**{f"q{i}": np.bincount(codes[k], d * units[k] * t[i], code.max() + 1)[code] for i in range(m)}))
        return pd.concat(out)

    def means(cells: pd.DataFrame, met: pd.DataFrame) -> pd.DataFrame:
        codes, _, d, t = said(cells, met)
        total = np.bincount(codes[taken], d)
        return pd.DataFrame({"block": np.full(len(total), cells["block"].iloc[0]), "code": np.arange(len(total)), **{f"t{i}": share(np.bincount(codes[taken], d * t[i]), total) for i in range(m)}})

    return turn, means


def _iterated(df: DataFrame, blocks: list[Block], cols: list[str], raw: np.ndarray, n: int, tol: float, most: int) -> Absorbed:
    """Conjugate gradients on the effects' normal equations, scaled by their diagonal, for all columns at once. Without slopes the
    effect with the most levels is taken out by its means, and the vectors are tables with a row for each coefficient of the
    others; with slopes, for each coefficient. The rows are read into blocks once (_local), which stay where they are: a turn
    sends each block the coefficients of the levels that it has, gets its sums by level back and writes one table. So a turn
    shuffles a row for each level in each block, never the rows. Raises RuntimeError where the goal is not met."""
    m, w, slopes, spark = len(cols), F.col("_wt"), any(b.unit for b in blocks), df.sparkSession
    level = next((k for k, b in enumerate(blocks) if not b.unit), None)
    shift = [0.0] * m
    if level is not None:
        # The common mean is taken out first; the sums that follow are then of the size of what is looked for.
        shift = [x or 0.0 for x in df.agg(*[F.sum(w * F.col(c)) / F.sum(w) for c in cols]).first()]
        df = df.withColumns({c: F.col(c) - x for c, x in zip(cols, shift)})
    centred = gram(df, cols, "_wt")
    keys = list(dict.fromkeys(b.key for b in blocks))
    found = df.agg(*[F.approx_count_distinct(k).alias(k) for k in keys]).first()
    keys = sorted(keys, key=lambda k: -found[k])
    own = None if slopes else keys[0]
    parts = max(1, -(-n // CELLS), min(spark.sparkContext.defaultParallelism, n // FEWEST))
    whole = cut(_local(df, blocks, keys, own, cols, parts), "keys")
    cells = whole.where("k = -1").select("block", "d", *[f"c{j}" for j in range(len(keys))], *[f"u{k}" for k, b in enumerate(blocks) if b.unit])
    cells = cells.repartition(parts, "block").sortWithinPartitions("block").persist()
    # Of the effect that is taken out; -1 where none is.
    taken = next((k for k, b in enumerate(blocks) if b.key == own), -1)
    parted = whole.where(f"k >= 0 and k <> {taken}")
    sums = [F.sum(x).alias(x) for x in ("d", *[f"b{i}" for i in range(m)])]
    start = parted.groupBy("k", "key").agg(*sums).where("d > 0")
    v = cut(start.select("k", "key", "d", *[f"b{i}" for i in range(m)], *[F.col(f"b{i}").alias(f"r{i}") for i in range(m)], *[(F.col(f"b{i}") / F.col("d")).alias(f"p{i}") for i in range(m)], *[F.lit(0.0).alias(f"x{i}") for i in range(m)]), "vectors")
    places = cut(parted.select("k", "key", "block", "code"), "places")
    turn, means = _passes(blocks, keys, taken, m)

    def through(of: str, run, schema: str) -> DataFrame:
        sent = v.select("k", "key", *[F.col(f"{of}{i}").alias(f"p{i}") for i in range(m)]).join(places, ["k", "key"])
        return cells.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(run, schema)

    rr = v.agg(*[F.sum(F.col(f"r{i}") * F.col(f"r{i}") / F.col("d")).alias(f"z{i}") for i in range(m)]).first()
    now = np.array([rr[i] or 0.0 for i in range(m)])
    # What is a trillionth of a column or less is rounding error, whatever share of it the effects explain.
    goal, turns, best = np.maximum(np.maximum(now * tol**2, np.diag(centred) * 1e-24), 1e-280), 0, [now.copy()]
    close, failed = lambda x: x <= 1e3 * goal, np.zeros(m, bool)
    while (now > goal).any() and turns < most:
        if turns > PATIENCE and close(best[-1]).all() and (best[-1] > 0.5 * best[-1 - PATIENCE])[now > goal].all():
            break
        q = through("p", turn, "k int, key string, " + ", ".join(f"q{i} double" for i in range(m))).groupBy("k", "key").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(m)])
        step = cut(v.join(q, ["k", "key"]), "vectors")
        found = np.array([x or 0.0 for x in step.agg(*[F.sum(F.col(f"p{i}") * F.col(f"q{i}")).alias(f"z{i}") for i in range(m)]).first()])
        failed |= (now > goal) & (found <= 0) & ~close(now)
        live = (now > goal) & (found > 0)
        a = np.where(live, now / np.where(live, found, 1), 0.0)
        size = [F.sum((F.col(f"r{i}") - float(a[i]) * F.col(f"q{i}")) ** 2 / F.col("d")).alias(f"z{i}") for i in range(m)]
        after = np.array([x or 0.0 for x in step.agg(*size).first()])
        beta = np.where(live, after / np.where(now > 0, now, 1), 0.0)
        old = v
        r = [F.col(f"r{i}") - float(a[i]) * F.col(f"q{i}") for i in range(m)]
        v = step.select("k", "key", "d", *[f"b{i}" for i in range(m)], *[r[i].alias(f"r{i}") for i in range(m)], *[(r[i] / F.col("d") + float(beta[i]) * F.col(f"p{i}")).alias(f"p{i}") for i in range(m)], *[(F.col(f"x{i}") + float(a[i]) * F.col(f"p{i}")).alias(f"x{i}") for i in range(m)])
        v._cut_path = step._cut_path
        uncut(old)
        now, turns = np.where(live, after, now * 0), turns + 1
        best.append(np.minimum(best[-1], now))
    failed |= (now > goal) & ~close(best[-1])
    if failed.any():
        cells.unpersist()
        uncut(whole, places)
        raise RuntimeError(f"the effects of {', '.join(c for c, x in zip(cols, failed) if x)} are not solved for after {turns} turns: squared residuals of {best[-1] / np.maximum(best[0], 1e-280)} of the start")
    explained = _explained(v.select(*[F.col(f"b{i}").alias(f"s0_{i}") for i in range(m)], *[F.col(f"x{i}").alias(f"a0_{i}") for i in range(m)]), 1, m)
    solved = {k: v.where(F.col("k") == k).select("key", *[f"x{i}" for i in range(m)]) for k in range(len(blocks)) if k != taken}
    if own:
        levels = whole.where(f"k = {taken} and d > 0")
        explained += _explained(levels.select(*[F.col(f"b{i}").alias(f"s0_{i}") for i in range(m)], *[(F.col(f"b{i}") / F.col("d")).alias(f"a0_{i}") for i in range(m)]), 1, m)
        given = through("x", means, "block int, code int, " + ", ".join(f"t{i} double" for i in range(m)))
        solved[taken] = cut(levels.join(given, ["block", "code"]).select("key", *[(F.col(f"b{i}") / F.col("d") - F.col(f"t{i}")).alias(f"x{i}") for i in range(m)]), "levels")
    cells.unpersist()
    uncut(whole, places)
    tables = []
    for k, b in enumerate(blocks):
        kind = df.schema[b.key].dataType
        tables.append(([b], solved[k].select(F.col("key").cast(kind).alias("key"), *[(F.col(f"x{i}") + float(shift[i] if k == level else 0.0)).alias(f"a0_{i}") for i in range(m)])))
    return Absorbed(centred - explained, raw, tables, cols, turns)
