"""Columns made from columns: factors and their interactions, bins, cuts, panel lags. Levels are found by one distinct job."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from math import floor

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import dense_ranks, grid, quantiles

#: A factor with more levels than this is meant as a fixed effect.
MOST_LEVELS = 5_000


def literal(value) -> Column:
    return F.lit(value)


def levels(df: DataFrame, c: Column | str, most: int = MOST_LEVELS) -> list:
    """Sorted distinct values, nulls apart; an error where there are more than most."""
    col = F.col(c) if isinstance(c, str) else c
    found = [r[0] for r in df.select(col.alias("v")).where("v is not null").distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"over {most} levels; absorb it as a fixed effect instead")
    return sorted(found)


def _unquote(x: str):
    x = x.strip()
    if x[:1] in "'\"":
        return x[1:-1]
    try:
        return int(x)
    except ValueError:
        try:
            return float(x)
        except ValueError:
            return x


def value_list(text: str | None) -> list:
    """c(1, 'a', 3:5) or one value."""
    if text is None:
        return []
    from ..plans.formula import call, split_top

    c = call(text.strip())
    out = []
    for x in c[1] if c and c[0] == "c" else split_top(text, ","):
        if m := re.fullmatch(r"\s*(-?\d+)\s*:\s*(-?\d+)\s*", x):
            out += list(range(int(m[1]), int(m[2]) + 1))
        else:
            out.append(_unquote(x))
    return out


def label(value) -> str:
    return str(int(value)) if isinstance(value, float) and value == floor(value) else str(value)


def factor_columns(df: DataFrame, f: str, var: str | None = None, ref=None, keep=None, bin=None, ref2=None, keep2=None, factor2: bool = False, auto_ref: bool = False) -> list[tuple[str, Column]]:
    """Named columns f::level, f::level:var or f::level:g::level2; ref leaves a level out, auto_ref the first one."""
    base = F.expr(f)
    if bin is not None:
        base, found = bin_column(df, base, bin)
    else:
        found = levels(df, base)
    gone = ref if isinstance(ref, list) else [ref] if ref is not None else []
    gone = [found[0]] if auto_ref and not gone and found else gone
    chosen = [v for v in found if label(v) not in {label(x) for x in gone} and (not keep or any(label(k) == label(v) or isinstance(k, str) and k.startswith("@") and re.search(k[1:], label(v)) for k in keep))]
    if var is None:
        return [(f"{f}::{label(v)}", (base == F.lit(v)).cast("double")) for v in chosen]
    if not factor2:
        kind = df.select(F.expr(var).alias("v")).schema["v"].dataType.simpleString()
        factor2 = kind == "string"
    if not factor2:
        return [(f"{f}::{label(v)}:{var}", F.when(base == F.lit(v), F.expr(var).cast("double")).otherwise(F.when(base.isNotNull(), 0.0))) for v in chosen]
    second = [v for v in levels(df, F.expr(var)) if label(v) not in {label(x) for x in (ref2 or [])} and (not keep2 or label(v) in {label(x) for x in keep2})]
    return [(f"{f}::{label(a)}:{var}::{label(b)}", ((base == F.lit(a)) & (F.expr(var) == F.lit(b))).cast("double")) for a in chosen for b in second]


def bin_column(df: DataFrame, c: Column | str, how) -> tuple[Column, list]:
    """The column with values put together, and its levels.

    how: {name: values}, a list of values (named by the first), 'bin::k' (floor(x / k) * k), '!bin::k' and '!!bin::k' (k
    neighbouring distinct values, counted from the first or the last), 'cut::...' (see cut_column), '@regex', or several of
    them in a list. A value in two bins is an error."""
    col = F.col(c) if isinstance(c, str) else c
    if isinstance(how, str) and how.startswith("bin::"):
        k = float(how[5:])
        out = F.floor(col / k) * (int(k) if k == floor(k) else k)
        return out, levels(df, out)
    if isinstance(how, str) and how.startswith("cut::"):
        out = cut_column(df, col, how[5:])
        return out, levels(df, out)
    found = levels(df, col)
    if isinstance(how, str) and (m := re.fullmatch(r"(!!?)bin::(\d+)", how)):
        order, k = (found if m[1] == "!" else found[::-1]), int(m[2])
        groups = {order[i]: order[i : i + k] for i in range(0, len(order), k)}
    else:
        groups = {}
        asked = how if isinstance(how, dict) else {None: how} if not isinstance(how, list) or not any(isinstance(x, (list, dict)) or isinstance(x, str) and x.startswith("@") for x in how) else dict(enumerate(how))
        for name, want in asked.items():
            want = want if isinstance(want, list) else [want]
            picked = [v for v in found if any(v == w or isinstance(w, str) and w.startswith("@") and re.search(w[1:], str(v)) for w in want)]
            if picked:
                groups[name if isinstance(name, str) else next((w for w in want if w in picked), picked[0])] = picked
    used = [v for g in groups.values() for v in g]
    if len(used) != len(set(used)):
        raise ValueError("a value is in two bins")
    as_text = any(type(n) is not type(found[0]) for n in groups) if found else False
    rest = col.cast("string") if as_text else col
    out = None
    for name, values in groups.items():
        hit, to = col.isin(*values), F.lit(str(name) if as_text else name)
        out = F.when(hit, to) if out is None else out.when(hit, to)
    out = rest if out is None else out.otherwise(rest)
    return out, levels(df, out)


def ref_levels(df: DataFrame, c: Column | str, ref) -> tuple[Column, list]:
    """The column with the values of ref (one, or a list put together as in bin_column) and its levels, ref first."""
    out, found = bin_column(df, c, ref if isinstance(ref, (list, dict)) else [ref])
    first = (next(iter(ref)) if isinstance(ref, dict) else ref[0]) if isinstance(ref, (list, dict)) else ref
    return out, [first, *[v for v in found if v != first]]


def orthogonal(df: DataFrame, value: Column, degree: int) -> list[Column]:
    """Polynomials of value of degree 1 to degree that are orthogonal to each other and to a constant over the rows, with squares that
    add up to 1 and positive leading coefficients. Each comes from the two before it by the three-term recurrence, whose numbers
    are two sums over the rows, so there is a pass for each degree. Nulls, NaN and infinities do not count and stay what they are."""
    rows = df.select(value.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    n, centre, spread = rows.agg(F.count("*"), F.avg("v"), F.stddev_pop("v")).first()
    if not spread:
        raise ValueError("a polynomial needs values that differ")
    z = (value - centre) / spread
    rows = rows.select(((F.col("v") - centre) / spread).alias("z"))

    def at(p: np.ndarray, x: Column) -> Column:
        out = F.lit(float(p[-1]))
        for a in p[-2::-1]:
            out = out * x + float(a)
        return out

    before, p, size_before, size, shift = np.zeros(1), np.ones(1), 1.0, float(n), 0.0
    out = []
    for k in range(1, degree + 1):
        longer = np.append(0.0, p)
        longer[: len(p)] -= shift * p
        longer[: len(before)] -= (size / size_before if k > 1 else 0.0) * before
        before, p, size_before = p, longer, size
        value_k = at(p, F.col("z"))
        size, first = rows.agg(F.sum(value_k * value_k), F.sum(F.col("z") * value_k * value_k)).first()
        if size < 1e-12 * n:
            raise ValueError(f"a polynomial of degree {degree} needs more than {k} distinct values")
        shift = first / size
        out.append(at(p, z) / float(np.sqrt(size)))
    return out


def cut_points(df: DataFrame, c: Column, how: str) -> list[tuple[float, bool]]:
    """Upper bounds and whether they belong to the bin: a number of bins of equal counts, or values, q1 (quartiles) and p20
    (percentiles, by linear interpolation) that end in ] (inclusive) or [ (exclusive)."""
    if how.strip().isdigit():
        n = int(how)
        asked = [(("p", 100 * k / n), True) for k in range(1, n)]
    else:
        asked = [((m[1] or "", float(m[2])), m[3] == "]") for m in re.finditer(r"([pq]?)(-?[\d.]+)\s*([\]\[])", how if how[-1] in "[]" else how + "]")]
    shares = [v / (4 if kind == "q" else 100) for (kind, v), _ in asked if kind]
    got = iter(quantiles(df, c, shares) if shares else [])
    bounds = {(next(got) if kind else v, inside) for (kind, v), inside in asked}
    return sorted((b for b in bounds if b[0] is not None), key=lambda x: (x[0], x[1]))


def cut_column(df: DataFrame, c: Column | str, how: str) -> Column:
    """Bins labelled by the least and the largest value they hold: a-b for whole numbers, else [a; b]. Empty bins vanish."""
    col = F.col(c) if isinstance(c, str) else c
    bounds, place = cut_points(df, col, how), None
    for k, (v, inside) in enumerate(bounds):
        hit = col <= v if inside else col < v
        place = F.when(hit, k) if place is None else place.when(hit, k)
    place = place.otherwise(F.when(col.isNotNull(), len(bounds))) if place is not None else F.lit(0)
    ends = df.select(place.alias("k"), col.alias("v")).where("k is not null and v is not null").groupBy("k").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("k").collect()
    whole = all(float(r[x]).is_integer() for r in ends for x in ("a", "b"))
    out = None
    for r in ends:
        name = f"{label(r['a'])}-{label(r['b'])}" if whole else f"[{r['a']}; {r['b']}]"
        out = F.when(place == r["k"], name) if out is None else out.when(place == r["k"], name)
    return out if out is not None else F.lit(None).cast("string")


@dataclass
class Panel:
    """Rows of units over time. step: 'unitary' (the greatest common divisor of the steps), 'consecutive' (one period to the
    next that is found anywhere), 'within.consecutive' (in the unit), or a number that divides all steps."""

    df: DataFrame
    id: str
    time: str
    step: str | float | None = None
    duplicates: str = "error"
    made: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        kind = self.df.schema[self.time].dataType.typeName()
        numeric = kind in ("integer", "long", "short", "byte", "double", "float", "decimal")
        step = self.step or ("unitary" if numeric else "consecutive")
        n = self.df.groupBy(self.id, self.time).count().where("count > 1")
        if self.duplicates == "first":
            order = [F.xxhash64(*self.df.columns), *[c for c in self.df.columns if c not in (self.id, self.time)]]
            self.df = self.df.withColumn("_k", F.row_number().over(Window.partitionBy(self.id, self.time).orderBy(*order))).where("_k = 1").drop("_k")
        elif n.limit(1).count():
            raise ValueError(f"{self.id} and {self.time} do not tell the rows apart")
        if step == "within.consecutive":
            self.df = self.df.withColumn("_t", F.row_number().over(Window.partitionBy(self.id).orderBy(self.time)).cast("long"))
        elif step == "consecutive":
            times = self.df.select(self.time).where(F.col(self.time).isNotNull()).distinct()
            self.df = self.df.join(dense_ranks(times, [self.time], "_t"), self.time, "left")
        else:
            t = F.col(self.time).cast("double") if numeric else F.unix_date(F.col(self.time)).cast("double")
            if step == "unitary":
                start, unit = grid(self.df, t)
            else:
                start, unit = self.df.select(F.min(t)).first()[0] or 0.0, float(step)
            place = (t - start) / unit
            if step != "unitary" and self.df.where(F.abs(place - F.round(place)) > 1e-9).limit(1).count():
                raise ValueError(f"steps are not multiples of {unit}")
            self.df = self.df.withColumn("_t", F.round(place).cast("long"))

    def lag(self, expr: str, k: int = 1, name: str | None = None, fill=None) -> Panel:
        """The value just k periods before (after, where k is negative); null where that period is missing. The rows of a unit
        are ordered once and a window of periods is looked through, so nothing is joined."""
        name = name or f"l({expr}, {k})"
        if k == 0:
            return self._with(name, F.expr(expr))
        w = Window.partitionBy(self.id).orderBy("_t").rangeBetween(-k, -k)
        got = F.first(F.expr(expr)).over(w)
        if fill is not None:
            got = F.when(F.count(F.lit(1)).over(w) == 0, F.lit(fill)).otherwise(got)
        return self._with(name, got)

    def lead(self, expr: str, k: int = 1, name: str | None = None, fill=None) -> Panel:
        return self.lag(expr, -k, name or f"f({expr}, {k})", fill)

    def diff(self, expr: str, k: int = 1, name: str | None = None) -> Panel:
        name = name or f"d({expr}, {k})"
        out = self.lag(expr, k, "_d")
        return out._with(name, F.expr(expr) - F.col("_d"), drop="_d")

    def _with(self, name: str, c: Column, drop: str | None = None) -> Panel:
        df = self.df.withColumn(name, c)
        out = object.__new__(Panel)
        out.__dict__ = self.__dict__ | {"df": df.drop(drop) if drop else df, "made": self.made | {name: True}}
        return out

    def data(self) -> DataFrame:
        return self.df.drop("_t")
