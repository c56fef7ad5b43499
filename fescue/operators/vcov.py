"""Covariance matrices of coefficients. Scores are summed by cluster, period or place in Spark; what comes back is K by K."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import floor, inf, log10

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.order import dense_ranks, quantiles
from ..functions.special import great_circle_km
from ..sources.shared import cut, uncut
from .moments import gram

#: Kilometres of a degree of latitude, of a mile, and the sphere's radius that the kernel uses.
DEGREE, MILE, RADIUS = 111.0, 1.60934, 6376.0
#: Cells that a box of the cutoff's size is cut into, each way.
FINE = 16


@dataclass(frozen=True)
class Ssc:
    """Small-sample corrections. adj: (n - 1) / (n - K). fixef_K: which effects count in K (none, nested: not those nested in a
    cluster, full). cluster_adj and cluster_df: G / (G - 1) of each term, or of the smallest. t_df: min, conventional or a
    number. exact: count the effects' redundant levels instead of one for each further effect."""

    adj: bool = True
    fixef_K: str = "nested"
    cluster_adj: bool = True
    cluster_df: str = "min"
    t_df: str | int = "min"
    exact: bool = False


DEFAULTS = {"ssc": Ssc(), "no_FE": "iid", "with_FE": "cluster", "panel": "cluster"}


@dataclass(frozen=True)
class Vcov:
    kind: str
    vars: tuple[str, ...] = ()
    lag: int | None = None
    cutoff: float | str | None = None
    pixel: float = 0.0
    distance: str = "triangular"
    ssc: Ssc | None = None


def iid() -> Vcov:
    return Vcov("iid")


def hetero() -> Vcov:
    return Vcov("hetero")


def cluster(*names: str, ssc: Ssc | None = None) -> Vcov:
    return Vcov("cluster", names, ssc=ssc)


def newey_west(unit: str | None = None, time: str | None = None, lag: int | None = None, ssc: Ssc | None = None) -> Vcov:
    return Vcov("NW", tuple(x for x in (unit, time) if x), lag, ssc=ssc)


def driscoll_kraay(time: str | None = None, lag: int | None = None, ssc: Ssc | None = None) -> Vcov:
    return Vcov("DK", (time,) if time else (), lag, ssc=ssc)


def conley(cutoff: float | str | None = None, lat: str = "lat", lon: str = "lon", pixel: float = 0.0, distance: str = "triangular", ssc: Ssc | None = None) -> Vcov:
    return Vcov("conley", (lat, lon), cutoff=cutoff, pixel=pixel, distance=distance, ssc=ssc)


WAYS = {"twoway": 2, "threeway": 3, "fourway": 4}


def request(kind, model) -> Vcov:
    """A Vcov for a name, a formula such as '~cl1 + cl2' or 'NW(2) ~ id + time', or None (the default for the model)."""
    if isinstance(kind, Vcov):
        return kind
    effects = [e for e in model.sample.effects if e.level]
    if kind is None:
        if model.panel:
            kind = DEFAULTS["panel"]
        else:
            one = bool(effects) and model.sizes[model.sample.effects.index(effects[0])] == 1
            kind = DEFAULTS["with_FE"] if effects and not one else DEFAULTS["no_FE"]
    name, _, right = str(kind).partition("~")
    names = tuple(x.strip() for x in right.split("+") if x.strip())
    name = name.strip()
    arg = re.fullmatch(r"(\w+)\((.*)\)", name)
    base = (arg[1] if arg else name) or "cluster"
    low = base.lower()
    if low in ("iid", "standard"):
        return Vcov("iid")
    if low in ("hetero", "white", "hc1"):
        return Vcov("hetero")
    if low in ("hc2", "hc3"):
        return Vcov(low)
    if low == "cluster" or low in WAYS:
        n = WAYS.get(low, max(len(names), 1))
        if not names:
            names = (model.panel[0],) if model.panel and n == 1 else tuple("^".join(e.keys) for e in effects[:n])
        if len(names) < n:
            raise ValueError(f"{base} needs {n} cluster variables")
        return Vcov("cluster", names)
    names = names or (tuple(model.panel[:2]) if model.panel else ())
    if low in ("nw", "newey_west"):
        return Vcov("NW", names, int(arg[2]) if arg and arg[2] else None)
    if low in ("dk", "driscoll_kraay"):
        return Vcov("DK", names[-1:], int(arg[2]) if arg and arg[2] else None)
    if low == "conley":
        return Vcov("conley", names or ("lat", "lon"), cutoff=arg[2].strip("'\"") if arg and arg[2] else None)
    raise ValueError(f"no such covariance: {kind}")


def _expr(name: str) -> Column:
    parts = name.split("^")
    return F.expr(name) if len(parts) == 1 else F.concat_ws("_", *[F.expr(p).cast("string") for p in parts])


def parameters_counted(model, names: tuple[str, ...], ssc: Ssc) -> float:
    """K of the adjustment."""
    s = model.sample
    sizes = [n if e.level else 0 for n, e in zip(model.sizes, s.effects)]
    total, q, k = sum(sizes), sum(n > 0 for n in sizes), model.nparams
    if not total:
        return k
    if ssc.fixef_K == "none":
        return k - (total - (q - 1))
    nested = []
    if ssc.fixef_K == "nested" and names:
        for i, e in enumerate(s.effects):
            if not sizes[i]:
                continue
            own = "^".join(e.keys)
            inside = own in names or any(p in names for p in e.keys)
            for v in names if not inside else ():
                per = s.df.select(F.col(f"_f{i}").alias("f"), _expr(v).alias("v")).groupBy("f").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a <> b").limit(1).count()
                inside = inside or per == 0
            if inside:
                nested.append(i)
    if ssc.fixef_K == "full" or not nested:
        return k + (q - 1) - sum(_references(model)) if ssc.exact else k
    if len(nested) == q:
        out = k - (total - (q - 1)) + 1
    elif ssc.exact:
        ref = _references(model)
        inner = sum(sizes[i] - (ref[i] if len(nested) == 1 else 0) for i in nested)
        out = k + (q - 1) - sum(ref) - inner + len(nested) * 0
    else:
        out = k - (sum(sizes[i] for i in nested) - len(nested))
    return max(out, len(model.names) + 1)


def _references(model) -> list[int]:
    """Redundant levels of each effect."""
    from .fixef import references

    return references(model)


def _outer(df: DataFrame, k: int) -> np.ndarray:
    return gram(df, [f"_g{i}" for i in range(k)])


def _blocks(cells: DataFrame, reach: int) -> DataFrame:
    """cells in blocks of consecutive ranks; a block is also handed the reach ranks before it, whose rows are not its own."""
    size = max(4 * reach, 1024)
    own, last = F.floor(F.col("_rank") / size), F.floor((F.col("_rank") + reach) / size)
    return cells.withColumn("_block", F.explode(F.sequence(own, last))).withColumn("_own", F.col("_block") == own)


def _lagged(cells: DataFrame, k: int, lag: int, unit: list[str]) -> np.ndarray:
    """Sum over lags, with Bartlett weights, of products of sums by (unit and) rank of period. What the lags before a row weigh
    together comes from two sums over them, of the scores and of the scores times their distance."""
    names, out = [f"_g{i}" for i in range(k)], _outer(cells, k)
    if lag < 1:
        return out
    w = Window.partitionBy(*unit, "_block").orderBy("_rank").rangeBetween(-lag, -1)
    # Places count within the block, so that the two sums do not cancel far from the first period.
    place = (F.col("_rank") - F.col("_block") * max(4 * lag, 1024)) / F.lit(lag + 1.0)
    rows = _blocks(cells, lag).withColumn("_near", place)
    before = {f"_b{c}": (1 - F.col("_near")) * F.sum(c).over(w) + F.sum(F.col(c) * F.col("_near")).over(w) for c in names}
    both = rows.select("_own", *names, *[x.alias(c) for c, x in before.items()]).where("_own")
    g = np.array([x or 0.0 for x in both.agg(*[F.sum(F.col(a) * F.col(f"_b{b}")) for a in names for b in names]).first()]).reshape(k, k)
    return out + g + g.T


def _ranked(scores: DataFrame, time: str, k: int, unit: str | None) -> tuple[DataFrame, int]:
    keys = [_expr(unit).alias("_unit")] if unit else []
    cells = scores.groupBy(*keys, _expr(time).alias("_time")).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(k)])
    # Each period gets its rank, so gaps in the calendar do not count.
    ranks = dense_ranks(cells.select("_time").distinct(), ["_time"], "_rank")
    return cells.join(ranks, "_time"), ranks.count()


def _bandwidth(cells: DataFrame, names: list[str], t: int) -> int:
    """Newey and West's (1994) plug-in for the Bartlett kernel, of scores that a first-order autoregression has whitened; the intercept
    does not count unless it is alone.

    The autoregression comes from products of neighbouring periods. Its residuals, added up over the scores, are u(t) - v(t - 1)
    with u the sum of a period's scores and v a weighted one, so two numbers for each period are looked at further."""
    use = [f"_g{i}" for i, n in enumerate(names) if n != "(Intercept)"] or ["_g0"]
    k, m = len(use), floor(3 * (t / 100) ** (2 / 9))
    w = lambda j: Window.partitionBy("_block").orderBy("_rank").rangeBetween(-j, -j)
    met = _blocks(cells.select("_rank", *use), 1).select("_own", *use, *[F.first(c).over(w(1)).alias(f"_b{c}") for c in use]).where(F.col("_own") & F.col(f"_b{use[0]}").isNotNull())
    sums = met.agg(*[F.sum(F.col(a) * F.col(f"_b{b}")) for a in use for b in use], *[F.sum(F.col(f"_b{a}") * F.col(f"_b{b}")) for a in use for b in use]).first()
    if sums[0] is None:
        return 0
    ahead, before = (np.array(sums[i : i + k * k], float).reshape(k, k) for i in (0, k * k))
    pull = np.linalg.lstsq(before, ahead.T, rcond=None)[0].T.sum(axis=0)
    u = sum((F.col(c) for c in use), F.lit(0.0))
    v = sum((float(p) * F.col(c) for p, c in zip(pull, use)), F.lit(0.0))
    rows = _blocks(cells.select("_rank", u.alias("u"), v.alias("v")), m + 1).withColumn("h", F.col("u") - F.first("v").over(w(1)))
    late = rows.select("_own", "h", *[F.first("h").over(w(j)).alias(f"h{j}") for j in range(1, m + 1)]).where("_own")
    got = late.agg(F.sum(F.col("h") * F.col("h")), *[F.sum(F.col("h") * F.col(f"h{j}")) for j in range(1, m + 1)]).first()
    s = [(x or 0.0) / (t - 1) for x in got]
    s0, s1 = s[0] + 2 * sum(s[1:]), 2 * sum(j * x for j, x in enumerate(s))
    return max(0, floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * t ** (1 / 3))) if s0 else 0


def cutoff_km(value: float | str) -> float:
    m = re.fullmatch(r"\s*([\d.]+)\s*(mi\w*|m|km?|)\s*", str(value))
    if not m:
        raise ValueError(f"not a distance: {value}")
    return float(m[1]) * (MILE if m[2].startswith("m") else 1.0)


def _followed(points: DataFrame, order: tuple[str, str]) -> DataFrame:
    """points in ranges of the order, with the smallest distance (d) to the three places that follow each. A range is handed the
    three first places after it; no more than three of each range reach the driver."""
    dealt = cut(points.select("_lat", "_lon").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "places")
    w = Window.partitionBy("_part").orderBy(*order)
    ahead = sorted(dealt.withColumn("_n", F.row_number().over(w)).where("_n <= 3").select("_part", "_n", "_lat", "_lon").collect())
    after = [(r["_lat"], r["_lon"], part) for part in {r["_part"] for r in ahead} for r in [x for x in ahead if x["_part"] > part][:3]]
    after = points.sparkSession.createDataFrame(after, "_lat double, _lon double, _part int")
    rows = dealt.withColumn("_own", F.lit(True)).unionByName(after.withColumn("_own", F.lit(False)))
    near = F.least(*[great_circle_km(F.col("_lat"), F.col("_lon"), F.lead("_lat", j).over(w), F.lead("_lon", j).over(w)) for j in (1, 2, 3)])
    return rows.withColumn("d", near).where("_own").select("_part", "_lat", "_lon", "d")


def default_cutoff(points: DataFrame) -> float:
    """Median of the smallest distance to three neighbours in the order of latitude and then in that of longitude, the two
    medians added up and floored to two digits."""
    total = 0.0
    for order in (("_lat", "_lon"), ("_lon", "_lat")):
        total += quantiles(_followed(points, order), "d", [0.5])[0] or 0.0
    if not total:
        raise ValueError("give a cutoff")
    unit = 10 ** (floor(log10(total)) - 1)
    return floor(total / unit) * unit


def _boxes(reach: float):
    """Functions of columns: the band of a latitude, and the place of a longitude in boxes of that band, as real numbers. A band is
    reach high, and a box as wide as reach is where a degree of longitude is shortest in the band or its neighbours."""
    step = reach / DEGREE
    edge = lambda b: F.least(F.greatest(F.abs(b - 1), F.abs(b + 2)) * step, F.lit(89.5))
    return (lambda lat: lat / step), (lambda lon, b: lon / (step / F.cos(F.radians(edge(b)))))


def _apart(low: dict, high: dict, distance: str) -> tuple[Column, Column]:
    """Least and largest distance between two rectangles, of latitudes and longitudes from low to high, in degrees (spherical: in
    kilometres); the same number for two points. Longitudes count up to half a turn."""
    spread = lambda c: (low[c][0] - high[c][1], high[c][0] - low[c][1])
    (south, north), (west, east) = spread("lat"), spread("lon")
    lat = F.greatest(F.lit(0.0), south, -north), F.greatest(F.abs(south), F.abs(north))
    lon = F.greatest(F.lit(0.0), west, -east), F.least(F.greatest(F.abs(west), F.abs(east)), F.lit(180.0))

    def cosines(a: Column, b: Column) -> tuple[Column, Column]:
        ends = F.cos(F.radians(a)), F.cos(F.radians(b))
        return F.least(*ends), F.when((a <= 0) & (b >= 0), 1.0).otherwise(F.greatest(*ends))

    if distance == "spherical":
        one, two = (cosines(low["lat"][k], high["lat"][k]) for k in (0, 1))
        half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
        return tuple(2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), half(lat[k]) + one[k] * two[k] * half(lon[k])))) for k in (0, 1))
    shrink = cosines((low["lat"][0] + low["lat"][1]) / 2, (high["lat"][0] + high["lat"][1]) / 2)
    return tuple(F.sqrt(lat[k] * lat[k] + F.pow(shrink[k] * lon[k], F.lit(2.0))) for k in (0, 1))


def _near(places: DataFrame, k: int, reach: float, distance: str) -> np.ndarray:
    """Sum of products of the scores of all places within reach kilometres.

    Places are dealt into bands of latitude and boxes of a band, so that one meets nine boxes, and in these into FINE by FINE
    cells. Of two cells that lie within reach as wholes only the sums of scores meet, and of two that lie beyond it nothing does.
    Places meet places only in pairs of cells that reach goes through, the rim. What is said of a cell are the bounds of
    the places in it, so a cell with one place is never at the rim of another such."""
    band, box = _boxes(reach)
    names, at = [f"_g{i}" for i in range(k)], ["_band", "_box", "_i", "_j"]
    limit = F.lit(float(reach if distance == "spherical" else reach / DEGREE))
    part = lambda x, whole: F.floor((x - whole) * FINE).cast("int")
    dealt = places.withColumn("_band", F.floor(band(F.col("_lat"))))
    dealt = dealt.withColumn("_box", F.floor(box(F.col("_lon"), F.col("_band"))))
    dealt = cut(dealt.withColumns({"_i": part(band(F.col("_lat")), F.col("_band")), "_j": part(box(F.col("_lon"), F.col("_band")), F.col("_box"))}), "places")
    bounds = {f"_{c}{e}": f(f"_{c}") for c in ("lat", "lon") for e, f in (("0", F.min), ("1", F.max))}
    cells = cut(dealt.groupBy(*at).agg(*[c.alias(n) for n, c in bounds.items()], *[F.sum(c).alias(c) for c in names]), "cells")
    turned = cells.withColumn("_turn", F.explode(F.array(F.lit(-360.0), F.lit(0.0), F.lit(360.0))))
    turned = turned.withColumns({c: F.col(c) + F.col("_turn") for c in ("_lon0", "_lon1")}).where((F.col("_turn") == 0) | ((F.col("_lon0") < 360) & (F.col("_lon1") > -360)))
    right = turned.select(*[F.col(c).alias("_r" + c) for c in [*at, *bounds, *names, "_turn"]])
    right = right.withColumn("_band", F.explode(F.array(*[F.col("_r_band") + d for d in (-1, 0, 1)])))
    # The boxes of that band that the cell's two ends come to, and their neighbours.
    ends = [F.floor(box(F.col(c), F.col("_band"))) for c in ("_r_lon0", "_r_lon1")]
    right = right.withColumn("_box", F.explode(F.sequence(ends[0] - 1, ends[1] + 1)))
    sides = [{c: (F.col(f"_{c}{e}"), F.col(f"_r_{c}{e}")) for c in ("lat", "lon")} for e in ("0", "1")]
    least, most = _apart(*sides, distance)
    far = F.greatest(F.col("_lon1") - F.col("_r_lon0"), F.col("_r_lon1") - F.col("_lon0"))
    met = cells.join(right, ["_band", "_box"]).where((least <= limit) & (F.greatest(F.col("_lon0") - F.col("_r_lon1"), F.col("_r_lon0") - F.col("_lon1")) <= 180))
    inside = (most <= limit) & (far <= 180)
    whole = met.where(inside).agg(*[F.sum(F.col(a) * F.col(f"_r{b}")) for a in names for b in names]).first()
    rim = met.where(~inside).select(*at, *[f"_r{c}" for c in [*at, "_turn"]])
    other = dealt.select(*[F.col(c).alias("_r" + c) for c in [*at, "_lat", "_lon", *names]])
    pairs = rim.join(dealt, at).join(other, [f"_r{c}" for c in at]).withColumn("_r_lon", F.col("_r_lon") + F.col("_r_turn"))
    exact = {c: (F.col(f"_{c}"), F.col(f"_r_{c}")) for c in ("lat", "lon")}
    pairs = pairs.where((_apart(exact, exact, distance)[1] <= limit) & (F.abs(F.col("_lon") - F.col("_r_lon")) <= 180))
    points = pairs.agg(*[F.sum(F.col(a) * F.col(f"_r{b}")) for a in names for b in names]).first()
    uncut(dealt, cells)
    return np.array([(a or 0.0) + (b or 0.0) for a, b in zip(whole, points)]).reshape(k, k)


def _meats(scores: DataFrame, ways: list[tuple[int, ...]], n_keys: int, k: int) -> dict[tuple[int, ...], tuple[np.ndarray, float]]:
    """For each combination of the keys _k0, _k1, ... the outer products of its cells' summed scores, and how many cells it has. The
    rows are read once, into sums by all keys together; each combination sums these on its own, so that no task holds the cells of
    several, and leaves K by K."""
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    names = [f"_g{i}" for i in range(k)]
    sums = [F.sum(c).alias(c) for c in names]
    finest = scores.groupBy(*[f"_k{i}" for i in range(n_keys)]).agg(*sums)
    if len(ways) > 1:
        finest = cut(finest, "cells")
    each = [finest.groupBy(*[f"_k{i}" for i in way]).agg(*sums).select(F.lit(n).alias("_way"), *names) for n, way in enumerate(ways)]
    cells = reduce(DataFrame.union, each)
    found = {r["_way"]: r for r in cells.groupBy("_way").agg(F.count("*").alias("n"), *[F.sum(F.col(f"_g{i}") * F.col(f"_g{j}")).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    if len(ways) > 1:
        uncut(finest)
    out = {}
    for n, way in enumerate(ways):
        r, m = found[n], np.zeros((k, k))
        for i, j in pairs:
            m[i, j] = m[j, i] = r[f"p{i}_{j}"]
        out[way] = m, float(r["n"])
    return out


def vcov(model, kind=None, ssc: Ssc | None = None) -> tuple[np.ndarray, float]:
    """The matrix, and the degrees of freedom of t."""
    if isinstance(kind, np.ndarray):
        return kind, model.n - model.nparams
    if callable(kind) and not isinstance(kind, Vcov):
        return np.asarray(kind(model)), model.n - model.nparams
    req = request(kind, model)
    ssc = ssc or req.ssc or model.ssc or DEFAULTS["ssc"]
    n, k, bread = model.n, len(model.names), model.bread
    used = parameters_counted(model, req.vars if req.kind in ("cluster", "NW", "DK") else (), ssc)
    adj = (n - 1) / max(n - used, 1) if ssc.adj else 1.0
    groups = inf
    if req.kind == "iid":
        v = bread * model.sigma2 * ((n - model.nparams) / (n - 1) if model.kind in ("ols", "gaussian") else 1.0)
    elif req.kind == "hetero":
        v = bread @ _outer(model.scores, k) @ bread * n / (n - 1)
    elif req.kind in ("hc2", "hc3"):
        # Residuals are scaled up by what their own row explains; only for models whose effects are columns.
        shrink = F.pow(1 - F.col("hat"), F.lit(-0.5 if req.kind == "hc2" else -1.0))
        w = F.col(model.weight) if model.weight else F.lit(1.0)
        rows = model.hatvalues().withColumns({f"_g{i}": w * F.col("_u") * shrink * F.col(f"_q{i}") for i in range(k)})
        v, adj = bread @ _outer(rows, k) @ bread, 1.0
    elif req.kind == "cluster":
        scores = model.scores.withColumns({f"_k{i}": _expr(v) for i, v in enumerate(req.vars)})
        ways, sizes = [c for r in range(1, len(req.vars) + 1) for c in combinations(range(len(req.vars)), r)], {}
        meats = _meats(scores, ways, len(req.vars), k)
        sizes = {way: n_cells for way, (_, n_cells) in meats.items()}
        meats = {way: m for way, (m, _) in meats.items()}
        groups = min(sizes[(i,)] for i in range(len(req.vars)))
        meat = np.zeros((k, k))
        for way in ways:
            g = groups if ssc.cluster_df == "min" else sizes[way]
            meat += (-1) ** (len(way) + 1) * meats[way] * (g / (g - 1) if ssc.cluster_adj and g > 1 else 1.0)
        v = bread @ meat @ bread
    elif req.kind in ("NW", "DK"):
        panel = req.kind == "NW" and len(req.vars) > 1
        if not req.vars:
            raise ValueError(f"{req.kind} needs a time variable")
        if req.kind == "NW" and not panel:
            if model.scores.groupBy(_expr(req.vars[0])).count().where("count > 1").limit(1).count():
                raise ValueError("a time series has one row for each period; name the unit too")
        cells, t = _ranked(model.scores, req.vars[-1], k, req.vars[0] if panel else None)
        lag = req.lag if req.lag is not None else floor(t**0.25) if panel or req.kind == "DK" else _bandwidth(cells, model.names, t)
        v, groups = bread @ _lagged(cells, k, min(lag, t - 1), ["_unit"] if panel else []) @ bread * t / max(t - 1, 1), t
    else:
        lat, lon = (F.expr(x).cast("double") for x in req.vars)
        if req.pixel:
            size = req.pixel / DEGREE
            lat = F.floor(lat / size) * size + size / 2
            lon = F.floor(lon / size) * size + size / 2
        cells = model.scores.groupBy(lat.alias("_lat"), lon.alias("_lon")).agg(*[F.sum(f"_g{i}").alias(f"_g{i}") for i in range(k)])
        reach = cutoff_km(req.cutoff) if req.cutoff is not None else default_cutoff(cells.select("_lat", "_lon"))
        v = bread @ _near(cells, k, reach, req.distance) @ bread
    v = v * adj
    if (np.diag(v) < 0).any():
        values, vectors = np.linalg.eigh((v + v.T) / 2)
        v = (vectors * np.maximum(values, 1e-10)) @ vectors.T
    if isinstance(ssc.t_df, int):
        return v, ssc.t_df
    return v, max(groups - 1, 1) if groups < inf and ssc.t_df == "min" else n - used
