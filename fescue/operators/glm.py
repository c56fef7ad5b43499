"""Generalised linear models by iteratively reweighted least squares, with absorbed effects, and models built on that."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace
from math import exp, lgamma, log

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import special
from ..sources.shared import cut, uncut
from .absorb import absorb
from .estimate import Model, Sample, fit, level_counts, sample
from .fixed_point import solve_effects
from .levels import solve_levels


#: Rows for each combination of regressors, offset and effects from which on a fit reads sums by combination.
MERGED = 2.0


@dataclass(frozen=True)
class Family:
    """Columns for columns: mean from predictor, its slope, variance, unit deviance, log-likelihood, first mean."""

    name: str
    inverse: Callable[[Column], Column]
    slope: Callable[[Column], Column]
    variance: Callable[[Column], Column]
    deviance: Callable[[Column, Column], Column]
    link: Callable[[Column], Column]
    start: Callable[[Column], Column] = lambda y: y
    likelihood: Callable[[Column, Column], Column] | None = None
    fixed: bool = False  # dispersion 1


def _xlog(y: Column, ratio: Column) -> Column:
    return F.when(y > 0, y * F.log(ratio)).otherwise(0.0)


def _expit(e: Column) -> Column:
    return F.when(e > 0, 1.0 / (1.0 + F.exp(-e))).otherwise(F.exp(e) / (1.0 + F.exp(e)))


def _binomial(y: Column, mu: Column) -> Column:
    return F.when(y > 0, y * F.log(mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log(1 - mu)).otherwise(0.0)


def _binomial_deviance(y: Column, mu: Column) -> Column:
    return 2 * (F.when(y > 0, y * F.log(y / mu)).otherwise(0.0) + F.when(y < 1, (1 - y) * F.log((1 - y) / (1 - mu))).otherwise(0.0))


def _probit_mean(e: Column) -> Column:
    return F.least(F.greatest(special.normal_cdf(e), F.lit(1e-15)), F.lit(1 - 1e-15))


_half = lambda y: (y + 0.5) / 2

FAMILIES = {
    "gaussian": Family("gaussian", lambda e: e, lambda e: F.lit(1.0), lambda m: F.lit(1.0), lambda y, m: (y - m) * (y - m), lambda m: m),
    "poisson": Family("poisson", F.exp, F.exp, lambda m: m, lambda y, m: 2 * (_xlog(y, y / m) - (y - m)), F.log, lambda y: y + 0.1, lambda y, m: y * F.log(m) - m - special.lgamma(y + 1), True),
    "logit": Family("logit", _expit, lambda e: _expit(e) * (1 - _expit(e)), lambda m: m * (1 - m), _binomial_deviance, lambda m: F.log(m / (1 - m)), _half, _binomial, True),
    "probit": Family("probit", _probit_mean, lambda e: F.greatest(special.normal_pdf(e), F.lit(1e-15)), lambda m: m * (1 - m), _binomial_deviance, lambda m: F.log(m / (1 - m)) / 1.702, _half, _binomial, True),
    "Gamma": Family("Gamma", F.exp, F.exp, lambda m: m * m, lambda y, m: -2 * (F.log(y / m) - (y - m) / m), F.log),
    "inverse.gaussian": Family("inverse.gaussian", F.exp, F.exp, lambda m: m * m * m, lambda y, m: (y - m) * (y - m) / (y * m * m), F.log),
}


def negbin(theta: float) -> Family:
    t = float(theta)
    return Family(
        "negbin", F.exp, F.exp, lambda m: m + m * m / t, lambda y, m: 2 * (_xlog(y, y / m) - (y + t) * F.log((y + t) / (m + t))), F.log, lambda y: y + 1 / 6,
        lambda y, m: special.lgamma(y + t) - lgamma(t) - special.lgamma(y + 1) + t * log(t) + y * F.log(m) - (y + t) * F.log(m + t), True,
    )


FAMILIES["negbin"] = negbin(1.0)


def resolve(family) -> Family:
    if isinstance(family, Family):
        return family
    found = [k for k in FAMILIES if k.startswith(family)]
    if len(found) != 1:
        raise ValueError(f"no such family: {family}")
    return FAMILIES[found[0]]


@dataclass
class _State:
    """Coefficients of one turn, and the effects' tables; enough to write down the predictor as columns."""

    names: list[str]
    beta: np.ndarray
    tables: list

    def predictor(self, s: Sample, df: DataFrame, extra: Column | None = None) -> DataFrame:
        cols, where = df.columns, {n: F.col(f"_x{k}") for k, n in enumerate(s.x)}
        eta = sum((float(b) * where[n] for n, b in zip(self.names, self.beta) if n in where), extra if extra is not None else F.lit(0.0))
        for k, (blocks, table) in enumerate(self.tables):
            named = table.select(F.col("key").alias(f"_key{k}"), *[F.col(f"c{b}").alias(f"_c{k}_{b}") for b in range(len(blocks))])
            df = df.join(named, F.col(blocks[0].key) == F.col(f"_key{k}"), "left")
            eta = eta + sum((F.col(f"_c{k}_{b}") * (F.col(block.unit) if block.unit else F.lit(1.0)) for b, block in enumerate(blocks)), F.lit(0.0))
        return df.select(*cols, (eta + (F.col("_o") if s.offset else F.lit(0.0))).alias("_eta"))

    def halfway(self, old: _State) -> _State:
        tables = []
        for (blocks, t), (_, o) in zip(self.tables, old.tables):
            both = t.unionByName(o).groupBy("key").agg(*[F.avg(f"c{b}").alias(f"c{b}") for b in range(len(blocks))])
            tables.append((blocks, cut(both, "effects")))
        mine, was = dict(zip(self.names, self.beta)), dict(zip(old.names, old.beta))
        names = list(dict.fromkeys([*self.names, *old.names]))
        return _State(names, np.array([(mine.get(n, 0.0) + was.get(n, 0.0)) / 2 for n in names]), tables)


def _merged(s: Sample, family: Family | None) -> DataFrame | None:
    """One row for each combination of regressors, offset and effects, in two passes over the rows; None where rows share too little.

    The families are exponential ones: given the mean, a row's score is linear in its outcome, so that a fit needs the mean outcome (_y)
    and the weight (_w) of a combination. What a deviance or a likelihood has beside those of the mean outcome does not depend on the
    fit; _c, _l and _ss, sums at one fixed mean and of squares, tell it. Without a family the outcome is part of the combination."""
    w, y = F.col(s.weight) if s.weight else F.lit(1.0), F.col("_y")
    keys = [c for c in s.df.columns if re.fullmatch(r"_(o|[xf]\d+|s\d+_\d+)", c)] + ["_y"] * (family is None)
    count = F.sum("_rows_") if "_rows_" in s.df.columns else F.count("*")
    found = s.df.agg(F.approx_count_distinct(F.xxhash64(*keys)), F.count("*")).first()
    if found[0] * MERGED > found[1]:
        return None
    sums = [F.sum(w).alias("_w"), count.alias("_rows_")]
    if family is not None:
        mean = family.inverse(F.lit(0.0))
        likelihood = family.likelihood(y, mean) if family.likelihood else F.lit(0.0)
        sums += [(F.sum(w * y) / F.sum(w)).alias("_mean"), F.sum(w * family.deviance(y, mean)).alias("_c"), F.sum(w * likelihood).alias("_l"), F.sum(w * y * y).alias("_ss")]
    out = s.df.groupBy(*keys).agg(*sums)
    return cut(out if family is None else out.withColumnRenamed("_mean", "_y"), "merged")


def feglm_fit(s: Sample, family: Family, tol: float = 1e-8, most: int = 25, start: _State | None = None, fe_tol: float = 1e-10, levels: bool | None = False, shown: Sample | None = None) -> Model:
    """IRLS. levels: the coefficients of the effects are solved for after each turn, given the regressors', so that steps are taken on
    the likelihood that is concentrated on these; without it that begins where ten halvings of a step do not help. One
    effect has its levels' roots, several are found by sweeps. None: where there are effects, all without slopes. Where many rows
    share their regressors, offset and effects, turns read sums by combination of these. shown: the sample that the model is of, where s
    has sums of its rows."""
    plain = bool(s.blocks) and not any(b.unit for b in s.blocks)
    levels = plain if levels is None else levels
    if levels and not plain:
        raise ValueError("levels are solved for where there are effects, and none has slopes")
    shown, sizes = shown or s, None
    base = _merged(s, family) if most > 1 and (FAMILIES.get(family.name) is family or family.name == "negbin") else None
    if merged := base is not None:
        sizes, w = level_counts(replace(s, df=base)), F.col("_w")
    else:
        # The turns read what the fit needs, kept where it fits and worked out again where it is lost.
        base, w = s.df.select(*[c for c in s.df.columns if re.fullmatch(r"_([ywo]|rows_|[xf]\d+|s\d+_\d+)", c)]).persist(StorageLevel.MEMORY_AND_DISK), F.col(s.weight) if s.weight else F.lit(1.0)
    # Deviance, log-likelihood and sum of squares within the combinations.
    y, at0, within = F.col("_y"), family.inverse(F.lit(0.0)), (0.0, 0.0, 0.0)
    if merged:
        likelihood = family.likelihood(y, at0) if family.likelihood else F.lit(0.0)
        within = [x or 0.0 for x in base.agg(F.sum(F.col("_c") - w * family.deviance(y, at0)), F.sum(F.col("_l") - w * likelihood), F.sum(F.col("_ss") - w * y * y)).first()]
    off = F.col("_o") if s.offset else F.lit(0.0)

    def at(state: _State | None, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_eta", family.link(family.start(F.col("_y")))) if state is None else state.predictor(s, rows)
        return rows.withColumns({"_mu": family.inverse(F.col("_eta")), "_slope": family.slope(F.col("_eta"))})

    def working(rows: DataFrame, w: Column = w) -> DataFrame:
        mu, slope = F.col("_mu"), F.col("_slope")
        return rows.withColumns({"_irls": w * slope * slope / family.variance(mu), "_z": F.col("_eta") - off + (F.col("_y") - mu) / slope}).where("_irls > 0")

    def solved(state: _State) -> _State:
        known = _State(state.names, state.beta, []).predictor(s, base)
        if len(s.blocks) == 1:
            return _State(state.names, state.beta, [(state.tables[0][0], solve_levels(known, s.blocks[0].key, family, w))])
        held = {blocks[0].key: blocks for blocks, _ in state.tables}
        found, sweeps = solve_effects(known, list(held), family, w, {blocks[0].key: t for blocks, t in state.tables})
        counted.append(sweeps)
        return _State(state.names, state.beta, [(held[k], t) for k, t in found.items()])

    old_dev, state, model, done, counted = None, start, None, False, []
    for turn in range(most):
        before = state
        model = fit(s, family.name, weight="_irls", y="_z", rows=working(at(before, base)), sizes=sizes, dispersion=1.0, fe_tol=fe_tol)
        sizes = model.sizes
        # Of one effect the table reads sums that are written already; those of several come from joins, and are written here.
        tables = model.effect_tables()
        tables = tables if len(tables) < 2 else [(blocks, cut(t, "effects")) for blocks, t in tables]
        after = _State(model.names, model.beta, tables)
        for attempt in range(20 if plain else 10):
            if levels or attempt == 10:
                levels = True
                after = solved(after)
            df = at(after, base)
            dev = df.agg(F.sum(w * family.deviance(F.col("_y"), F.col("_mu"))) + within[0]).first()[0]
            if dev is not None and np.isfinite(dev) and (old_dev is None or dev <= old_dev * (1 + 1e-10) + 1e-10) or state is None:
                break
            after = after.halfway(state)
        state = after
        done = old_dev is not None and abs(dev - old_dev) / (0.1 + abs(dev)) < tol
        old_dev = dev
        if done:
            break
    if not done:
        warnings.warn(f"the {family.name} fit has not settled after {turn + 1} turns: deviance {old_dev}", stacklevel=2)
    # All columns again, at the predictor that the last regression was made at.
    model.rows = working(at(before, shown.df), F.col(shown.weight) if shown.weight else F.lit(1.0)).withColumn("_one", F.lit(1.0))
    model.sample = shown
    if merged:
        model.ssr += working(at(before, base)).agg(F.sum((F.col("_ss") - w * y * y) / family.variance(F.col("_mu")))).first()[0] or 0.0
    model.stats |= {"deviance": old_dev, "turns": turn + 1, "converged": done, "working_ssr": model.ssr, "sweeps": sum(counted)}
    model.beta = np.array([dict(zip(state.names, state.beta)).get(n, 0.0) for n in model.names])
    final = state
    model.stats["state"] = final
    rows = F.sum("_rows_") if "_rows_" in base.columns else F.count("*")
    cells = df.agg(rows, F.sum(w), F.sum(w * F.col("_y")), F.sum(w * (F.col("_y") - F.col("_mu")) ** 2) + max(within[2], 0.0)).first()
    model.n, model.stats["sum_w"], model.stats["mean_y"], model.ssr = int(cells[0]), cells[1], cells[2] / cells[1], cells[3]
    if not family.fixed:
        model.sigma2 = _dispersion(model)
    mean = F.lit(model.stats["mean_y"])
    if family.likelihood:
        got = df.agg(F.sum(w * family.likelihood(F.col("_y"), F.col("_mu"))) + within[1], F.sum(w * family.likelihood(F.col("_y"), mean)) + within[1]).first()
        model.stats |= {"ll": got[0], "ll_null": got[1]}
    else:
        got = df.agg(F.sum(w * family.deviance(F.col("_y"), mean)) + within[0]).first()
        n = cells[1]
        ll = lambda d: -n / 2 * (log(2 * np.pi * d / n) + 1)
        model.stats |= {"ll": ll(old_dev), "ll_null": ll(got[0])} if family.name == "gaussian" else {"ll": float("nan"), "ll_null": float("nan")}
    uncut(base) if merged else base.unpersist()
    model.effect_tables = lambda: final.tables  # type: ignore[method-assign]
    model._mean = lambda eta: family.inverse(eta)  # type: ignore[method-assign]
    return model


def _dispersion(model: Model) -> float:
    """Weighted squared working residuals over n - K; the regression's own sum of squares is just that."""
    return model.stats["working_ssr"] / max(model.n - model.nparams, 1)


def theta_step(df: DataFrame, w: Column, theta: float) -> tuple[float, float, float]:
    """Gradient and curvature of the log-likelihood in theta, and the log-likelihood."""
    y, mu, t = F.col("_y"), F.exp(F.col("_eta")), F.lit(float(theta))
    grad = special.digamma(y + t) - special.digamma(t) + F.log(t) + 1 - F.log(mu + t) - (y + t) / (mu + t)
    curve = special.trigamma(y + t) - special.trigamma(t) + 1 / t - 2 / (mu + t) + (y + t) / ((mu + t) * (mu + t))
    got = df.agg(F.sum(w * grad), F.sum(w * curve), F.sum(w * negbin(theta).likelihood(y, mu))).first()
    return tuple(got)


def _with_theta(s: Sample, sums: Sample, model: Model, state: _State, theta: float) -> None:
    """The model's matrices from the observed information of coefficients, effects and theta together, which the effects are
    concentrated out of: they follow the regressors and theta, as far as a weighted regression on them tells.

    With weights -d2l/deta2 and z the derivative of the score wrt theta over these weights, what theta shares with the other
    parameters are the products of z with them; what the effects leave of z and of the regressors comes from one absorption, of sums, the rows put together by outcome and regressors. The
    scores are those of the rows of s."""
    y, t = F.col("_y"), F.lit(float(theta))
    mu = F.exp(F.col("_eta"))
    part = mu + t
    weight = lambda q: F.col(q.weight) if q.weight else F.lit(1.0)

    def observed(q: Sample) -> DataFrame:
        w = weight(q)
        rows = state.predictor(q, q.df).withColumns({"_obs": w * (y + t) * mu * t / (part * part), "_shift": mu * (y - mu) / (part * part)})
        return rows.withColumns({"_zt": w * F.col("_shift") / F.col("_obs"), "_z": F.col("_eta") - (F.col("_o") if q.offset else F.lit(0.0)) + w * (y - mu) * t / part / F.col("_obs")})

    rows, w = observed(sums), weight(s)
    again = fit(s, "negbin", weight="_obs", y="_z", rows=rows, sizes=model.sizes, dispersion=1.0)
    cols = ["_zt", *[f"_x{s.x.index(n)}" for n in again.names]]
    a = absorb(rows, s.blocks, cols, "_obs")
    _, curve, _ = theta_step(rows, weight(sums), theta)
    information = a.gram.copy()
    information[0, 1:] *= -1
    information[1:, 0] *= -1
    information[0, 0] = -curve - (a.raw[0, 0] - a.gram[0, 0])
    v = np.linalg.inv(information)
    model.names, model.beta, model.combo, model.resid, model.absorbed = again.names, again.beta, again.combo, again.resid, again.absorbed
    model.rows, model.weight, model.z, model.collinear, model.bread = observed(s).withColumn("_one", F.lit(1.0)), "_obs", "_z", again.collinear, v[1:, 1:]
    model.stats |= {"theta": theta, "theta_se": float(np.sqrt(v[0, 0])) if v[0, 0] > 0 else float("nan"), "theta_share": v[1:, 0]}
    grad = special.digamma(y + t) - special.digamma(t) + F.log(t) + 1 - F.log(part) - (y + t) / part

    def scores() -> DataFrame:
        """Scores that the matrix takes to what each row adds to the coefficients, theta's part included."""
        df = a.without(model.score_rows, "_left_", ["_zt"])
        own = w * grad + (F.col("_zt") - F.col("_left__zt")) * F.col("_obs") * F.col("_u")
        share = np.linalg.solve(model.bread, v[1:, 0])
        return df.withColumn("_gt", own).withColumns({f"_g{k}": F.col("_obs") * F.col("_u") * F.col(f"_q{k}") + float(share[k]) * F.col("_gt") for k in range(len(model.names))})

    model.own_scores = scores


def fenegbin_fit(s: Sample, tol: float = 1e-8, most: int = 30, bounds: tuple[float, float] = (1e-3, 1e4), levels: bool | None = False) -> Model:
    """Coefficients given theta by IRLS and theta given the means by Newton steps, in turn, until neither moves. Standard errors
    are those of the observed information of all parameters, theta among them. All turns read sums by outcome, regressors, offset and
    effects, or, where few rows share these, what the fit needs of the rows, written once."""
    base = _merged(s, None)
    if base is None:
        base = cut(s.df.select(*[c for c in s.df.columns if re.fullmatch(r"_([yo]|[xf]\d+|s\d+_\d+)", c)], (F.col(s.weight) if s.weight else F.lit(1.0)).alias("_w")).withColumn("_rows_", F.lit(1).cast("long")), "rows")
    sums, w, rows = replace(s, df=base, weight="_w"), F.col("_w"), F.col("_rows_")
    m = base.agg(F.sum(rows * F.col("_y")) / F.sum(rows), F.sum(rows)).first()
    m = (m[0], base.agg(F.sum(rows * (F.col("_y") - m[0]) ** 2)).first()[0] / max(m[1] - 1, 1))
    theta = max(m[0] ** 2 / max((m[1] or 0.0) - m[0], 1e-4), 0.05)
    state, model, settled = None, None, False
    for _ in range(most):
        model = feglm_fit(sums, negbin(theta), start=state, levels=levels, shown=s)
        state = model.stats["state"]
        df, before = cut(state.predictor(sums, base).select("_y", "_w", "_eta"), "means"), theta
        for _ in range(20):
            grad, curve, ll = theta_step(df, w, theta)
            move = grad * theta / -(curve * theta * theta + grad * theta) if curve * theta * theta + grad * theta < 0 else np.sign(grad) * 0.5
            theta = float(min(max(theta * exp(max(min(move, 1.5), -1.5)), bounds[0]), bounds[1]))
            if abs(move) < 1e-7 or theta in bounds:
                break
        _, curve, ll = theta_step(df, w, theta)
        uncut(df)
        if settled := abs(theta - before) < tol * (1 + theta) * 100:
            break
    if not settled:
        warnings.warn(f"theta has not settled after {most} turns: {theta}", stacklevel=2)
    model.kind = "negbin"
    model.stats |= {"theta": theta, "ll": ll, "theta_se": float("nan"), "converged": settled and model.stats["converged"]}
    if theta not in bounds:
        _with_theta(s, sums, model, state, theta)
    y0 = {"mean": model.stats["mean_y"]}
    null = cut(base.groupBy("_y").agg(F.sum(w).alias("_w")).withColumn("_eta", F.log(F.lit(y0["mean"]))), "outcomes")
    t0 = theta
    for _ in range(50):
        grad, c0, ll0 = theta_step(null, w, t0)
        move = grad * t0 / -(c0 * t0 * t0 + grad * t0) if c0 * t0 * t0 + grad * t0 < 0 else np.sign(grad) * 0.5
        t0 = float(min(max(t0 * exp(max(min(move, 1.5), -1.5)), bounds[0]), bounds[1]))
        if abs(move) < 1e-7 or t0 in bounds:
            break
    model.stats["ll_null"] = theta_step(null, w, t0)[2]
    uncut(null)
    model.nparams += 1
    return model


def fenl(df: DataFrame, formula_rhs: str, start: dict[str, float], request, family="gaussian", lower: dict | None = None, upper: dict | None = None, tol: float = 1e-9, most: int = 100, step: float = 1e-5, **kw) -> Model:
    """A part that is not linear in its parameters: formula_rhs is a Spark SQL expression in which the names of start stand for
    numbers. Every turn takes numeric derivatives as columns and fits them with the other regressors and the effects by
    weighted least squares; a turn that does not lower the deviance is halved. A parameter at a bound has no standard error."""
    fam, names = resolve(family), list(start)
    lower, upper = lower or {}, upper or {}
    value = lambda p: F.expr(re.sub(r"\b(" + "|".join(map(re.escape, names)) + r")\b", lambda m: f"CAST({p[m[1]]!r} AS DOUBLE)", formula_rhs))
    s = sample(df, request, **kw)
    n0 = len(s.x)
    s = replace(s, x=[*s.x, *names])
    w = F.col(s.weight) if s.weight else F.lit(1.0)
    off = F.col("_o") if s.offset else F.lit(0.0)
    theta, sizes, dev0, state = {k: float(v) for k, v in start.items()}, level_counts(s), None, None
    linear = _State([], np.zeros(0), [])
    base = s.df
    rows = base.withColumn("_lin", fam.link(fam.start(F.col("_y"))) - value(theta)) if fam.name != "gaussian" else base.withColumn("_lin", F.lit(0.0))
    model = None
    for turn in range(most):
        jac = {}
        for k, p in enumerate(names):
            h = step * max(1.0, abs(theta[p]))
            jac[f"_x{n0 + k}"] = (value(theta | {p: theta[p] + h}) - value(theta | {p: theta[p] - h})) / (2 * h)
        now = value(theta)
        rows = rows.withColumn("_eta", F.col("_lin") + now + off)
        mu, slope = fam.inverse(F.col("_eta")), fam.slope(F.col("_eta"))
        again = rows.withColumns(jac)
        z = F.col("_lin") + sum((theta[p] * F.col(f"_x{n0 + k}") for k, p in enumerate(names)), F.lit(0.0)) + (F.col("_y") - mu) / slope
        again = again.withColumns({"_irls": w * slope * slope / fam.variance(mu), "_z": z})
        model = fit(s, fam.name, weight="_irls", y="_z", rows=again, sizes=sizes, dispersion=1.0 if fam.fixed else None)
        tables = [(b, cut(t, "effects")) for b, t in model.effect_tables()]
        goal = {p: float(model.beta[model.names.index(p)]) if p in model.names else theta[p] for p in names}
        new = _State([n for n in model.names if n not in names], np.array([b for n, b in zip(model.names, model.beta) if n not in names]), tables)
        share, after = 1.0, None
        for _ in range(12):
            trial = {p: min(max(theta[p] + share * (goal[p] - theta[p]), lower.get(p, -np.inf)), upper.get(p, np.inf)) for p in names}
            s2 = replace(s, x=s.x[:n0], offset=None)
            got = new.predictor(s2, base).withColumnRenamed("_eta", "_lin")
            dev = got.agg(F.sum(w * fam.deviance(F.col("_y"), fam.inverse(F.col("_lin") + value(trial) + off)))).first()[0]
            after = trial
            if dev is not None and np.isfinite(dev) and (dev0 is None or dev <= dev0 * (1 + 1e-12)):
                break
            share /= 2
        moved = max(abs(after[p] - theta[p]) / (1 + abs(theta[p])) for p in names)
        theta, rows, state = after, got, new
        small = dev0 is not None and abs(dev - dev0) / (0.1 + abs(dev)) < tol
        dev0 = dev
        if small and moved < 1e-7:
            break
    for k, n in enumerate(model.names):
        if n in theta:
            model.beta[k] = theta[n]
            if theta[n] in (lower.get(n), upper.get(n)):
                model.bread[k, :] = model.bread[:, k] = np.nan
    model.stats |= {"deviance": dev0, "turns": turn + 1, "nl": formula_rhs, "parameters": theta}
    if fam.likelihood:
        model.stats["ll"] = rows.agg(F.sum(w * fam.likelihood(F.col("_y"), fam.inverse(F.col("_lin") + value(theta) + off)))).first()[0]
    else:
        model.stats["ll"] = -model.n / 2 * (log(2 * np.pi * dev0 / model.n) + 1)
    return model
