"""The estimators as users call them, and sets of fits from one formula."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import Panel
from ..plans.formula import Request, call, parse, split_top
from .estimate import Model, fit, sample
from .glm import fenegbin_fit, fenl, feglm_fit, resolve
from .vcov import Ssc


@dataclass
class ModelSet:
    """Fits with what each stands for (sample, lhs, rhs, fixef)."""

    models: list[Model]
    index: list[dict] = field(default_factory=list)

    def __len__(self) -> int:
        return len(self.models)

    def __iter__(self) -> Iterator[Model]:
        return iter(self.models)

    def __getitem__(self, k):
        return self.models[k] if isinstance(k, int) else ModelSet(self.models[k], self.index[k])

    def pick(self, **by) -> ModelSet:
        """Those whose index matches, as in pick(lhs='y1', rhs=2)."""
        keep = [k for k, i in enumerate(self.index) if all(i.get(a) in (b if isinstance(b, (list, tuple)) else [b]) for a, b in by.items())]
        return ModelSet([self.models[k] for k in keep], [self.index[k] for k in keep])

    def frame(self) -> pd.DataFrame:
        return pd.DataFrame(self.index)

    def coef(self) -> pd.DataFrame:
        return pd.DataFrame([i | m.coef for i, m in zip(self.index, self.models)])

    def coeftable(self, vcov=None) -> pd.DataFrame:
        return pd.concat([m.coeftable(vcov).assign(**{k: str(v) for k, v in i.items()}) for i, m in zip(self.index, self.models)], ignore_index=True)


def lagged(df: DataFrame, request: Request, panel: tuple | None) -> tuple[DataFrame, Request]:
    """l(x, k), f(x, k) and d(x, k), with k a number or a range such as -1:1, become columns by the panel (id, time[, step])."""

    def has(t: str) -> bool:
        c = call(t)
        return bool(c) and c[0] in ("l", "f", "d")

    parts = {"rhs": request.rhs, "endo": request.endo, "inst": request.inst}
    if not any(has(p) for t in [request.lhs, *sum(map(list, parts.values()), [])] for p in split_top(t, ":")):
        return df, request
    if not panel:
        raise ValueError("lags need panel=(id, time)")
    p = Panel(df, *panel)

    def spread(term: str) -> list[str]:
        nonlocal p
        out = [""]
        for piece in split_top(term, ":"):
            c, names = call(piece), [piece]
            if has(piece):
                steps = c[1][1] if len(c[1]) > 1 else "1"
                m = re.fullmatch(r"\s*(-?\d+)\s*:\s*(-?\d+)\s*", steps)
                ks = range(int(m[1]), int(m[2]) + 1) if m else [int(x) for x in split_top(steps[2:-1] if steps.startswith("c(") else steps, ",")]
                names = []
                for k in ks:
                    col = f"__{c[0]}_{re.sub(r'[^A-Za-z0-9_]', '_', c[1][0])}_{str(k).replace('-', 'm')}"
                    if col not in p.df.columns:
                        p = p.diff(c[1][0], k, col) if c[0] == "d" else p.lag(c[1][0], k if c[0] == "l" else -k, col)
                    names.append(col)
            out = [f"{a}:{n}" if a else n for a in out for n in names]
        return out

    done = {k: tuple(x for t in v for x in spread(t)) for k, v in parts.items()}
    lhs = spread(request.lhs)[0]
    return p.data(), replace(request, lhs=lhs, **done)


def _names(vcov) -> list[str]:
    """Columns of a covariance formula, so that rows without them are left out."""
    if not isinstance(vcov, str) or "~" not in vcov:
        return []
    return [v for x in vcov.partition("~")[2].split("+") for v in x.strip().split("^") if re.fullmatch(r"\w+", v)]


def run(
    df: DataFrame, formula: str, one: Callable, weights: str | None = None, offset: str | None = None, subset: str | Column | None = None, split: str | None = None, fsplit: str | None = None,
    split_keep: list | None = None, split_drop: list | None = None, vcov=None, ssc: Ssc | None = None, panel: tuple | None = None, fixef_rm: str = "none", family: str | None = None, **values,
) -> Model | ModelSet:
    requests = parse(formula, df.columns, **values)
    groups: list = [(None, None)]
    if name := split or fsplit:
        from ..functions.columns import label, levels

        match = lambda v, asked: any(re.search(a[1:], label(v)) if str(a).startswith("@") else label(v).startswith(str(a)) for a in asked)
        found = [v for v in levels(df, F.expr(name)) if (not split_keep or match(v, split_keep)) and not (split_drop and match(v, split_drop))]
        groups = [(None, "Full sample")] * bool(fsplit) + [(F.expr(name) == F.lit(v), label(v)) for v in found]
    models, index = [], []
    for cond, label_ in groups:
        for r in requests:
            part, r2 = lagged(df, r, panel)
            part = part.where(subset) if subset is not None else part
            part = part.where(cond) if cond is not None else part
            s = sample(part, r2, weights, offset, None, _names(vcov), fixef_rm, family)
            m = one(s)
            m.default_vcov, m.ssc, m.panel = vcov, ssc, panel
            models.append(m)
            index.append({"sample": label_, **r.tags})
    return models[0] if len(models) == 1 and not (split or fsplit) else ModelSet(models, index)


def feols(df: DataFrame, formula: str, *, collin_tol: float = 1e-9, fixef_tol: float = 1e-10, demeaned: bool = False, **kw) -> Model | ModelSet:
    """Least squares, weighted where weights are given, two-stage where the formula has instruments.

    formula: outcome(s) ~ terms | fixed effects | endogenous ~ instruments, with c(y1, y2), sw/sw0/csw/csw0/mvsw, a^b for
    combined and a[x] or a[[x]] for sloped effects, i(), poly(), I(), a:b, a*b, l/f/d over a panel=(id, time); terms are
    Spark SQL expressions. weights, offset: expressions; subset: a condition; split, fsplit: a fit for each value."""
    return run(df, formula, lambda s: fit(s, tol=collin_tol, fe_tol=fixef_tol), **kw)


def feols_fit(df: DataFrame, y: str, x: list[str], effects: list[str] = (), **kw) -> Model:
    """feols for names in place of a formula."""
    return feols(df, f"{y} ~ {' + '.join(x) or '1'}" + (f" | {' + '.join(effects)}" if effects else ""), **kw)


def first_stages(model: Model) -> dict[str, Model]:
    """The regressions of the endogenous variables on the instruments and exogenous variables of a two-stage fit."""
    s, out = model.sample, {}
    names = [*s.inst, *s.x]
    cols = {f"_x{k}": F.col(c) for k, c in enumerate([*[f"_z{k}" for k in range(len(s.inst))], *s.xcols])}
    for k, e in enumerate(s.endo):
        part = replace(s, df=s.df.withColumns(cols | {"_y": F.col(f"_e{k}")}), x=names, endo=[], inst=[], offset=None)
        out[e] = fit(part, sizes=model.sizes)
        out[e].default_vcov, out[e].ssc, out[e].panel = model.default_vcov, model.ssc, model.panel
    return out


def feglm(df: DataFrame, formula: str, family="gaussian", *, glm_tol: float = 1e-8, glm_iter: int = 25, fixef_rm: str = "perfect", levels: bool | None = False, **kw) -> Model | ModelSet:
    """Generalised linear models. levels: the effects' coefficients are solved for in every turn, given the regressors'
    (None: where no effect has slopes)."""
    fam = resolve(family)
    return run(df, formula, lambda s: feglm_fit(s, fam, glm_tol, glm_iter, levels=levels), fixef_rm=fixef_rm, family=fam.name, **kw)


def fepois(df: DataFrame, formula: str, **kw) -> Model | ModelSet:
    return feglm(df, formula, "poisson", **kw)


def felogit(df: DataFrame, formula: str, **kw) -> Model | ModelSet:
    return feglm(df, formula, "logit", **kw)


def femlm(df: DataFrame, formula: str, family: str = "poisson", **kw) -> Model | ModelSet:
    """Maximum likelihood for poisson, logit, gaussian and negbin. Effects without slopes are concentrated out: every step is one
    of the likelihood at the effects that are best for the regressors' coefficients."""
    levels = kw.pop("levels", None)
    return fenegbin(df, formula, levels=levels, **kw) if family == "negbin" else feglm(df, formula, family, levels=levels, **kw)


def fenegbin(df: DataFrame, formula: str, *, fixef_rm: str = "perfect", levels: bool | None = False, **kw) -> Model | ModelSet:
    return run(df, formula, lambda s: fenegbin_fit(s, levels=levels), fixef_rm=fixef_rm, family="negbin", **kw)


def fenmlm(df: DataFrame, formula: str, nl: str, start: dict, family: str = "gaussian", **kw) -> Model:
    """As femlm with a part nl that is not linear in the parameters that start names."""
    return fenl(df, nl, start, parse(formula, df.columns)[0], family, **kw)


def demean(df: DataFrame, columns: list[str], effects: str, weights: str | None = None, tol: float = 1e-10) -> DataFrame:
    """df with the columns replaced by what the effects (as in a formula) leave of them."""
    from .absorb import absorb

    s = sample(df, parse(f"{columns[0]} ~ {' + '.join(columns[1:]) or '1'} | {effects}")[0], weights)
    cols = {f"_c{k}": F.expr(c).cast("double") for k, c in enumerate(columns)}
    rows = s.df.withColumns(cols)
    out = absorb(rows, s.blocks, list(cols), s.weight, tol).without(rows)
    keep = [c for c in df.columns if c not in columns]
    return out.select(*keep, *[F.col(f"_m__c{k}").alias(c) for k, c in enumerate(columns)])


def update(model: Model, df: DataFrame, formula: str, **kw) -> Model | ModelSet:
    from ..plans.formula import update as again

    text = again(model.sample.request, formula)
    return feols(df, text, **kw) if model.kind == "ols" else feglm(df, text, model.kind, **kw)


def collinearity(model: Model) -> list[str]:
    """What is wrong with the regressors of a fit, in words: constants, columns that the effects or the others explain."""
    out, df = [], model.sample.df
    for n in model.collinear:
        k = model.sample.x.index(n)
        got = df.agg(F.min(f"_x{k}"), F.max(f"_x{k}")).first()
        if got[0] == got[1]:
            out.append(f"{n} is constant")
            continue
        i = model.absorbed.cols.index(f"_x{k}")
        left, whole = model.stats["gram"][i, i], model.stats["raw"][i, i]
        out.append(f"{n} is explained by the fixed effects" if left < 1e-10 * whole else f"{n} is explained by the other variables")
    return out


def incremental_gram(rows: DataFrame, cols: list[str]) -> np.ndarray:
    from .moments import gram

    return gram(rows.withColumn("_one", F.lit(1.0)), [*cols, "_one"])
