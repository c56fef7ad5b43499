"""Statistics of a fit, from the moments it keeps; a few of them run one more aggregate."""

from __future__ import annotations

from collections.abc import Callable
from math import inf, log, nan, pi, sqrt

import numpy as np

from ..functions.dist import chi2_p, f_p
from .moments import gram, pseudo_inverse

_OWN: dict[str, Callable] = {}


def register(name: str, f: Callable) -> None:
    """A statistic of one's own: a function of the model."""
    _OWN[name] = f


def log_likelihood(model) -> float:
    if "ll" in model.stats:
        return model.stats["ll"]
    return -model.n / 2 * (log(2 * pi * model.ssr / model.n) + 1)


def _null(model) -> float:
    if "ll_null" in model.stats:
        return model.stats["ll_null"]
    return -model.n / 2 * (log(2 * pi * model.stats["ssr_null"] / model.n) + 1)


def _only_effects(model) -> float:
    """Log-likelihood of the effects alone."""
    if model.kind == "ols":
        return -model.n / 2 * (log(2 * pi * model.stats["ssr_fe"] / model.n) + 1)
    if "ll_fe" not in model.stats:
        from dataclasses import replace

        from .glm import feglm_fit, resolve

        s = replace(model.sample, x=[])
        model.stats["ll_fe"] = feglm_fit(s, resolve(model.kind)).stats["ll"]
    return model.stats["ll_fe"]


def r2(model, kind: str) -> float:
    """r2, ar2, pr2, apr2, their within versions wr2, war2, wpr2, wapr2, and cor2."""
    n, big, k = model.n, model.nparams, len(model.names)
    within, adjusted, pseudo = kind.startswith("w"), "a" in kind.replace("apr", "a"), "pr2" in kind
    if within and not model.sample.effects:
        return nan
    if pseudo:
        ll = log_likelihood(model)
        if within:
            return 1 - (ll - adjusted * k) / _only_effects(model)
        return 1 - (ll - (big - 1) * adjusted) / _null(model)
    if kind == "cor2":
        from pyspark.sql import functions as F

        got = model.fitted().agg(F.corr("_y", "fitted")).first()[0]
        return got**2 if got is not None else nan
    if model.kind != "ols":
        return nan
    if within:
        fes = big - k
        return 1 - model.ssr / model.stats["ssr_fe"] * ((n - fes) / (n - fes - k) if adjusted else 1.0)
    has = bool(model.sample.effects) or model.sample.request.intercept
    return 1 - model.ssr / model.stats["ssr_null"] * ((n - has) / (n - big) if adjusted else 1.0)


def wald(model, keep: str | None = None, vcov=None) -> dict:
    """Joint test that the coefficients (those whose name matches keep; all but the intercept) are 0."""
    import re

    from .vcov import vcov as compute

    pick = [k for k, n in enumerate(model.names) if (re.search(keep, n) if keep else n != "(Intercept)")]
    if not pick:
        return {"stat": nan, "p": nan, "df1": 0, "df2": nan}
    v, df = compute(model, vcov if vcov is not None else model.default_vcov)
    b, inner = model.beta[pick], v[np.ix_(pick, pick)]
    stat = float(b @ pseudo_inverse(inner) @ b) / len(pick)
    return {"stat": stat, "p": f_p(stat, len(pick), df), "df1": len(pick), "df2": df}


def _iv(model) -> dict:
    """First stages: cross-products of the true endogenous variables on instruments and exogenous variables."""
    return model.stages


def first_stage(model, endo: str) -> dict:
    """F and Wald tests that the instruments do not matter for one endogenous variable (iid)."""
    st, g = model.stages, model.stats["gram"]
    e = st["e"][model.sample.endo.index(endo)]
    pi = st["pi"][:, model.sample.endo.index(endo)]
    w, x, q = st["w"], st["x"], len(st["z"])
    ssr = float(g[e, e] - pi @ g[np.ix_(w, w)] @ pi)
    bx = np.linalg.solve(g[np.ix_(x, x)], g[np.ix_(x, [e])][:, 0]) if x else np.zeros(0)
    ssr_x = float(g[e, e] - (bx @ g[np.ix_(x, [e])][:, 0] if x else 0.0))
    k = model.nparams - len(model.names) + len(w)
    df2 = model.n - k
    f = (ssr_x - ssr) / q / (ssr / df2)
    return {"stat": f, "p": f_p(f, q, df2), "df1": q, "df2": df2, "ssr": ssr, "coef": pi}


def wu_hausman(model) -> dict:
    """F test of the first stages' residuals added to the structural equation."""
    st, g = model.stages, model.stats["gram"]
    m, w, e, x = len(g), st["w"], st["e"], st["x"]
    v = np.zeros((m, len(e)))
    for j, c in enumerate(e):
        v[c, j] = 1
        v[w, j] -= st["pi"][:, j]
    base = np.zeros((m, len(e) + len(x)))
    base[[*e, *x], range(len(e) + len(x))] = 1

    def ssr(z: np.ndarray) -> float:
        a, b = z.T @ g @ z, z.T @ g[:, 0]
        return float(g[0, 0] - b @ pseudo_inverse(a) @ b)

    full, part = ssr(np.hstack([base, v])), ssr(base)
    q, df2 = len(e), model.n - model.nparams - len(e)
    f = (part - full) / q / (full / df2)
    return {"stat": f, "p": f_p(f, q, df2), "df1": q, "df2": df2}


def sargan(model) -> dict:
    st, g = model.stages, model.stats["gram"]
    df = len(st["z"]) - len(st["e"])
    if df <= 0:
        return {"stat": nan, "p": nan, "df": 0}
    r = model.resid[:-1]
    w = st["w"]
    b = g[np.ix_(w, range(len(g)))] @ r
    total = float(r @ g @ r)
    fitted = float(b @ st["inner"] @ b)
    stat = model.n * fitted / total
    return {"stat": stat, "p": chi2_p(stat, df), "df": df}


def _partialled(model) -> tuple[np.ndarray, np.ndarray, np.ndarray, list, list]:
    """Cross-products of instruments and endogenous variables, exogenous ones taken out."""
    st, g = model.stages, model.stats["gram"]
    z, e, x = st["z"], st["e"], st["x"]

    def part(a: list, b: list) -> np.ndarray:
        return g[np.ix_(a, b)] - (g[np.ix_(a, x)] @ np.linalg.solve(g[np.ix_(x, x)], g[np.ix_(x, b)]) if x else 0.0)

    return part(z, z), part(z, e), part(e, e), z, e


def cragg_donald(model) -> dict:
    zz, ze, ee, z, e = _partialled(model)
    fitted = ze.T @ np.linalg.solve(zz, ze)
    values = np.sort(np.real(np.linalg.eigvals(np.linalg.solve(ee, fitted))))
    r = min(max(values[0], 0.0), 1 - 1e-15)
    return {"stat": (model.n - len(z)) / len(z) * r / (1 - r)}


def kleibergen_paap(model) -> dict:
    """Rank statistic of the instruments' coefficients, with covariances that hold under heteroskedasticity."""
    from pyspark.sql import functions as F

    zz, ze, ee, z, e = _partialled(model)
    st, g = model.stages, model.stats["gram"]
    pi = np.linalg.solve(zz, ze)
    vv = ee - ze.T @ pi
    lz, le = np.linalg.cholesky(zz), np.linalg.cholesky(np.linalg.inv(vv) if len(vv) else vv)
    theta = lz.T @ pi @ le
    u, s, vt = np.linalg.svd(theta)
    q = len(e)
    uq, vq = u[:, q - 1 :], vt.T[:, q - 1 :]
    lam = uq.T @ theta @ vq
    # Products of partialled instruments and first-stage residuals, summed over rows.
    df = model.absorbed.without(model.rows)
    cols = model.absorbed.cols
    x = st["x"]
    gx = np.linalg.solve(g[np.ix_(x, x)], g[np.ix_(x, z)]) if x else None
    mix = lambda v: sum((float(a) * F.col("_m_" + c) for a, c in zip(v, cols) if a), F.lit(0.0))
    zc = {}
    for j, c in enumerate(z):
        v = np.zeros(len(cols))
        v[c] = 1
        if x:
            v[x] -= gx[:, j]
        zc[f"_zz{j}"] = mix(v)
    ec = {}
    for j, c in enumerate(e):
        v = np.zeros(len(cols))
        v[c] = 1
        v[st["w"]] -= st["pi"][:, j]
        ec[f"_ee{j}"] = mix(v)
    df = df.withColumns(zc | ec)
    w = F.col(model.weight) if model.weight else F.lit(1.0)
    names = [f"_p{a}_{b}" for b in range(len(e)) for a in range(len(z))]
    df = df.withColumns({f"_p{a}_{b}": w * F.col(f"_zz{a}") * F.col(f"_ee{b}") for b in range(len(e)) for a in range(len(z))})
    meat = gram(df, names)
    left = np.kron((le @ vq).T, np.linalg.solve(lz.T, uq).T)
    v = left @ meat @ left.T
    flat = lam.T.reshape(-1)
    stat = float(flat @ pseudo_inverse(v) @ flat)
    df1 = len(z) - len(e) + 1
    return {"stat": stat, "p": chi2_p(stat, df1), "df": df1}


def fitstat(model, kinds: tuple[str, ...], vcov=None) -> dict:
    n, k = model.n, model.nparams
    out: dict = {}
    for kind in kinds or ("n", "ll", "r2", "rmse"):
        ll = lambda: log_likelihood(model)
        if kind in _OWN:
            out[kind] = _OWN[kind](model)
        elif kind in ("n", "nobs"):
            out[kind] = n
        elif kind in ("ll", "logLik"):
            out[kind] = ll()
        elif kind == "aic":
            out[kind] = 2 * k - 2 * ll()
        elif kind == "bic":
            out[kind] = k * log(n) - 2 * ll()
        elif kind == "rmse":
            out[kind] = sqrt(model.ssr / n)
        elif kind == "ssr":
            out[kind] = model.ssr
        elif kind == "sigma":
            out[kind] = sqrt(model.sigma2)
        elif kind == "deviance":
            out[kind] = model.stats.get("deviance", model.ssr)
        elif kind == "my":
            out[kind] = model.stats["mean_y"]
        elif kind == "theta":
            out[kind] = model.stats.get("theta", nan)
        elif kind == "g":
            from .vcov import vcov as compute

            df = compute(model, vcov if vcov is not None else model.default_vcov)[1]
            out[kind] = df + 1 if df != n - k else n - k
        elif kind in ("cor2",) or kind.endswith("r2"):
            out[kind] = r2(model, kind)
        elif kind == "f":
            has = 1 if model.sample.effects or model.sample.request.intercept else 0
            d1, d2 = max(k - has, 1), n - k
            f = (model.stats["ssr_null"] - model.ssr) / d1 / (model.ssr / d2)
            out[kind] = {"stat": f, "p": f_p(f, d1, d2), "df1": d1, "df2": d2}
        elif kind == "wf":
            d1, d2 = len(model.names), n - k
            f = (model.stats["ssr_fe"] - model.ssr) / d1 / (model.ssr / d2)
            out[kind] = {"stat": f, "p": f_p(f, d1, d2), "df1": d1, "df2": d2}
        elif kind in ("ivf", "ivf1", "ivfall"):
            out[kind] = {e: {a: b for a, b in first_stage(model, e).items() if a in ("stat", "p", "df1", "df2")} for e in model.sample.endo}
        elif kind in ("ivf2",):
            out[kind] = wald(model, "^fit_", "iid")
        elif kind.startswith("ivwald"):
            out[kind] = wald(model, "^fit_", vcov)
        elif kind == "wald":
            out[kind] = wald(model, None, vcov)
        elif kind == "wh":
            out[kind] = wu_hausman(model)
        elif kind == "sargan":
            out[kind] = sargan(model)
        elif kind == "cd":
            out[kind] = cragg_donald(model)
        elif kind == "kpr":
            out[kind] = kleibergen_paap(model)
        elif kind in ("lr", "wlr"):
            base = _null(model) if kind == "lr" else _only_effects(model)
            d = k - 1 if kind == "lr" else len(model.names)
            stat = 2 * (ll() - base)
            out[kind] = {"stat": stat, "p": chi2_p(stat, d), "df": d}
        else:
            raise ValueError(f"no such statistic: {kind}")
    return out


def degrees_freedom(model, kind: str = "resid", vcov=None) -> float:
    """k, resid or t."""
    from .vcov import vcov as compute

    if kind == "k":
        return model.nparams
    return model.n - model.nparams if kind == "resid" else compute(model, vcov if vcov is not None else model.default_vcov)[1]


__all__ = ["degrees_freedom", "fitstat", "inf", "register", "r2", "wald"]
