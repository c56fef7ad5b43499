"""Least squares and two-stage least squares with absorbed effects: the sample, the fit, and what is kept of it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.dist import t_p, t_quantile
from ..plans.formula import Effect, Request, call, split_top
from .absorb import DOUBT, ROUNDED, Absorbed, Block, absorb
from .moments import drop_collinear, usable

NUMERIC = (T.NumericType, T.BooleanType)


def term_columns(df: DataFrame, term: str, contrast: bool) -> list[tuple[str, Column]]:
    """Named double columns of one term. Text columns and factor() give a 0/1 column for each level but, with contrast, the
    first; i() is described at columns.factor_columns; a:b multiplies; any other term is a Spark SQL expression."""
    c = call(term)
    if c and c[0] == "i":
        _, args, named = c
        second = args[1] if len(args) > 1 else named.get("var")
        force = bool(second) and second.startswith("i.")
        bins = named.get("bin")
        return C.factor_columns(
            df, args[0], second[2:] if force else second, C.value_list(named.get("ref")), C.value_list(named.get("keep")) or None, bins.strip("'\"") if bins else None,
            ref2=C.value_list(named.get("ref2")), keep2=C.value_list(named.get("keep2")) or None, factor2=force, auto_ref=contrast and second is None,
        )
    if c and c[0] == "poly" and len(c[1]) == 2:
        value, degree = F.expr(c[1][0]).cast("double"), int(c[1][1])
        raw = c[2].get("raw", "").strip().lower() in ("true", "t")
        made = [F.pow(value, F.lit(float(k))) for k in range(1, degree + 1)] if raw else C.orthogonal(df, value, degree)
        return [(f"poly({c[1][0]}, {c[1][1]}){k}", p) for k, p in enumerate(made, 1)]
    if c and c[0] == "I":
        return [(term, F.expr(c[1][0]).cast("double"))]
    parts = split_top(term, ":")
    if len(parts) > 1:
        out = [("", F.lit(1.0))]
        for p in parts:
            out = [(f"{a}:{n}" if a else n, x * y) for a, x in out for n, y in term_columns(df, p, contrast)]
        return out
    inner = c[1][0] if c and c[0] == "factor" else term
    kind = df.select(F.expr(inner).alias("v")).schema["v"].dataType
    if (c and c[0] == "factor") or not isinstance(kind, NUMERIC):
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise ValueError(f"{term} is nested; take its parts out first")
        found = C.levels(df, F.expr(inner))
        return [(f"{term}{C.label(v)}", (F.expr(inner) == F.lit(v)).cast("double")) for v in (found[1:] if contrast else found)]
    return [(term, F.expr(inner).cast("double"))]


@dataclass
class Sample:
    df: DataFrame
    request: Request
    x: list[str]
    endo: list[str]
    inst: list[str]
    effects: tuple[Effect, ...]
    blocks: list[Block]
    weight: str | None = None
    offset: str | None = None
    columns: dict = field(default_factory=dict)  # design column: its Column over the source, for prediction

    @property
    def xcols(self) -> list[str]:
        return [f"_x{k}" for k in range(len(self.x))]

    def keys(self) -> list[str]:
        return [f"_f{k}" for k in range(len(self.effects))]


def key_column(e: Effect) -> Column:
    """One key as it is, several as their values in a struct, so that no two combinations are taken for one."""
    if len(e.keys) == 1:
        return F.expr(e.keys[0])
    return F.concat_ws("_", *[F.regexp_replace(F.expr(k).cast("string"), "_", "__") for k in e.keys])


def sample(df: DataFrame, request: Request, weights: str | None = None, offset: str | None = None, subset: str | Column | None = None, also: list[str] = (), fixef_rm: str = "none", family: str | None = None) -> Sample:
    """Rows that count: subset, then no null, NaN or infinity in any part and no zero weight, then one round of removing effect
    levels with a single row (fixef_rm singleton) or with outcomes all 0, or all 1 for logit (perfect), or both."""
    if subset is not None:
        df = df.where(subset)
    if m := [t for t in request.rhs if (c := call(t)) and c[0] == "offset"]:
        if offset:
            raise ValueError("offset is given twice")
        offset, request = call(m[0])[1][0], Request(**{**request.__dict__, "rhs": tuple(t for t in request.rhs if t not in m)})
    contrast = request.intercept or bool(request.effects)
    named = [nc for t in request.rhs for nc in term_columns(df, t, contrast)]
    x = [("(Intercept)", F.lit(1.0))] * request.intercept + named
    endo = [nc for t in request.endo for nc in term_columns(df, t, True)]
    inst = [nc for t in request.inst for nc in term_columns(df, t, True)]
    made = {f"_x{k}": c for k, (_, c) in enumerate(x)} | {f"_e{k}": c for k, (_, c) in enumerate(endo)} | {f"_z{k}": c for k, (_, c) in enumerate(inst)}
    cols = {"_y": F.expr(request.lhs).cast("double")} | made
    blocks = []
    for k, e in enumerate(request.effects):
        cols[f"_f{k}"] = key_column(e)
        blocks += [Block(f"_f{k}", None, k)] * e.level
        for j, s in enumerate(e.slopes):
            cols[f"_s{k}_{j}"] = F.expr(s).cast("double")
            blocks.append(Block(f"_f{k}", f"_s{k}_{j}", k))
    if weights:
        cols["_w"] = F.expr(weights).cast("double")
    if offset:
        cols["_o"] = F.expr(offset).cast("double")
    df = df.withColumns(cols)
    fine = F.lit(True)
    for name, c in cols.items():
        if not (name.startswith("_x") and request.intercept and name == "_x0"):
            fine = fine & (F.col(name).isNotNull() if name.startswith("_f") else usable(F.col(name)))
    for name in also:
        fine = fine & F.col(name).isNotNull()
    df = df.where(fine)
    if weights:
        if df.where("_w < 0").limit(1).count():
            raise ValueError("weights may not be negative")
        df = df.where("_w > 0")
    for k, e in enumerate(request.effects):
        if fixef_rm == "none":
            break
        cells = df.groupBy(F.col(f"_f{k}").alias("_key")).agg(F.count("*").alias("n"), F.min("_y").alias("a"), F.max("_y").alias("b"))
        bad = F.lit(False)
        if fixef_rm in ("singleton", "both"):
            bad = bad | (F.col("n") == 1)
        if fixef_rm in ("perfect", "both") and family in ("poisson", "negbin", "logit", "probit"):
            bad = bad | ((F.col("a") == 0) & (F.col("b") == 0))
            if family in ("logit", "probit"):
                bad = bad | ((F.col("a") == 1) & (F.col("b") == 1))
        df = df.join(cells.where(~bad).select("_key"), F.col(f"_f{k}") == F.col("_key"), "left_semi")
    return Sample(df, request, [n for n, _ in x], [n for n, _ in endo], [n for n, _ in inst], request.effects, blocks, "_w" if weights else None, "_o" if offset else None, made)


@dataclass
class Model:
    """A fit. Small matrices live on the driver; residuals, fitted values and scores are tables that are worked out on demand."""

    kind: str
    sample: Sample
    names: list[str]
    beta: np.ndarray
    bread: np.ndarray
    sigma2: float
    n: int
    nparams: int
    ssr: float
    absorbed: Absorbed
    combo: np.ndarray
    resid: np.ndarray
    collinear: list[str]
    sizes: list[int]
    stats: dict
    default_vcov: object = None
    ssc: object = None
    weight: str | None = None
    z: str = "_y"
    panel: tuple | None = None
    rows: DataFrame | None = None
    stages: dict = field(default_factory=dict)
    own_scores: object = None  # a function, where scores are more than weight * residual * regressor

    @property
    def coef(self) -> dict[str, float]:
        return dict(zip(self.names, self.beta.tolist()))

    @cached_property
    def score_rows(self) -> DataFrame:
        """All rows with _u (residual of the working regression) and _q0, _q1, ... (regressors free of the effects)."""
        df = self.absorbed.without(self.rows if self.rows is not None else self.sample.df)
        mix = lambda v: sum((float(a) * F.col("_m_" + c) for a, c in zip(v, self.absorbed.cols) if a), F.lit(0.0))
        keep = [c for c in df.columns if not c.startswith("_m_")]
        return df.select(*keep, mix(self.resid).alias("_u"), *[mix(self.combo[:, k]).alias(f"_q{k}") for k in range(len(self.names))])

    @property
    def scores(self) -> DataFrame:
        """Scores _g0, _g1, ... beside all columns of the sample."""
        if self.own_scores:
            return self.own_scores()
        df, w = self.score_rows, F.col(self.weight) if self.weight else F.lit(1.0)
        return df.withColumns({f"_g{k}": w * F.col("_u") * F.col(f"_q{k}") for k in range(len(self.names))})

    def effect_tables(self) -> list[tuple[list[Block], DataFrame]]:
        """(blocks, key and a coefficient for each block) of every grouping."""
        out = []
        for blocks, table in self.absorbed.tables:
            mix = [sum((float(r) * F.col(f"a{b}_{i}") for i, r in enumerate(self.resid) if r), F.lit(0.0)).alias(f"c{b}") for b in range(len(blocks))]
            out.append((blocks, table.select("key", *mix)))
        return out

    def vcov(self, kind=None, ssc=None) -> np.ndarray:
        from .vcov import vcov

        return vcov(self, kind if kind is not None else self.default_vcov, ssc)[0]

    def coeftable(self, vcov=None, ssc=None, keep: str | None = None, drop: str | None = None, order: str | None = None) -> pd.DataFrame:
        from .vcov import vcov as compute

        v, df = compute(self, vcov if vcov is not None else self.default_vcov, ssc)
        se = np.sqrt(np.diag(v))
        with np.errstate(divide="ignore", invalid="ignore"):
            t = self.beta / se
        used = None if self.kind in ("poisson", "logit", "probit", "negbin", "binomial") else df
        out = pd.DataFrame({"term": self.names, "estimate": self.beta, "std_error": se, "t_value": t, "p_value": [t_p(x, used) for x in t]})
        if keep:
            out = out[out.term.map(lambda n: bool(re.search(keep, n)))]
        if drop:
            out = out[~out.term.map(lambda n: bool(re.search(drop, n)))]
        if order:
            out = pd.concat([out[out.term.map(lambda n: bool(re.search(order, n)))], out[~out.term.map(lambda n: bool(re.search(order, n)))]])
        return out.reset_index(drop=True)

    def confint(self, level: float = 0.95, vcov=None, ssc=None) -> pd.DataFrame:
        from .vcov import vcov as compute

        v, df = compute(self, vcov if vcov is not None else self.default_vcov, ssc)
        q = t_quantile(1 - (1 - level) / 2, None if self.kind in ("poisson", "logit", "probit", "negbin", "binomial") else df)
        se = np.sqrt(np.diag(v))
        return pd.DataFrame({"term": self.names, "low": self.beta - q * se, "high": self.beta + q * se})

    def table(self, vcov=None, ssc=None) -> DataFrame:
        """The coefficient table as a Spark table."""
        t = self.coeftable(vcov, ssc)
        return self.sample.df.sparkSession.createDataFrame(list(t.itertuples(index=False, name=None)), "term string, estimate double, std_error double, t_value double, p_value double")

    # What has a row for each row of the sample.

    def linear(self, df: DataFrame | None = None, fixef: bool = True) -> DataFrame:
        """df (the sample, or new rows) with _eta: the linear predictor; null where an effect's level is new."""
        s, new = self.sample, df is not None
        if new:
            made = dict(s.columns)
            for k, e in enumerate(s.effects):
                made[f"_f{k}"] = key_column(e)
                made |= {f"_s{k}_{j}": F.expr(x).cast("double") for j, x in enumerate(e.slopes)}
            df = df.withColumns(made)
            if s.offset:
                df = df.withColumn("_o", F.lit(0.0))
        else:
            df = s.df
        out = df
        eta = sum((float(b) * c for b, c in zip(self.beta, self._regressors())), F.lit(0.0))
        if fixef:
            for k, (blocks, table) in enumerate(self.effect_tables()):
                named = table.select(F.col("key").alias(f"_key{k}"), *[F.col(f"c{b}").alias(f"_c{k}_{b}") for b in range(len(blocks))])
                out = out.join(named, F.col(blocks[0].key) == F.col(f"_key{k}"), "left")
                for b, block in enumerate(blocks):
                    eta = eta + F.col(f"_c{k}_{b}") * (F.col(block.unit) if block.unit else F.lit(1.0))
        if s.offset:
            eta = eta + F.col("_o")
        return out.select(*df.columns, eta.alias("_eta"))

    def _regressors(self) -> list[Column]:
        """What the coefficients multiply: instrumented variables count with their own values."""
        where = {n: F.col(f"_x{k}") for k, n in enumerate(self.sample.x)} | {f"fit_{n}": F.col(f"_e{k}") for k, n in enumerate(self.sample.endo)}
        return [where[n] for n in self.names]

    def _mean(self, eta: Column) -> Column:
        from .glm import FAMILIES

        return FAMILIES[self.kind].inverse(eta) if self.kind in FAMILIES else eta

    def fitted(self, kind: str = "response") -> DataFrame:
        df = self.linear()
        return df.withColumn("fitted", self._mean(F.col("_eta")) if kind == "response" else F.col("_eta")).drop("_eta")

    def residuals(self, kind: str = "response") -> DataFrame:
        """kind: response, pearson, deviance or working."""
        from .glm import FAMILIES

        df = self.linear().withColumn("_mu", self._mean(F.col("_eta")))
        y, mu, w = F.col("_y"), F.col("_mu"), F.col(self.sample.weight) if self.sample.weight else F.lit(1.0)
        fam = FAMILIES.get(self.kind)
        if kind == "response":
            r = y - mu
        elif fam is None:
            r = (y - mu) * F.sqrt(w) if kind != "working" else y - mu
        elif kind == "pearson":
            r = (y - mu) * F.sqrt(w) / F.sqrt(fam.variance(mu))
        elif kind == "working":
            r = (y - mu) / fam.slope(F.col("_eta"))
        else:
            r = F.signum(y - mu) * F.sqrt(F.greatest(F.lit(0.0), w * fam.deviance(y, mu)))
        return df.withColumn("residual", r).drop("_eta", "_mu")

    def predict(self, df: DataFrame, kind: str = "response", fixef: bool = True, se: bool = False, level: float | None = None) -> DataFrame:
        """df with prediction; without effects also its standard error and interval."""
        out = self.linear(df, fixef)
        out = out.withColumn("prediction", self._mean(F.col("_eta")) if kind == "response" else F.col("_eta"))
        if se or level:
            if self.sample.effects:
                raise ValueError("standard errors of predictions need a model without fixed effects")
            v, x = self.vcov(), self._regressors()
            var = sum((float(v[i, j]) * x[i] * x[j] for i in range(len(x)) for j in range(len(x))), F.lit(0.0))
            out = out.withColumn("std_error", F.sqrt(var))
            if level:
                q = t_quantile(1 - (1 - level) / 2, self.n - self.nparams)
                out = out.withColumns({"low": F.col("prediction") - q * F.col("std_error"), "high": F.col("prediction") + q * F.col("std_error")})
        return out.drop("_eta", *[c for c in out.columns if c not in df.columns and re.match(r"_[xezfso]\d|_o$", c)])

    def hatvalues(self) -> DataFrame:
        if self.sample.effects:
            raise ValueError("hat values need a model without fixed effects")
        q, w = [F.col(f"_q{k}") for k in range(len(self.names))], F.col(self.weight) if self.weight else F.lit(1.0)
        h = sum((float(self.bread[i, j]) * q[i] * q[j] for i in range(len(q)) for j in range(len(q))), F.lit(0.0))
        return self.score_rows.withColumn("hat", w * h)

    def model_matrix(self, what: str = "rhs") -> DataFrame:
        """lhs, rhs, fixef, iv.endo, iv.inst or iv.exo as columns with their names."""
        s = self.sample
        pick = {
            "lhs": [("_y", s.request.lhs)], "rhs": [(f"_x{s.x.index(n)}", n) for n in self.names if n in s.x] + [(f"_e{k}", n) for k, n in enumerate(s.endo)], "fixef": [(f"_f{k}", e.name) for k, e in enumerate(s.effects)],
            "iv.endo": [(f"_e{k}", n) for k, n in enumerate(s.endo)], "iv.inst": [(f"_z{k}", n) for k, n in enumerate(s.inst)], "iv.exo": [(f"_x{k}", n) for k, n in enumerate(s.x)],
        }[what]
        return s.df.select(*[F.col(c).alias(n) for c, n in pick])

    def sparse_matrix(self, id_expr: str) -> DataFrame:
        """(row, column, value) of the non-zero regressors, for designs too wide for columns."""
        cols = F.array(*[F.struct(F.lit(n).alias("column"), c.alias("value")) for n, c in zip(self.names, self._regressors())])
        return self.sample.df.select(F.expr(id_expr).alias("row"), F.explode(cols).alias("c")).select("row", "c.column", "c.value").where("value <> 0")

    def fixef(self) -> dict[str, DataFrame]:
        """effect -> key, coefficient of its levels (c0, and a column for each slope). Of several effects, in each connected
        component all but the first have one level that counts as 0."""
        from .fixef import recover

        return recover(self)

    def fitstat(self, *kinds: str, vcov=None) -> dict:
        from .fitstat import fitstat

        return fitstat(self, kinds, vcov)

    def wald(self, keep: str | None = None, vcov=None) -> dict:
        from .fitstat import wald

        return wald(self, keep, vcov)

    def check_convergence(self) -> list[dict]:
        """The largest mean of the residual and regressors in any level of each effect; next to 0 where all are absorbed."""
        out, w = [], F.col(self.weight) if self.weight else F.lit(1.0)
        cols = ["_u", *[f"_q{k}" for k in range(len(self.names))]]
        for b in self.sample.blocks:
            u = F.col(b.unit) if b.unit else F.lit(1.0)
            cells = self.score_rows.groupBy(b.key).agg(*[(F.sum(w * u * F.col(c)) / F.sum(w * u * u)).alias(c) for c in cols])
            out.append({"effect": self.sample.effects[b.effect].name, "largest": cells.agg(F.max(F.greatest(*[F.abs(F.col(c)) for c in cols], F.lit(0.0)))).first()[0]})
        return out


def level_counts(s: Sample) -> list[int]:
    if not s.effects:
        return []
    if len(s.effects) == 1:
        return [s.df.select("_f0").distinct().count()]
    return list(s.df.agg(*[F.count_distinct(k) for k in s.keys()]).first())


def parameters(k: int, s: Sample, sizes: list[int]) -> int:
    """Coefficients, plus those of the effects' levels and slopes, less one for each effect with levels beyond the first."""
    if not s.effects:
        return k
    return k + sum(n * (len(e.slopes) + e.level) for n, e in zip(sizes, s.effects)) + 1 - sum(e.level for e in s.effects)


def fit(s: Sample, kind: str = "ols", tol: float = 1e-9, weight: str | None = None, y: str = "_y", rows: DataFrame | None = None, sizes: list[int] | None = None, fe_tol: float = 1e-10, dispersion: float | None = None) -> Model:
    """One weighted regression; all cross-products of outcome, regressors, endogenous variables and instruments come from one
    pass over the rows (and one over the groups of each effect)."""
    df = rows if rows is not None else s.df
    weight = weight or s.weight
    if s.offset and kind == "ols":
        df = df.withColumn("_yo", F.col(y) - F.col("_o"))
        y = "_yo"
    x, e, z = s.xcols, [f"_e{k}" for k in range(len(s.endo))], [f"_z{k}" for k in range(len(s.inst))]
    cols = [y, *e, *x, *z]
    one = "_one"
    df = df.withColumn(one, F.lit(1.0))
    a = absorb(df, s.blocks, [*cols, one], weight, fe_tol)
    near, raw, shift, n_w = a.raw, a.raw, np.zeros(len(cols) + 1), a.raw[-1, -1]
    if s.request.intercept and not s.blocks and not e and n_w:
        # Columns whose mean is large against what varies about it are moved there; the intercept takes that up.
        centre = np.append(near[-1, :-1] / n_w, 0.0)
        far = (np.diag(near) - n_w * centre**2 < DOUBT * np.diag(near)) & np.array([c not in (one, "_x0") for c in [*cols, one]])
        if far.any():
            shift = np.where(far, centre, 0.0)
            a = absorb(df.withColumns({c: F.col(c) - float(v) for c, v in zip(cols, shift) if v}), [], [*cols, one], weight, fe_tol)
            a.noise += ROUNDED**2 * np.where(far, np.diag(near), 0.0)
            near = a.raw
    n, counted, noise = a.rows, a.levels, a.noise
    g = a.gram[:-1, :-1]
    a = Absorbed(g, raw[:-1, :-1], a.tables, [*cols, one], a.iterations)
    ix, ie, iz = [cols.index(c) for c in x], [cols.index(c) for c in e], [cols.index(c) for c in z]
    stages: dict = {}
    if not e:
        kept = [ix[k] for k in drop_collinear(g[np.ix_(ix, ix)], tol, noise[ix])]
        names = [s.x[ix.index(k)] for k in kept]
        combo = np.zeros((len(cols) + 1, len(kept)))
        combo[kept, range(len(kept))] = 1
        dropped = [n for k, n in zip(ix, s.x) if k not in kept]
    else:
        order = [*iz, *ix]
        w = [order[k] for k in drop_collinear(g[np.ix_(order, order)], tol, noise[order])]
        inner = np.linalg.inv(g[np.ix_(w, w)])
        pi = inner @ g[np.ix_(w, ie)]
        keep_x = [k for k in ix if k in w]
        full = np.zeros((len(cols) + 1, len(ie) + len(keep_x)))
        full[w, : len(ie)] = pi
        full[keep_x, range(len(ie), len(ie) + len(keep_x))] = 1
        hat = full[:-1].T @ g @ full[:-1]
        stay = drop_collinear(hat, tol, noise[[*ie, *keep_x]])
        combo, names = full[:, stay], [[*[f"fit_{n}" for n in s.endo], *[s.x[ix.index(k)] for k in keep_x]][k] for k in stay]
        dropped = [n for k, n in zip(ix, s.x) if k not in w]
        stages = {"w": w, "pi": pi, "z": [k for k in w if k in iz], "x": keep_x, "e": ie, "inner": inner}
    lhs = combo[:-1].T @ g @ combo[:-1]
    bread = np.linalg.inv(lhs) if len(lhs) else lhs
    beta = bread @ (combo[:-1].T @ g[:, 0])
    resid = np.zeros(len(cols) + 1)
    resid[0] = 1
    for k, nm in enumerate(names):
        if nm.startswith("fit_") and nm[4:] in s.endo:
            resid[ie[s.endo.index(nm[4:])]] -= beta[k]
        else:
            resid[ix[s.x.index(nm)]] -= beta[k]
    ssr = float(max(resid[:-1] @ g @ resid[:-1], 0.0))
    if not s.blocks and shift.any():
        # What was solved for are the moved columns; the slopes are the same, the intercept is told for the columns as they are.
        at = names.index("(Intercept)")
        back = np.eye(len(names))
        back[at] -= shift[kept]
        beta, bread = back @ beta, back @ bread @ back.T
        beta[at] += shift[0]
        resid[kept[at]] = -beta[at]
        g = raw[:-1, :-1]
    if sizes is None:
        sizes = [counted[k] for k in s.keys()] if all(k in counted for k in s.keys()) else level_counts(s)
    nparams = parameters(len(names), s, sizes)
    sigma2 = (ssr / max(n - nparams, 1)) if dispersion is None else dispersion
    mean_y = raw[0, -1] / n_w if n_w else float("nan")
    ssr_null = float(near[0, 0] - near[0, -1] ** 2 / n_w if n_w and (s.request.intercept or s.effects) else raw[0, 0])
    if s.blocks and kind == "ols" and ssr_null < DOUBT * near[0, 0]:
        ssr_null = df.agg(F.sum((F.col(weight) if weight else F.lit(1.0)) * (F.col(y) - float(mean_y)) ** 2)).first()[0]
    stats = {"mean_y": mean_y, "ssr_null": ssr_null, "ssr_fe": float(a.gram[0, 0]), "sum_w": float(n_w), "gram": g, "raw": raw}
    if stats["ssr_null"] <= ROUNDED**2 * max(raw[0, 0], 1e-300) and kind == "ols" and (s.request.intercept or s.effects):
        raise ValueError("the outcome is constant")
    return Model(kind, s, names, beta, bread, sigma2, n, nparams, ssr, a, combo, resid, dropped, sizes, stats, weight=weight, z=y, rows=df, stages=stages)
