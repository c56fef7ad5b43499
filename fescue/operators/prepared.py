"""Regressions that share rows and effects: the rows are read and absorbed once, each regression is solved from the products."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import t_p
from ..plans.formula import call, parse
from ..sources.shared import cut
from .absorb import Absorbed, absorb
from .estimate import Sample, level_counts, parameters, sample
from .moments import drop_collinear, usable


@dataclass
class Prepared:
    """Products of outcomes and regressors, free of the effects. Outcomes are known by their expressions, regressors by their
    names. A regression asks for no row: coef, table and coefs read the products only; another() adds an outcome."""

    sample: Sample
    outcomes: list[str]
    rows: DataFrame
    absorbed: Absorbed
    shift: np.ndarray
    gram: np.ndarray
    noise: np.ndarray
    n: int
    sizes: list[int]
    tol: float = 1e-9

    def _place(self, outcome: str | None, regressors: list[str] | None) -> tuple[int, list[int]]:
        y = self.outcomes.index(outcome) if outcome else 0
        names = self.sample.x if regressors is None else [n for n in self.sample.x if n == "(Intercept)" or n in regressors]
        if regressors and (unknown := set(regressors) - set(self.sample.x)):
            raise KeyError(f"not prepared: {sorted(unknown)}")
        return y, [len(self.outcomes) + self.sample.x.index(n) for n in names]

    def _solve(self, outcome: str | None, regressors: list[str] | None) -> tuple[list[str], np.ndarray, np.ndarray, float]:
        y, x = self._place(outcome, regressors)
        kept = [x[k] for k in drop_collinear(self.gram[np.ix_(x, x)], self.tol, self.noise[x])]
        names = [self.sample.x[k - len(self.outcomes)] for k in kept]
        bread = np.linalg.inv(self.gram[np.ix_(kept, kept)]) if kept else np.zeros((0, 0))
        beta = bread @ self.gram[kept, y]
        ssr = float(max(self.gram[y, y] - beta @ self.gram[kept, y], 0.0))
        if "(Intercept)" in names:
            # The columns were moved to their means; the intercept is told for the columns as they are.
            at, back = names.index("(Intercept)"), np.eye(len(names))
            back[at] -= self.shift[kept]
            beta, bread = back @ beta, back @ bread @ back.T
            beta[at] += self.shift[y]
        return names, beta, bread, ssr

    def coef(self, outcome: str | None = None, regressors: list[str] | None = None) -> dict[str, float]:
        names, beta, _, _ = self._solve(outcome, regressors)
        return dict(zip(names, map(float, beta)))

    def table(self, outcome: str | None = None, regressors: list[str] | None = None) -> pd.DataFrame:
        """Estimates with standard errors for errors of one variance."""
        names, beta, bread, ssr = self._solve(outcome, regressors)
        df = max(self.n - parameters(len(names), self.sample, self.sizes), 1)
        se = np.sqrt(np.diag(bread) * ssr / df)
        t = beta / se
        return pd.DataFrame({"term": names, "estimate": beta, "std_error": se, "t_value": t, "p_value": [t_p(abs(v), df) for v in t]})

    def coefs(self) -> pd.DataFrame:
        """A row for each outcome, a column for each regressor."""
        return pd.DataFrame([{"outcome": y} | self.coef(y) for y in self.outcomes])

    @cached_property
    def demeaned(self) -> DataFrame:
        """The rows with what the effects leave of the regressors (_m_...), written once."""
        return cut(self.absorbed.without(self.rows, only=self.sample.xcols), "prepared")

    def another(self, outcome: str, regressors: list[str] | None = None) -> dict[str, float]:
        """Coefficients for an outcome that was not prepared. Regressors that are free of the effects need only their products with the
        outcome as it is, so nothing is absorbed again; the rows are those prepared, without those that lack the outcome,
        of which there may be none."""
        _, x = self._place(None, regressors)
        kept = [x[k] for k in drop_collinear(self.gram[np.ix_(x, x)], self.tol, self.noise[x])]
        w = F.col(self.sample.weight) if self.sample.weight else F.lit(1.0)
        y, cols = F.expr(outcome).cast("double"), [f"_m__x{k - len(self.outcomes)}" for k in kept]
        # A mean is taken off first, so that products keep their digits; the effects or the intercept take it up.
        mean, whole, n = self.demeaned.agg(F.sum(w * y) / F.sum(w), F.count_if(usable(y)), F.count("*")).first()
        if whole < n:
            raise ValueError(f"{n - whole} of the prepared rows have no {outcome}; prepare it with the others")
        if not (self.sample.effects or self.sample.request.intercept):
            mean = 0.0
        got = self.demeaned.agg(*[F.sum(w * (y - mean) * F.col(c)) for c in cols]).first() if cols else ()
        names = [self.sample.x[k - len(self.outcomes)] for k in kept]
        beta = np.linalg.solve(self.gram[np.ix_(kept, kept)], np.array(got, float)) if kept else np.zeros(0)
        if "(Intercept)" in names:
            at = names.index("(Intercept)")
            beta[at] += mean - beta @ self.shift[kept]
        return dict(zip(names, map(float, beta)))


def prepare(df: DataFrame, formula: str, weights: str | None = None, collin_tol: float = 1e-9, fixef_tol: float = 1e-10, **values) -> Prepared:
    """Rows and products for all regressions that a formula's outcomes and terms can make: c(y1, ..., y10) ~ x1 + x2 | f reads the
    rows once (twice where means are taken off first, that is without effects). The rows are those without a gap in any outcome,
    term or effect, so a regression that would have more rows alone is another one there. Effects are the same for all;
    instruments and offsets are not prepared."""
    requests = parse(formula, df.columns, **values)
    if len({r.effects for r in requests}) > 1 or any(r.endo or r.inst or any((call(t) or [""])[0] == "offset" for t in r.rhs) for r in requests):
        raise ValueError("prepared regressions have the same effects and neither instruments nor offsets")
    outcomes = list(dict.fromkeys(r.lhs for r in requests))
    rhs = tuple(dict.fromkeys(t for r in requests for t in r.rhs))
    ys = {f"_y{k}": F.expr(y).cast("double") for k, y in enumerate(outcomes)}
    whole = F.lit(True)
    for c in ys.values():
        whole = whole & usable(c)
    s = sample(df.where(whole), replace(requests[0], rhs=rhs), weights)
    rows, cols = s.df.withColumns(ys), [*ys, *s.xcols]
    shift = np.zeros(len(cols))
    if s.request.intercept and not s.blocks:
        w = F.col(s.weight) if s.weight else F.lit(1.0)
        means = rows.agg(*[F.sum(w * F.col(c)) / F.sum(w) for c in cols]).first()
        shift = np.array([0.0 if c == "_x0" or v is None else v for c, v in zip(cols, means)])
        rows = rows.withColumns({c: F.col(c) - float(v) for c, v in zip(cols, shift) if v and c != "_x0"})
    a = absorb(rows, s.blocks, cols, s.weight, fixef_tol)
    sizes = [a.levels[k] for k in s.keys()] if all(k in a.levels for k in s.keys()) else level_counts(s)
    return Prepared(s, outcomes, rows, a, shift, a.gram, np.broadcast_to(np.asarray(0.0 if a.noise is None else a.noise), (len(cols),)), a.rows, sizes, collin_tol)
