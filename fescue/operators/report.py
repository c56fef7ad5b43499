"""Fits side by side, as a data frame or LaTeX, and the numbers behind coefficient plots."""

from __future__ import annotations

import re

import pandas as pd

from .estimate import Model
from .models import ModelSet

STARS_TEX, STARS = ((0.01, "***"), (0.05, "**"), (0.1, "*")), ((0.001, "***"), (0.01, "**"), (0.05, "*"), (0.1, "."))
_dict: dict[str, str] = {}


def set_names(names: dict[str, str]) -> None:
    _dict.update(names)


def _flat(models) -> list[Model]:
    return [m for x in (models if isinstance(models, (list, tuple, ModelSet)) else [models]) for m in (x if isinstance(x, ModelSet) else [x])]


def number(x: float, digits: int = 4) -> str:
    return "" if x != x else f"{x:,.{digits}g}" if abs(x) < 10**digits else f"{x:,.0f}"


def etable(models, vcov=None, keep=None, drop=None, order=None, names: dict | None = None, stats: tuple = ("n", "r2"), coefstat: str = "se", digits: int = 4, headers: list | None = None, extra: dict | None = None, tex: bool = False, stars: bool = True, title: str | None = None) -> pd.DataFrame | str:
    """A row for each coefficient (estimate, stars, and its standard error, t or interval in brackets), effect and statistic."""
    models, names = _flat(models), _dict | (names or {})
    label = lambda n: ":".join(names.get(p, p) for p in n.split(":")) if n not in names else names[n]
    rows: dict[str, list] = {}
    for k, m in enumerate(models):
        t = m.coeftable(vcov, keep=keep, drop=drop, order=order)
        ci = m.confint(vcov=vcov).set_index("term") if coefstat == "confint" else None
        for r in t.itertuples():
            mark = next((s for p, s in (STARS_TEX if tex else STARS) if r.p_value < p), "") if stars else ""
            extra_text = {"se": number(r.std_error, digits), "tstat": number(r.t_value, digits)}.get(coefstat) or f"{number(ci.low[r.term], digits)}; {number(ci.high[r.term], digits)}"
            rows.setdefault(label(r.term), [""] * len(models))[k] = f"{number(r.estimate, digits)}{'$^{' + mark + '}$' if tex and mark else mark} ({extra_text})"
    effects = list(dict.fromkeys(e.name for m in models for e in m.sample.effects))
    for e in effects:
        rows[f"FE: {label(e)}"] = ["Yes" if e in {x.name for x in m.sample.effects} else "No" for m in models]
    for s in stats:
        got = [m.fitstat(s)[s] for m in models]
        rows[s] = [number(g["stat"] if isinstance(g, dict) else g, 6 if s == "n" else digits) for g in got]
    for name, values in (extra or {}).items():
        rows[name] = list(values)
    out = pd.DataFrame.from_dict(rows, orient="index", columns=headers or [f"({k + 1}) {m.sample.request.lhs}" for k, m in enumerate(models)])
    return to_latex(out, title) if tex else out


def to_latex(table: pd.DataFrame, title: str | None = None) -> str:
    clean = lambda x: re.sub(r"([&%#_])", r"\\\1", str(x))
    lines = [" & ".join([clean(i), *[v if "$" in str(v) else clean(v) for v in row]]) + r" \\" for i, row in zip(table.index, table.to_numpy().tolist())]
    head = " & ".join(["", *map(clean, table.columns)]) + r" \\"
    body = "\n".join([r"\begin{tabular}{l" + "c" * len(table.columns) + "}", r"\hline", head, r"\hline", *lines, r"\hline", r"\end{tabular}"])
    return body if not title else "\n".join([r"\begin{table}", rf"\caption{{{clean(title)}}}", body, r"\end{table}"])


def coefplot(models, vcov=None, keep=None, drop=None, level: float = 0.95) -> pd.DataFrame:
    """model, term, estimate, low, high: what a plot of coefficients draws."""
    parts = []
    for k, m in enumerate(_flat(models)):
        t = m.coeftable(vcov, keep=keep, drop=drop).merge(m.confint(level, vcov), on="term")
        parts.append(t[["term", "estimate", "low", "high"]].assign(model=k + 1))
    return pd.concat(parts, ignore_index=True)


def iplot(model: Model, vcov=None, level: float = 0.95) -> pd.DataFrame:
    """The same for the levels of the first i() term."""
    t = coefplot(model, vcov, level=level)
    got = t.term.str.extract(r"^(.+?)::([^:]+)(?::(.*))?$")
    first = got[0].dropna().iloc[0]
    return t.assign(variable=got[0], level=got[1])[got[0] == first].reset_index(drop=True)
