"""Differences in differences: cohorts over relative periods, their aggregates, and means by group."""

from __future__ import annotations

import re
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dist import t_p
from ..sources.shared import cut
from .estimate import Model
from .models import feols


def cohorts(df: DataFrame, cohort: str, period: str) -> DataFrame:
    """cohort, first and last relative period, never and always treated: one small row for each cohort. A cohort that is not
    among the periods was never treated, nor was one without a period of treatment."""
    periods = df.select(F.expr(period).alias("p")).distinct()
    seen = df.select(F.expr(cohort).alias("cohort"), (F.expr(period) - F.expr(cohort)).alias("rel")).groupBy("cohort").agg(F.min("rel").alias("first"), F.max("rel").alias("last"))
    out = seen.join(periods.withColumn("known", F.lit(True)), F.col("cohort") == F.col("p"), "left")
    never = F.col("known").isNull() & (F.col("cohort").isNull() | (F.col("last") < 0) | ~F.coalesce(F.col("last") >= 0, F.lit(False)) | F.col("known").isNull())
    return out.select("cohort", "first", "last", (never | F.coalesce(F.col("last") < 0, F.lit(True))).alias("never"), F.coalesce(F.col("known") & (F.col("first") >= 0), F.lit(False)).alias("always"))


def sunab(df: DataFrame, formula: str, cohort: str, period: str, ref_p: list[int] = (-1,), ref_c: list = (), bin_rel: str | None = None, **kw) -> Model:
    """feols with a 0/1 column for each treated cohort and relative period (Sun and Abraham, 2021).

    formula: outcome ~ other terms | effects. Never treated cohorts and those in ref_c are the reference, the relative periods
    ref_p are left out, and the rows of always treated cohorts are dropped. Columns are named period::r:cohort::c.

    The rows are written once, as all passes of the fit read them and what they come from may be dear."""
    df = cut(df, "panel")
    kinds = cohorts(df, cohort, period).collect()
    always = [r["cohort"] for r in kinds if r["always"]]
    treated = sorted(r["cohort"] for r in kinds if not r["never"] and not r["always"] and r["cohort"] not in ref_c)
    rel = F.expr(period) - F.expr(cohort)
    if always:
        df = df.where(F.expr(cohort).isNull() | ~F.expr(cohort).isin(*always))
    if bin_rel:
        k = int(bin_rel.split("::")[1])
        rel = F.floor(rel / k) * k
    df = df.withColumn("__rel", rel)
    cells = [(r["r"], r["c"]) for r in df.select(F.col("__rel").alias("r"), F.expr(cohort).alias("c")).distinct().collect() if r["c"] in treated and r["r"] not in ref_p]
    names, cols = {}, {}
    for r, c in sorted(cells):
        made = f"__sa_{str(r).replace('-', 'm')}_{str(c).replace('-', 'm')}"
        cols[made] = F.coalesce(((F.col("__rel") == r) & (F.expr(cohort) == c)), F.lit(False)).cast("double")
        names[made] = f"{period}::{r}:cohort::{c}"
    lhs, _, right = formula.partition("~")
    first, bar, rest = right.partition("|")
    text = f"{lhs}~ {' + '.join([*names, *( [first.strip()] if first.strip() not in ('', '1') else [])])} {bar}{rest}"
    m = feols(df.withColumns(cols), text, **kw)
    m.names = [names.get(n, n) for n in m.names]
    m.sample.x = [names.get(n, n) for n in m.sample.x]
    m.stats["sunab"] = True
    return m


def aggregate(model: Model, by: str = "period", vcov=None) -> pd.DataFrame:
    """Coefficients put together, weighed by the rows of each cell: by period, by cohort, into one effect of treatment (att), or
    by a regular expression of which the first group names the result."""
    pattern = {"period": r"^(.*::-?\d+):cohort::", "cohort": r"::\d+:(cohort::.*)$", "att": r"^(.*)::\d+:cohort::"}.get(by, by)
    v, b = model.vcov(vcov), model.beta
    picks: dict[str, list[int]] = {}
    for k, n in enumerate(model.names):
        if m := re.search(pattern, n):
            picks.setdefault("ATT" if by == "att" else m[1] if m.groups() else m[0], []).append(k)
    used = sorted({k for ks in picks.values() for k in ks})
    w = F.col(model.sample.weight) if model.sample.weight else F.lit(1.0)
    where = {k: f"_x{model.sample.x.index(model.names[k])}" for k in used}
    got = model.sample.df.agg(*[F.sum(w * F.signum(F.col(where[k]))).alias(f"s{k}") for k in used]).first()
    rows = []
    for name, ks in picks.items():
        s = np.array([got[f"s{k}"] for k in ks], float)
        s = s / s.sum()
        est, se = float(s @ b[ks]), sqrt(max(float(s @ v[np.ix_(ks, ks)] @ s), 0.0))
        t = est / se if se else float("nan")
        rows.append((name, est, se, t, t_p(t, model.n - model.nparams)))
    return pd.DataFrame(rows, columns=["term", "estimate", "std_error", "t_value", "p_value"])


def did_means(df: DataFrame, variables: list[str], treat: str, post: str | None = None) -> DataFrame:
    """variable, [post,] mean, sd and n of both groups, their difference and its t; one aggregate over all variables."""
    keys = [F.expr(post).alias("post")] if post else []
    long = df.select(F.expr(treat).cast("int").alias("g"), *keys, F.explode(F.array(*[F.struct(F.lit(v).alias("variable"), F.expr(v).cast("double").alias("x")) for v in variables])).alias("s")).select("g", *(["post"] if post else []), "s.*")
    out = long.where("x is not null and not isnan(x) and g in (0, 1)").groupBy("variable", *(["post"] if post else []))
    parts = []
    for g, name in ((1, "treated"), (0, "control")):
        x = F.when(F.col("g") == g, F.col("x"))
        parts += [F.avg(x).alias(f"mean_{name}"), F.stddev_samp(x).alias(f"sd_{name}"), F.count(x).alias(f"n_{name}")]
    out = out.agg(*parts).withColumn("difference", F.col("mean_treated") - F.col("mean_control"))
    se = F.sqrt(F.col("sd_treated") ** 2 / F.col("n_treated") + F.col("sd_control") ** 2 / F.col("n_control"))
    return out.withColumn("t_value", F.try_divide(F.col("difference"), se))
