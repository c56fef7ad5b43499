"""Rows that share regressors and effects are put together: the fit is that of the rows, and turns read the sums only."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import fescue as fe
from fescue.operators import glm as G


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, g, w, c = rng.integers(0, 4, 900), rng.integers(0, 3, 900), rng.integers(1, 3, 900), rng.integers(0, 6, 900)
    data = [(float(a), int(b), float(d), float(e + (a > 1)), float((e + b) % 2)) for a, b, d, e in zip(x, g, w, c)]
    return spark.createDataFrame(data, "x double, g int, w double, c double, b double").coalesce(2).cache()


@pytest.mark.parametrize("family,y,rhs", [("poisson", "c", "x | g"), ("probit", "b", "x"), ("Gamma", "exp(c / 4)", "x"), ("negbin", "c", "x")])
def test_a_merged_fit_is_the_fit_of_the_rows(rows, monkeypatch, family, y, rhs):
    fit = lambda: fe.fenegbin(rows, f"{y} ~ {rhs}", weights="w") if family == "negbin" else fe.feglm(rows, f"{y} ~ {rhs}", family, weights="w", glm_tol=1e-11)
    read, fitted = [], G.fit
    monkeypatch.setattr(G, "fit", lambda *a, **k: read.append(k["rows"].count()) or fitted(*a, **k))
    one = fit()
    assert max(read) <= 12 * (7 if family == "negbin" else 1)
    monkeypatch.setattr(G, "MERGED", float("inf"))
    two = fit()
    assert max(read) == 900 == one.n == two.n and one.stats["converged"]
    assert one.beta == pytest.approx(two.beta, rel=1e-6, abs=1e-8) and one.ssr == pytest.approx(two.ssr, rel=1e-8)
    for kind in ("iid", "hetero"):
        assert one.coeftable(kind).std_error.tolist() == pytest.approx(two.coeftable(kind).std_error.tolist(), rel=1e-5)
    same = ["deviance", "ll", "ll_null", "working_ssr"] if family != "negbin" else ["theta", "theta_se", "ll", "ll_null"]
    assert [one.stats[k] for k in same] == pytest.approx([two.stats[k] for k in same], rel=1e-6, nan_ok=True)
    assert one.residuals("deviance").agg(F.sum("residual")).first()[0] == pytest.approx(two.residuals("deviance").agg(F.sum("residual")).first()[0], rel=1e-5)
