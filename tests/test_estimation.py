"""Fits held against dense algebra with explicit dummies on the same rows."""

import numpy as np
import pandas as pd
import pytest

import fescue as fe
from fescue.operators.absorb import absorb
from fescue.operators.estimate import sample
from fescue.plans.formula import parse


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n = 400
    f, g = rng.integers(0, 12, n), rng.integers(0, 7, n)
    x1, x2, z = rng.normal(size=n), rng.normal(size=n) + 0.1 * f, rng.normal(size=n)
    x1 = x1 + 0.7 * z
    y = x1 - 0.5 * x2 + 0.3 * f - 0.2 * g + rng.normal(size=n)
    p = pd.DataFrame({"y": y, "x1": x1, "x2": x2, "z": z, "f": f, "g": [f"g{k}" for k in g], "w": rng.uniform(0.5, 2, n), "c": rng.poisson(np.exp(0.3 * x1 + 0.05 * f)), "cl": rng.integers(0, 20, n)})
    p["b"] = (x1 + rng.logistic(size=n) > 0).astype(int)
    return p, spark.createDataFrame(p).cache()


def dummies(p, *cols):
    return np.hstack([pd.get_dummies(p[c]).to_numpy(float) for c in cols])


def ols(y, x, w=None):
    s = np.sqrt(np.ones(len(y)) if w is None else w)
    return np.linalg.lstsq(x * s[:, None], y * s, rcond=None)[0]


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("effects", ["", "f", "f + g", "f^g", "f[z]", "f + g[[z]]"])
def test_ols_equals_dummies(data, effects, weights):
    p, df = data
    m = fe.feols(df, "y ~ x1 + x2" + (f" | {effects}" if effects else ""), weights=weights)
    parts = [p[["x1", "x2"]].to_numpy()]
    z = p.z.to_numpy()[:, None]
    if not effects:
        parts.append(np.ones((len(p), 1)))
    elif effects == "f^g":
        parts.append(pd.get_dummies(p.f.astype(str) + p.g).to_numpy(float))
    else:
        parts.append(dummies(p, "f"))
        if effects == "f + g":
            parts.append(dummies(p, "g"))
        if effects == "f[z]":
            parts.append(dummies(p, "f") * z)
        if effects == "f + g[[z]]":
            parts.append(dummies(p, "g") * z)
    w = p.w.to_numpy() if weights else None
    x = np.hstack(parts)
    b = ols(p.y.to_numpy(), x, w)
    assert m.coef["x1"] == pytest.approx(b[0], abs=1e-7) and m.coef["x2"] == pytest.approx(b[1], abs=1e-7)
    e = p.y.to_numpy() - x @ b
    assert m.ssr == pytest.approx(float((e**2 * (w if weights else 1)).sum()), rel=1e-7)
    assert np.allclose(np.sort(m.residuals().toPandas().residual), np.sort(e), atol=1e-5)


def test_iterated_equals_exact(data):
    _, df = data
    s = sample(df, parse("y ~ x1 | f + g")[0])
    a, b = absorb(s.df, s.blocks, ["_y", "_x0"], dense=0), absorb(s.df, s.blocks, ["_y", "_x0"])
    assert a.iterations > 0 and np.allclose(a.gram, b.gram, rtol=1e-8)


def irls(y, x, inverse, slope, variance, eta):
    for _ in range(60):
        mu = inverse(eta)
        w = slope(eta) ** 2 / variance(mu)
        b = ols(eta + (y - mu) / slope(eta), x, w)
        eta = x @ b
    return b


def test_poisson_and_logit_equal_irls(data):
    p, df = data
    x = np.hstack([p[["x1"]].to_numpy(), dummies(p, "f", "g")])
    b = irls(p.c.to_numpy(float), x, np.exp, np.exp, lambda m: m, np.log(p.c.to_numpy() + 0.1))
    assert fe.fepois(df, "c ~ x1 | f + g").coef["x1"] == pytest.approx(b[0], abs=1e-6)
    sig = lambda e: 1 / (1 + np.exp(-e))
    x = np.hstack([np.ones((len(p), 1)), p[["x1", "x2"]].to_numpy()])
    b = irls(p.b.to_numpy(float), x, sig, lambda e: sig(e) * (1 - sig(e)), lambda m: m * (1 - m), np.zeros(len(p)))
    m = fe.felogit(df, "b ~ x1 + x2")
    assert [m.coef[k] for k in ("(Intercept)", "x1", "x2")] == pytest.approx(list(b), abs=1e-6)


def test_cluster_and_hc1(data):
    p, df = data
    x = np.hstack([np.ones((len(p), 1)), p[["x1", "x2"]].to_numpy()])
    b = ols(p.y.to_numpy(), x)
    e, bread, (n, k) = p.y.to_numpy() - x @ b, np.linalg.inv(x.T @ x), x.shape
    m = fe.feols(df, "y ~ x1 + x2")
    s = x * e[:, None]
    assert np.allclose(m.vcov("hetero"), bread @ s.T @ s @ bread * n / (n - k))
    c = pd.DataFrame(s).groupby(p.cl.to_numpy()).sum().to_numpy()
    assert np.allclose(m.vcov("~cl"), bread @ c.T @ c @ bread * len(c) / (len(c) - 1) * (n - 1) / (n - k))
    assert np.allclose(m.vcov("iid"), bread * (e @ e) / (n - k))


def test_degrees_of_freedom(spark):
    # Two irregular effects; the number of parameters counted is known for each rule.
    f1, f2 = [1, 1, 1, 1, 2, 2, 2, 3, 3, 3] * 2, [1, 1, 2, 2, 3, 3, 4, 4, 5, 5] * 2
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(a), float(b), i, j) for a, b, i, j in zip(rng.normal(size=20), rng.normal(size=20), f1, f2)], "y double, x double, f1 int, f2 int")
    from fescue.operators.vcov import parameters_counted

    m = fe.feols(df, "y ~ x | f1 + f2")
    got = {k: parameters_counted(m, ("f1",), fe.Ssc(fixef_K=k)) for k in ("none", "nested", "full")}
    assert got == {"none": 1, "nested": 6, "full": 8}
    assert parameters_counted(m, ("f1",), fe.Ssc(fixef_K="full", exact=True)) == 7
    assert parameters_counted(m, ("f1", "f2"), fe.Ssc()) == 2


def test_two_stage_equals_two_steps(data):
    p, df = data
    x = np.hstack([np.ones((len(p), 1)), p[["x2"]].to_numpy()])
    z = np.hstack([x, p[["z"]].to_numpy()])
    hat = z @ ols(p.x1.to_numpy(), z)
    b = ols(p.y.to_numpy(), np.hstack([hat[:, None], x]))
    m = fe.feols(df, "y ~ x2 | x1 ~ z")
    assert m.coef["fit_x1"] == pytest.approx(b[0]) and m.coef["x2"] == pytest.approx(b[2])
    e = p.y.to_numpy() - np.hstack([p[["x1"]].to_numpy(), x]) @ b
    assert m.ssr == pytest.approx(e @ e)


def test_collinear_and_missing(spark, data):
    _, df = data
    d = df.selectExpr("*", "5.0 as k", "x1 * 2 as twice", "if(f = 3, double('NaN'), x2) as gap")
    assert fe.feols(d, "y ~ x1 + k + twice").collinear == ["k", "twice"]
    assert fe.feols(d, "y ~ gap").n == df.where("f <> 3").count()
    with pytest.raises(ValueError):
        fe.feols(d, "k ~ x1")
    with pytest.raises(ValueError):
        fe.feols(d.withColumn("m", -d.w), "y ~ x1", weights="m")


def test_predict_and_effects(data):
    p, df = data
    m = fe.feols(df, "y ~ x1 | f + g")
    got = m.predict(df).toPandas()
    assert np.allclose(np.sort(got.y - got.prediction), np.sort(m.residuals().toPandas().residual))
    new = df.limit(1).selectExpr("y", "x1", "999 as f", "g", "z", "w")
    assert m.predict(new).first()["prediction"] is None
    fx = {k: v.toPandas() for k, v in m.fixef().items()}
    assert fx["g"].set_index("key").c0["g0"] == pytest.approx(0)
    x = np.hstack([p[["x1"]].to_numpy(), dummies(p, "f"), dummies(p, "g")[:, 1:]])
    b = ols(p.y.to_numpy(), x)
    assert np.allclose(fx["f"].sort_values("key").c0, b[1:13], atol=1e-7)


def test_negative_binomial_recovers_theta(spark):
    rng = np.random.default_rng(5)
    n = 3000
    x = rng.normal(size=n)
    y = rng.poisson(np.exp(1 + 0.5 * x) * rng.gamma(2.0, 0.5, n))
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y}))
    m = fe.fenegbin(df, "y ~ x")
    assert m.stats["theta"] == pytest.approx(2.0, rel=0.2) and m.coef["x"] == pytest.approx(0.5, abs=0.06)


def test_nonlinear_equals_linear(data):
    _, df = data
    m = fe.fenmlm(df, "y ~ 1", "a * x1 + a * b * x2", {"a": 0.5, "b": 0.5})
    lin = fe.feols(df, "y ~ x1 + x2")
    assert m.coef["a"] == pytest.approx(lin.coef["x1"], abs=1e-6) and m.coef["a"] * m.coef["b"] == pytest.approx(lin.coef["x2"], abs=1e-6)


def test_staggered_effects(spark):
    ds = spark.range(60 * 8).selectExpr("id div 8 as i", "id % 8 + 1 as t").selectExpr("*", "case when i < 20 then 1000 when i < 40 then 4 else 6 end as g").selectExpr("*", "i * 0.1 + t * 0.2 + if(t >= g, 1.0 + 0.5 * (t - g), 0) as y")
    t = fe.aggregate(fe.sunab(ds, "y ~ 1 | i + t", "g", "t"), "period").set_index("term").estimate
    assert t["t::0"] == pytest.approx(1.0) and t["t::2"] == pytest.approx(2.0) and t["t::-3"] == pytest.approx(0.0, abs=1e-9)
