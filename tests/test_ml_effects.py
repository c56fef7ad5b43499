"""Maximum likelihood with an effect, held against dense dummies, numeric derivatives and plain numpy."""

from math import lgamma

import numpy as np
import pytest
from pyspark.sql import functions as F

import fescue as fe
from fescue.operators.estimate import sample
from fescue.operators.glm import FAMILIES, feglm_fit, negbin
from fescue.operators.levels import solve_levels
from fescue.plans.formula import parse


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 800
    g, h, x, w = rng.integers(0, 12, n), rng.integers(0, 5, n), rng.normal(size=n), rng.integers(1, 4, n)
    mu = np.exp(0.6 * x + 0.15 * g - 0.5)
    c, b = rng.negative_binomial(1.7, 1.7 / (1.7 + mu)), (rng.uniform(size=n) < 1 / (1 + np.exp(-(x + 0.3 * g - 2)))).astype(int)
    a = {"g": g, "h": h, "x": x, "w": w, "c": c, "b": b}
    return spark.createDataFrame([tuple(v[k].item() for v in a.values()) for k in range(n)], "g int, h int, x double, w int, c int, b int").cache(), a


def loglik(p, design, y):
    t, mu = np.exp(p[-1]), np.exp(design @ p[:-1])
    return sum(lgamma(v + t) - lgamma(t) - lgamma(v + 1) for v in y.tolist()) + float((t * np.log(t) + y * np.log(mu) - (y + t) * np.log(mu + t)).sum())


def hessian(f, p, h=1e-4):
    k, e = len(p), np.eye(len(p)) * h
    return np.array([[(f(p + e[i] + e[j]) - f(p + e[i] - e[j]) - f(p - e[i] + e[j]) + f(p - e[i] - e[j])) / (4 * h * h) for j in range(k)] for i in range(k)])


@pytest.mark.parametrize("effects", ["", "| h + k"])
def test_negbin_errors_carry_theta(rows, effects):
    df, a = rows
    df = df.withColumn("k", F.col("g") % 3)
    k = a["g"] % 3
    parts = {"": [np.ones((800, 1))], "| h": [np.eye(5)[a["h"]]], "| h + k": [np.eye(5)[a["h"]], np.eye(3)[k][:, 1:]]}[effects]
    design = np.column_stack([a["x"], *parts])
    m = fe.fenegbin(df, f"c ~ x {effects}")
    assert m.stats["converged"]
    p = np.append(np.zeros(design.shape[1]), np.log(m.stats["theta"]))
    for _ in range(40):
        t, mu = np.exp(p[-1]), np.exp(np.clip(design @ p[:-1], -20, 20))
        score, info = design.T @ ((a["c"] - mu) * t / (mu + t)), design.T @ (design * ((a["c"] + t) * mu * t / (mu + t) ** 2)[:, None])
        p[:-1] += np.clip(np.linalg.solve(info, score), -1, 1)
    assert m.coef["x"] == pytest.approx(p[0], rel=1e-5)
    v = np.linalg.inv(-hessian(lambda q: loglik(q, design, a["c"]), p))
    assert m.coeftable("iid", fe.Ssc(adj=False)).set_index("term").std_error["x"] == pytest.approx(np.sqrt(v[0, 0]), rel=1e-4)
    assert m.stats["theta_se"] == pytest.approx(m.stats["theta"] * np.sqrt(v[-1, -1]), rel=1e-3)
    # Each row's share in all parameters: the whole inverse times its scores.
    t, mu = np.exp(p[-1]), np.exp(design @ p[:-1])
    digamma = lambda u: sum(1 / (20 + u - s) for s in ()) + np.array([(lgamma(z + 1e-5) - lgamma(z - 1e-5)) / 2e-5 for z in np.atleast_1d(u)])
    own = t * (digamma(a["c"] + t) - digamma(t) + np.log(t) + 1 - np.log(mu + t) - (a["c"] + t) / (mu + t))
    scores = np.column_stack([design * ((a["c"] - mu) * t / (mu + t))[:, None], own])
    robust = v @ scores.T @ scores @ v * 800 / 799
    assert m.coeftable("hetero", fe.Ssc(adj=False)).set_index("term").std_error["x"] == pytest.approx(np.sqrt(robust[0, 0]), rel=1e-4)


@pytest.mark.parametrize("family,y", [("logit", "b"), ("probit", "b"), ("negbin", "c"), ("poisson", "c")])
def test_levels_are_roots_of_their_scores(rows, family, y):
    df, a = rows
    fam = negbin(1.7) if family == "negbin" else FAMILIES[family]
    known = df.select("g", F.col(y).cast("double").alias("_y"), "w", (2 * F.col("x")).alias("_eta"))
    got = {r["key"]: r.c0 for r in solve_levels(known, "g", fam, F.col("w").cast("double")).collect()}
    assert set(got) == set(range(12))
    met = known.withColumn("c", F.create_map(*[F.lit(v) for kv in got.items() for v in kv])[F.col("g")])
    eta = F.col("_eta") + F.col("c")
    mu = fam.inverse(eta)
    left = met.groupBy("g").agg(F.abs(F.sum(F.col("w") * fam.slope(eta) / fam.variance(mu) * (F.col("_y") - mu))).alias("s"))
    assert left.agg(F.max("s")).first()[0] < 1e-6


@pytest.mark.parametrize("family", ["logit", "poisson"])
def test_solved_levels_lead_where_irls_does(rows, family):
    df, a = rows
    y = "b" if family == "logit" else "c"
    s = sample(df, parse(f"{y} ~ x | g")[0])
    plain, solved = feglm_fit(s, FAMILIES[family]), feglm_fit(s, FAMILIES[family], levels=True)
    assert solved.stats["converged"] and solved.coef["x"] == pytest.approx(plain.coef["x"], rel=1e-6)
    assert solved.stats["deviance"] == pytest.approx(plain.stats["deviance"], rel=1e-9)
    with pytest.raises(ValueError, match="slopes"):
        feglm_fit(sample(df, parse(f"{y} ~ x | g[w]")[0]), FAMILIES[family], levels=True)


def test_poisson_with_two_effects_equals_dummies(rows):
    df, a = rows
    design = np.column_stack([a["x"], np.eye(12)[a["g"]], np.eye(5)[a["h"]][:, 1:]])
    b = np.zeros(design.shape[1])
    for _ in range(50):
        mu = np.exp(np.clip(design @ b, -20, 20))
        b += np.clip(np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (a["c"] - mu)), -1, 1)
    m = fe.fepois(df, "c ~ x | g + h", glm_tol=1e-11)
    assert m.coef["x"] == pytest.approx(b[0], rel=1e-6)
    assert m.coeftable("iid", fe.Ssc(adj=False)).std_error[0] == pytest.approx(np.sqrt(np.linalg.inv(design.T @ (design * mu[:, None]))[0, 0]), rel=1e-5)


def test_a_fit_that_stops_early_says_so(rows):
    df, _ = rows
    with pytest.warns(UserWarning, match="not settled"):
        assert not fe.feglm(df, "c ~ x | g", "poisson", glm_iter=2).stats["converged"]
