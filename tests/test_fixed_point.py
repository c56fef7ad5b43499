"""Several effects of maximum likelihood solved for by sweeps, held against dense dummies and the scores' roots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import fescue as fe
from fescue.operators.fixed_point import solve_effects
from fescue.operators.glm import FAMILIES, negbin

N, G, H = 1500, 30, 20


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    g, h = rng.integers(0, G, N), rng.integers(0, H, N)
    # A third of the rows have one level.
    g[: N // 3] = 0
    x = rng.normal(size=N) + 0.05 * g
    mu = np.exp(0.4 * x + 0.04 * g - 0.06 * h + 0.6)
    c, b, e = rng.poisson(mu), (rng.uniform(size=N) < 1 / (1 + np.exp(-(x + 0.04 * g - 0.9)))).astype(int), mu * rng.gamma(3.0, 1 / 3, N)
    a = {"g": g, "h": h, "k": (g * 7 + h * 3) % 5, "x": x, "w": rng.integers(1, 4, N), "c": c, "b": b, "e": e}
    return spark.createDataFrame([tuple(v[i].item() for v in a.values()) for i in range(N)], "g int, h int, k int, x double, w int, c int, b int, e double").cache(), a


@pytest.mark.parametrize("family,y", [("poisson", "c"), ("Gamma", "e"), ("gaussian", "e"), ("logit", "b"), ("negbin", "c")])
def test_scores_of_all_levels_are_zero(rows, family, y):
    df, _ = rows
    fam = negbin(2.5) if family == "negbin" else FAMILIES[family]
    keys = ["g", "h", "k"] if family == "poisson" else ["g", "h"]
    known = df.select(*keys, F.col(y).cast("double").alias("_y"), "w", (0.3 * F.col("x")).alias("_eta"))
    got, _ = solve_effects(known, keys, fam, F.col("w").cast("double"))
    met, eta = known, F.col("_eta")
    for k in keys:
        assert got[k].count() == known.select(k).distinct().count()
        met = met.join(got[k].select(F.col("key").alias(k), F.col("c0").alias("c" + k)), k)
        eta = eta + F.col("c" + k)
    mu = fam.inverse(eta)
    for k in keys:
        left = met.groupBy(k).agg(F.abs(F.sum(F.col("w") * fam.slope(eta) / fam.variance(mu) * (F.col("_y") - mu))).alias("s"))
        assert left.agg(F.max("s")).first()[0] < 1e-5


@pytest.mark.parametrize("family,y", [("poisson", "c"), ("logit", "b")])
def test_concentrated_likelihood_equals_dummies(rows, family, y):
    df, a = rows
    design = np.column_stack([a["x"], np.eye(G)[a["g"]], np.eye(H)[a["h"]][:, 1:]])
    beta = np.zeros(design.shape[1])
    for _ in range(60):
        eta = np.clip(design @ beta, -20, 20)
        mu = np.exp(eta) if family == "poisson" else 1 / (1 + np.exp(-eta))
        v = mu if family == "poisson" else mu * (1 - mu)
        info = design.T @ (design * v[:, None])
        beta += np.clip(np.linalg.solve(info, design.T @ (a[y] - mu)), -1, 1)
    m = fe.femlm(df, f"{y} ~ x | g + h", family, glm_tol=1e-11)
    assert m.stats["converged"] and m.stats["sweeps"] > 0
    assert m.coef["x"] == pytest.approx(beta[0], rel=1e-6)
    assert m.coeftable("iid", fe.Ssc(adj=False)).std_error[0] == pytest.approx(np.sqrt(np.linalg.inv(info)[0, 0]), rel=1e-5)
    fitted = m.fitted().groupBy("h").agg(F.sum("fitted") - F.sum(y)).toPandas()
    assert np.abs(fitted.iloc[:, 1]).max() < 1e-5


def test_extrapolation_saves_sweeps(spark):
    # Levels that only meet their neighbours: plain sweeps pass what they learn on by one level at a time.
    rng = np.random.default_rng(1)
    data = [(i, j, float(rng.poisson(3) + 1)) for i in range(4) for j in (i, i + 1)]
    df = spark.createDataFrame(data, "g int, h int, _y double").withColumn("_eta", F.lit(0.0))
    fast, few = solve_effects(df, ["g", "h"], FAMILIES["poisson"], F.lit(1.0), tol=1e-6)
    with pytest.raises(RuntimeError, match="do not settle"):
        solve_effects(df, ["g", "h"], FAMILIES["poisson"], F.lit(1.0), tol=1e-6, most=few // 2, extrapolated=False)


def test_levels_without_a_root(spark):
    df = spark.createDataFrame([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 2.0), (1, 1, 1.0)], "g int, h int, _y double").withColumn("_eta", F.lit(0.0))
    with pytest.raises(RuntimeError, match="no finite"):
        solve_effects(df, ["g", "h"], FAMILIES["poisson"], F.lit(1.0))


def test_no_rows(spark):
    df = spark.createDataFrame([], "g int, h int, _y double, _eta double")
    got, _ = solve_effects(df, ["g", "h"], FAMILIES["poisson"], F.lit(1.0))
    assert not got["g"].count() and not got["h"].count()
