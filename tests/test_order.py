"""Ranks, quantiles, grids and blocks of periods, with small bounds so that every turn is taken."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import fescue as fe
from fescue.functions import order
from fescue.operators import vcov as V


@pytest.mark.parametrize("few, accuracy", [(20_000, 10_000), (3, 20)])
def test_quantiles_equal_numpy(spark, monkeypatch, few, accuracy):
    monkeypatch.setattr(order, "FEW", few)
    monkeypatch.setattr(order, "ACCURACY", accuracy)
    rng = np.random.default_rng(0)
    shares = [0.0, 0.1, 0.37, 0.5, 0.75, 0.999, 1.0]
    for values in (rng.normal(size=500), np.exp(rng.normal(size=400) * 40), np.repeat([1.0, 2.0, 5.0], [300, 1, 99]), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double").repartition(3)
        assert order.quantiles(df, "v", shares) == pytest.approx(list(np.quantile(values, shares)), rel=1e-12)
    assert order.quantiles(spark.createDataFrame([], "v double"), "v", [0.5]) == [None]


def test_grid_of_times(spark):
    times = spark.createDataFrame([(t,) for t in (7, 19, 31, 67, None)], "t int").repartition(3)
    assert order.grid(times, F.col("t")) == (7.0, 12)
    assert order.grid(times.where("t = 7"), F.col("t")) == (7.0, 1) and order.grid(times.where("t > 99"), F.col("t")) == (0.0, 1)
    with pytest.raises(ValueError):
        order.grid(spark.createDataFrame([(1.0,), (2.5,)], "t double"), F.col("t"))


def test_ids_by_first_row_and_for_two_tables(spark):
    a = spark.createDataFrame([("b", 3), ("a", 5), ("b", 1), (None, 0), ("c", 5)], "k string, t int").repartition(4)
    b = spark.createDataFrame([("d", 0), ("a", 0)], "k string, t int")
    ids = fe.dictionary([a, b], "k", order="t")
    assert {r.k: r.id for r in ids.collect()} == {"b": 1, "a": 2, "c": 3, "d": 4}
    assert {r.k: r.id for r in fe.to_integer(b, "k", items=ids).collect()} == {"d": 4, "a": 2}
    assert {r.k: r.id for r in fe.to_integer(a, "k", order="t").collect()} == {"b": 1, "a": 2, "c": 3, None: None}
    assert fe.dictionary([a.where("false")], "k").count() == 0


def bandwidth(x):
    """Newey and West's plug-in after a first-order autoregression, row by row."""
    n = len(x)
    m = int(np.floor(3 * (n / 100) ** (2 / 9)))
    a = np.linalg.lstsq(x[:-1], x[1:], rcond=None)[0]
    h = (x[1:] - x[:-1] @ a).sum(axis=1)
    s = [h[j:] @ h[: len(h) - j] / (n - 1) for j in range(m + 1)]
    s0, s1 = s[0] + 2 * sum(s[1:]), 2 * sum(j * v for j, v in enumerate(s))
    return int(np.floor(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)))


def test_periods_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(2600, 2))
    for t in range(1, len(x)):
        x[t] += [[0.6, 0.1], [-0.2, 0.4]] @ x[t - 1]
    x += 0.5 * np.roll(x, 3, axis=0)
    cells = spark.createDataFrame([(t + 1, float(a), float(b)) for t, (a, b) in enumerate(x)], "_rank long, _g0 double, _g1 double").repartition(4)
    assert V._bandwidth(cells, ["u", "v"], len(x)) == bandwidth(x) > 0
    assert V._bandwidth(cells, ["(Intercept)", "v"], len(x)) == bandwidth(x[:, 1:])
    for lag in (0, 1, 7):
        want = x.T @ x
        for j in range(1, lag + 1):
            g = x[j:].T @ x[:-j]
            want = want + (1 - j / (lag + 1)) * (g + g.T)
        assert V._lagged(cells, 2, lag, []) == pytest.approx(want, rel=1e-9)


def test_orthogonal_polynomials(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(1000, 1010, 60)
    df = spark.createDataFrame([(float(v), float(v % 3)) for v in x] + [(None, 1.0)], "x double, y double")
    from fescue.functions.columns import orthogonal

    got = np.array(df.where("x is not null").select(*orthogonal(df, F.col("x"), 4)).collect())
    assert got.T @ got == pytest.approx(np.eye(4), abs=1e-9) and got.sum(axis=0) == pytest.approx(np.zeros(4), abs=1e-9)
    z = np.vander((x - x.mean()) / x.std(), 5, increasing=True)
    q, r = np.linalg.qr(z)
    assert got == pytest.approx((q * np.sign(np.diag(r)))[:, 1:], abs=1e-8)
    raw = fe.feols(df, "y ~ poly(x, 1, raw = TRUE)").coef
    assert list(raw) == ["(Intercept)", "poly(x, 1)1"] and raw["poly(x, 1)1"] == pytest.approx(np.polyfit(x, x % 3, 1)[0], rel=1e-6)
    with pytest.raises(ValueError):
        orthogonal(df.selectExpr("y > 1 as b"), F.col("b").cast("double"), 2)
