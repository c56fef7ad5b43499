"""Columns with a large mean: what varies about it is estimated, not dropped."""

import numpy as np
import pytest

import fescue as fe


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    n = 2000
    g, h, x, z = rng.integers(0, 40, n), rng.integers(0, 7, n), rng.uniform(0, 1000, n), rng.normal(size=n)
    y = 0.002 * x + 0.3 * z + 0.1 * g + rng.normal(size=n)
    data = [(int(a), int(b), float(c), float(d), float(e)) for a, b, c, d, e in zip(g, h, x, z, y)]
    return spark.createDataFrame(data, "g int, h int, x double, z double, y double").cache(), np.array(data)


@pytest.mark.parametrize("far", [1e6, 1.7e9])
@pytest.mark.parametrize("effects", ["", "| g", "| g + h", "| g[z]"])
def test_shifted_columns(rows, far, effects):
    df, a = rows
    moved = df.selectExpr("g", "h", f"x + {far} AS x", "z", f"y + {far} AS y")
    m = fe.feols(moved, f"y ~ x {'' if 'z' in effects else '+ z'} {effects}")
    parts = {"": [np.ones((len(a), 1))], "| g": [np.eye(40)[a[:, 0].astype(int)]]}
    parts["| g + h"] = parts["| g"] + [np.eye(7)[a[:, 1].astype(int)][:, 1:]]
    parts["| g[z]"] = parts["| g"] + [parts["| g"][0] * a[:, 3:4]]
    main = a[:, 2:3] if "z" in effects else a[:, 2:4]
    full = np.column_stack([main, *parts[effects]])
    b, *_ = np.linalg.lstsq(full, a[:, 4], rcond=None)
    left = a[:, 4] - full @ b
    assert m.collinear == []
    assert m.coef["x"] == pytest.approx(b[0], rel=1e-5)
    assert m.ssr == pytest.approx(left @ left, rel=1e-5)
    assert m.stats["ssr_null"] == pytest.approx(((a[:, 4] - a[:, 4].mean()) ** 2).sum(), rel=1e-5)
    if not effects:
        want = b[2] + far - b[0] * far
        assert m.coef["(Intercept)"] == pytest.approx(want, rel=1e-6)
    told = [r["residual"] for r in m.residuals().select("residual").collect()]
    assert sorted(told) == pytest.approx(sorted(left), abs=2e-5)


def test_constant_is_still_dropped(rows):
    df, _ = rows
    m = fe.feols(df.selectExpr("g", "z", "y", "1.7e9D AS far", "g * 3 + 5e6D AS own"), "y ~ z + far + own | g")
    assert m.collinear == ["far", "own"]
    with pytest.raises(ValueError, match="constant"):
        fe.feols(df.selectExpr("z", "0.1D AS y"), "y ~ z")


@pytest.fixture(scope="module")
def apart(spark):
    """Columns whose levels lie far apart against what varies within them."""
    rng = np.random.default_rng(9)
    n = 3000
    g, h, u, s = rng.integers(0, 50, n), rng.integers(0, 6, n), rng.uniform(0, 1, n), rng.uniform(0, 1000, n)
    e, w = rng.normal(size=n), rng.uniform(0.5, 2, n)
    k = (np.arange(n) >= 200).astype(int)
    c = rng.poisson(np.exp(0.001 * s + 0.02 * g))
    data = [(int(a), int(b), int(d), *map(float, r), int(q)) for a, b, d, *r, q in zip(g, h, k, u, s, e, w, c)]
    return spark.createDataFrame(data, "g int, h int, k int, u double, s double, e double, w double, c int").cache(), {"g": g, "h": h, "k": k, "u": u, "s": s, "e": e, "w": w, "c": c}


def within(v, keys, w):
    d = np.hstack([np.eye(x.max() + 1)[x] for x in keys]) * np.sqrt(w)[:, None]
    v = v * np.sqrt(w)
    return v - d @ np.linalg.lstsq(d, v, rcond=None)[0]


@pytest.mark.parametrize("weights", [None, "w"])
@pytest.mark.parametrize("effects", ["g", "g + h"])
@pytest.mark.parametrize("far", [1e4, 1e6])
def test_levels_far_apart(apart, far, effects, weights):
    df, a = apart
    m = fe.feols(df.selectExpr("*", f"{far} * g + u AS x", f"2 * ({far} * g + u) + e AS y"), f"y ~ x | {effects}", weights=weights)
    keys, w = [a[x] for x in effects.split(" + ")], a["w"] if weights else np.ones(len(a["u"]))
    x, e = within(a["u"], keys, w), within(a["e"], keys, w)
    assert m.collinear == [] and m.coef["x"] == pytest.approx(2 + x @ e / (x @ x), rel=1e-6)
    assert m.ssr == pytest.approx(e @ e - (x @ e) ** 2 / (x @ x), rel=1e-6)
    left = fe.demean(df.selectExpr(f"{far} * g + u AS x", "g AS g2", "h AS h2", "w"), ["x"], effects.replace("g", "g2").replace("h", "h2"), weights).toPandas().x
    assert np.sort(left) == pytest.approx(np.sort(x / np.sqrt(w)), abs=1e-8 * far)


def test_one_level_far_off(apart):
    df, a = apart
    m = fe.feols(df.selectExpr("*", "s + k * 1.7e9 AS x", "0.5 * s + e AS y"), "y ~ x | k")
    x, y = within(a["s"], [a["k"]], np.ones(3000)), within(0.5 * a["s"] + a["e"], [a["k"]], np.ones(3000))
    assert m.collinear == [] and m.coef["x"] == pytest.approx(x @ y / (x @ x), rel=1e-6)
    assert fe.feols(df.selectExpr("*", "e AS y", "k * 1.7e9 AS x"), "y ~ s + x | k").collinear == ["x"]


def test_poisson_with_a_large_mean(apart):
    df, a = apart
    far = df.selectExpr("*", "1.7e9 + s AS x")
    b = np.zeros(2)
    design = np.column_stack([np.ones(3000), a["s"]])
    for _ in range(30):
        mu = np.exp(design @ b)
        b += np.linalg.solve(design.T @ (design * mu[:, None]), design.T @ (a["c"] - mu))
    m = fe.fepois(far, "c ~ x")
    assert m.coef["x"] == pytest.approx(b[1], rel=1e-6)
    full = np.column_stack([a["s"], np.eye(50)[a["g"]]])
    b = np.zeros(51)
    for _ in range(40):
        mu = np.exp(full @ b)
        b += np.linalg.solve(full.T @ (full * mu[:, None]), full.T @ (a["c"] - mu))
    m = fe.fepois(far, "c ~ x | g")
    assert m.coef["x"] == pytest.approx(b[0], rel=1e-6)
    assert m.coeftable("iid", fe.Ssc(adj=False)).std_error[0] == pytest.approx(np.sqrt(np.linalg.inv(full.T @ (full * mu[:, None]))[0, 0]), rel=1e-5)
