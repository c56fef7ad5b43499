"""Regressions solved from prepared products equal those fitted alone, and the rows are absorbed once."""

import numpy as np
import pytest

import fescue as fe
from fescue.operators import prepared


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    rows = [(float(1e6 + v[0]), float(v[1]), *map(float, v[2:12]), int(rng.integers(6)), int(rng.integers(3)), float(rng.uniform(1, 2))) for v in rng.normal(size=(300, 12))]
    return spark.createDataFrame(rows + [(None, *rows[0][1:])], ", ".join(f"{c} double" for c in ["a", "b", *[f"y{k}" for k in range(10)]]) + ", f int, g int, w double").cache()


@pytest.mark.parametrize("effects", ["", " | f", " | f + g"])
@pytest.mark.parametrize("weights", [None, "w"])
def test_ten_outcomes_are_absorbed_once(data, monkeypatch, effects, weights):
    times, real = [], prepared.absorb
    monkeypatch.setattr(prepared, "absorb", lambda *a, **k: times.append(1) or real(*a, **k))
    ys = [f"y{k}" for k in range(10)]
    p = fe.prepare(data, f"c({', '.join(ys)}) ~ a + b{effects}", weights)
    assert p.outcomes == ys and len(p.coefs()) == 10 and len(times) == 1
    for y, x in (("y3", None), ("y9", ["b"])):
        alone = fe.feols(data.where("a is not null"), f"{y} ~ {'a + b' if x is None else 'b'}{effects}", weights=weights)
        assert p.coef(y, x) == pytest.approx(alone.coef, rel=1e-6)
        assert list(p.table(y, x).std_error) == pytest.approx(list(alone.coeftable("iid").std_error), rel=1e-6)
    alone = fe.feols(data.where("a is not null"), f"(y1 * b + 100) ~ a + b{effects}", weights=weights)
    assert p.another("(y1 * b + 100)") == pytest.approx(alone.coef, rel=1e-6) and len(times) == 1


def test_what_is_not_prepared(data):
    p = fe.prepare(data, "y0 ~ a + b | f")
    with pytest.raises(KeyError):
        p.coef(regressors=["y1"])
    with pytest.raises(ValueError):
        p.another("if(b > 0, 1, null)")
    with pytest.raises(ValueError):
        fe.prepare(data, "y0 ~ 1 | f | a ~ b")
    assert list(fe.prepare(data, "y0 ~ a + b + I(2 * b) | f").coef()) == ["a", "b"]
