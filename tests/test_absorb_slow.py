"""Two effects that are linked by few rows, for which conjugate gradients take many turns."""

import numpy as np
import pandas as pd
import pytest

from fescue.operators.absorb import Block, absorb


@pytest.fixture(scope="module")
def chain():
    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(18), 2)
    unit = np.concatenate([np.arange(36), np.arange(36)])
    at = np.concatenate([group, np.minimum(group + 1, 17)])
    x = rng.normal(size=72) + 0.1 * at
    return pd.DataFrame({"u": unit, "g": at, "_x": x, "_y": 0.5 * x + np.sin(at / 7) * 3 + 0.02 * unit + rng.normal(size=72)})


def test_slow_gradients_reach_dense_algebra(spark, chain):
    got = absorb(spark.createDataFrame(chain).coalesce(1), [Block("u"), Block("g")], ["_y", "_x"], dense=0)
    d = np.hstack([pd.get_dummies(chain[c]).to_numpy(float) for c in ("u", "g")])
    v = chain[["_y", "_x"]].to_numpy()
    left = v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    assert np.allclose(got.gram, left.T @ left, rtol=1e-8) and got.gram[0, 1] / got.gram[1, 1] == pytest.approx((left.T @ left)[0, 1] / (left.T @ left)[1, 1], rel=1e-9)


def test_giving_up_is_an_error(spark, chain):
    with pytest.raises(RuntimeError, match="not solved"):
        absorb(spark.createDataFrame(chain).coalesce(1), [Block("u"), Block("g")], ["_y", "_x"], dense=0, most=3)
