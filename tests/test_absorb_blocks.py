"""Several effects solved for over blocks that stay where they are: only coefficients of the smaller effects travel."""

import numpy as np
import pandas as pd
import pytest

from fescue.operators import absorb as module
from fescue.operators.absorb import Block, absorb


@pytest.mark.parametrize("slopes", [False, True])
def test_blocks_equal_dense_algebra(spark, monkeypatch, slopes):
    rng = np.random.default_rng(3)
    n = 300
    p = pd.DataFrame({"a": rng.integers(0, 40, n), "b": [f"b{x}" for x in rng.integers(0, 9, n)], "c": rng.integers(0, 5, n), "z": rng.normal(size=n), "w": rng.uniform(0.5, 2, n), "_x": rng.normal(size=n)})
    p["_y"] = p._x + p.a / 9 + p.c * p.z + rng.normal(size=n)
    p.loc[: n // 2, "a"] = 0  # a level with half of the rows
    blocks = [Block("b"), Block("a"), Block("c", "z") if slopes else Block("c")]
    written, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, name: written.append((name, real(df, name))) or written[-1][1])
    monkeypatch.setattr(module, "CELLS", 64)
    monkeypatch.setattr(module, "uncut", lambda *frames: None)
    df = spark.createDataFrame(p)
    got = absorb(df, blocks, ["_y", "_x"], "w", dense=0)
    parts = [pd.get_dummies(p[b.key]).to_numpy(float) * (p[b.unit].to_numpy()[:, None] if b.unit else 1) for b in blocks]
    root = np.sqrt(p.w.to_numpy())[:, None]
    d, v = np.hstack(parts), p[["_y", "_x"]].to_numpy()
    left = v - d @ np.linalg.lstsq(d * root, v * root, rcond=None)[0]
    assert np.allclose(got.gram, (left * root).T @ (left * root), rtol=1e-8)
    rest = got.without(df).toPandas()
    assert np.allclose(np.sort(rest["_m__y"]), np.sort(left[:, 0]), atol=1e-6)
    vectors = [t for name, t in written if name == "vectors"]
    levels = p.b.nunique() + p.c.nunique() + (p.a.nunique() if slopes else 0)
    assert [vectors[0].count(), vectors[-1].count()] == [levels, levels]
    assert dict(written)["keys"].where("k = -1").select("block").distinct().count() > 1
