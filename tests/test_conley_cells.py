"""Conley's sum over near places by cells, held against all pairs."""

import numpy as np
import pytest

from fescue.operators.vcov import DEGREE, RADIUS, _near


def plain(lat, lon, g, reach, distance):
    a, b = np.radians(lat), np.radians(lon)
    turn = np.abs(lon[:, None] - lon[None, :])
    turn = np.minimum(turn, 360 - turn)
    if distance == "spherical":
        h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a)[:, None] * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
        near = 2 * RADIUS * np.arcsin(np.sqrt(np.minimum(1, h))) <= reach
    else:
        near = (lat[:, None] - lat) ** 2 + (np.cos((a[:, None] + a) / 2) * turn) ** 2 <= (reach / DEGREE) ** 2
    return g.T @ near @ g


@pytest.mark.parametrize("distance", ["triangular", "spherical"])
@pytest.mark.parametrize("reach", [35.0, 400.0])
def test_cells_equal_all_pairs(spark, distance, reach):
    rng = np.random.default_rng(3)
    # A dense town, one at the date line, one near the pole, and places all over.
    centres = [(10.0, 20.0, 1.5), (-3.0, 179.9, 1.0), (83.0, -60.0, 2.0)]
    lat = np.concatenate([rng.normal(c[0], c[2], 250) for c in centres] + [rng.uniform(-80, 80, 150)])
    lon = np.concatenate([rng.normal(c[1], c[2], 250) for c in centres] + [rng.uniform(-180, 180, 150)])
    lat = np.clip(lat, -89, 89)
    lon, g = (lon + 180) % 360 - 180, rng.normal(size=(len(lat), 2))
    df = spark.createDataFrame([(float(a), float(b), float(u), float(v)) for a, b, (u, v) in zip(lat, lon, g)], "_lat double, _lon double, _g0 double, _g1 double")
    assert _near(df, 2, reach, distance) == pytest.approx(plain(lat, lon, g, reach, distance), rel=1e-9)


def test_no_places(spark):
    df = spark.createDataFrame([], "_lat double, _lon double, _g0 double")
    assert _near(df, 1, 100.0, "spherical").tolist() == [[0.0]]
