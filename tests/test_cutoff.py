"""The default cutoff of Conley's errors, with the places dealt into ranges."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F


def test_places_meet_those_of_the_next_range(spark):
    from fescue.operators import vcov as V

    rng = np.random.default_rng(2)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in zip(rng.uniform(-60, 60, 40), rng.uniform(-170, 170, 40))], "_lat double, _lon double")
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    try:
        for order in (("_lat", "_lon"), ("_lon", "_lat")):
            w = Window.orderBy(*order)
            near = F.least(*[V.great_circle_km(F.col("_lat"), F.col("_lon"), F.lead("_lat", j).over(w), F.lead("_lon", j).over(w)) for j in (1, 2, 3)])
            want = {(r[0], r[1]): r[2] for r in points.select("_lat", "_lon", near.alias("d")).collect()}
            got = V._followed(points, order).collect()
            assert len({r["_part"] for r in got}) > 1 and len(got) == 40
            assert {(r["_lat"], r["_lon"]): r["d"] for r in got} == pytest.approx(want)
    finally:
        spark.conf.unset(name)
