"""What a fit's source is worked out for, and what one task of a clustered covariance holds."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def test_cells_of_several_keys_come_from_sums(spark, monkeypatch):
    from fescue.operators import vcov as V

    rng = np.random.default_rng(1)
    data = [(*map(int, rng.integers(0, 3, 2)), float(rng.normal())) for _ in range(200)] + [(None, 1, 2.0)]
    rows = spark.createDataFrame(data, "_k0 int, _k1 int, _g0 double")
    written, keep = [], V.cut
    monkeypatch.setattr(V, "cut", lambda df, name: written.append(keep(df, name)) or written[-1])
    monkeypatch.setattr(V, "uncut", lambda *frames: None)
    got = V._meats(rows, [(0,), (1,), (0, 1)], 2, 1)
    assert [t.count() for t in written] == [10]
    for way in [(0,), (1,), (0, 1)]:
        want = {}
        for r in data:
            want[tuple(r[i] for i in way)] = want.get(tuple(r[i] for i in way), 0.0) + r[2]
        assert got[way][0][0, 0] == pytest.approx(sum(v * v for v in want.values())) and got[way][1] == len(want)


def test_the_rows_of_staggered_cohorts_are_worked_out_once(spark):
    import fescue as fe

    seen = spark.sparkContext.accumulator(0)
    once = F.udf(lambda v: seen.add(1) or v, "double").asNondeterministic()
    rows = spark.range(0, 60, 1, 1).selectExpr("id div 6 as i", "id % 6 as t", "cast(id * id % 17 as double) as v", "if(id div 6 % 2 = 0, 99, 3) as c").withColumn("y", once("v"))
    assert len(fe.sunab(rows, "y ~ 1 | i + t", "c", "t").names) == 5
    assert seen.value == 60
