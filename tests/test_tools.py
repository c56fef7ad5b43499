import math

import pytest

import fescue as fe
from fescue.functions import dist, special
from fescue.plans.formula import expand, parse, set_macro


def test_formula_parts():
    r = parse("c(y1, y2) ~ x1 + csw0(a, b) | f1^f2 + f3[u, v] | e ~ z1 + z2")
    assert len(r) == 6 and r[0].rhs == ("x1",) and r[2].rhs == ("x1", "a", "b")
    assert r[0].effects[0].keys == ("f1", "f2") and r[0].effects[1].slopes == ("u", "v") and r[0].inst == ("z1", "z2")
    assert [x.effects for x in parse("y ~ 1 | sw(a, b)")][1][0].keys == ("b",)
    assert parse("y ~ a*b - 1")[0].rhs == ("a", "b", "a:b") and not parse("y ~ a - 1")[0].intercept
    with pytest.raises(ValueError):
        parse("y ~ sw(a) + csw(b)")
    with pytest.raises(ValueError):
        parse("y ~ 1 | e1 + e2 ~ z")
    set_macro("..ctrl", "a + b")
    assert expand("y ~ ..ctrl + ..('^x') + p..", ["x1", "x2", "p_a"]) == "y ~ a + b + x1 + x2 + p_a"
    assert expand("y ~ .[v]", v=["a", "b"]) == "y ~ a + b"


def test_lags_with_gaps(spark):
    df = spark.createDataFrame([(1, 1, 10.0), (1, 2, 11.0), (1, 4, 13.0), (2, 1, 20.0)], "id int, t int, x double")
    got = {(r.id, r.t): (r["l"], r["f"], r["d"]) for r in fe.Panel(df, "id", "t").lag("x", 1, "l").lead("x", 1, "f").diff("x", 1, "d").data().collect()}
    assert got == {(1, 1): (None, 11.0, None), (1, 2): (10.0, None, 1.0), (1, 4): (None, None, None), (2, 1): (None, None, None)}
    with pytest.raises(ValueError):
        fe.Panel(df.union(df), "id", "t")
    assert fe.Panel(df.union(df), "id", "t", duplicates="first").data().count() == 4
    assert {r.t: r["l"] for r in fe.Panel(df.where("id = 1"), "id", "t", step="consecutive").lag("x", 1, "l").data().collect()}[4] == 11.0


def test_bins(spark):
    df = spark.createDataFrame([(i,) for i in range(1, 11)], "x int")
    c, levels = fe.bin_column(df, "x", "!bin::3")
    assert levels == [1, 4, 7, 10]
    c, levels = fe.bin_column(df, "x", [[1, 2], [9, 10]])
    assert levels == [1, 3, 4, 5, 6, 7, 8, 9]
    with pytest.raises(ValueError):
        fe.bin_column(df, "x", {"a": [1, 2], "b": [2, 3]})
    assert sorted(r[0] for r in df.select(fe.cut_column(df, "x", "3]7[").alias("c")).distinct().collect()) == ["1-3", "4-6", "7-10"]


def test_keys_and_ids(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z"), (2, "y")], "k int, s string")
    b = spark.createDataFrame([(2, "y"), (3, "w")], "k int, s string")
    assert [tuple(r) for r in fe.compare_keys(a, b, ["k", "k^s"]).collect()] == [("k", 1, 1, 1), ("k^s", 1, 1, 1)]
    assert sorted((r.k or 0, r.id) for r in fe.to_integer(a, "k").collect()) == [(0, None), (1, 1), (2, 2), (2, 2)]
    assert tuple(fe.n_unique(a, ".N", ".U", "k", "NA(k)").first()) == (4, 3, 2, 1)


def test_distributions(spark):
    assert dist.t_p(2, 10) == pytest.approx(0.073388, abs=1e-6)
    assert dist.f_p(3.0, 2, 30) == pytest.approx(0.0649055, abs=1e-6)
    assert dist.chi2_p(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert dist.t_quantile(0.975, None) == pytest.approx(1.959964, abs=1e-6)
    x = [0.01, 0.5, 1.0, 2.5, 30.0, 1e4]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    from pyspark.sql import functions as F

    for r in df.select("x", special.lgamma(F.col("x")).alias("l"), special.normal_cdf(F.col("x") - 1).alias("n")).collect():
        assert r.l == pytest.approx(math.lgamma(r.x), abs=1e-9, rel=1e-9)
        assert r.n == pytest.approx(1 - dist.normal_tail(r.x - 1), abs=1e-10)
    h = 1e-4
    got = df.select(special.digamma(F.col("x")).alias("d"), special.trigamma(F.col("x")).alias("t"), ((special.lgamma(F.col("x") + h * F.col("x")) - special.lgamma(F.col("x") - h * F.col("x"))) / (2 * h * F.col("x"))).alias("e")).collect()
    assert all(r.d == pytest.approx(r.e, rel=1e-4, abs=1e-4) for r in got)
