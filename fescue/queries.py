"""One query for each operator over whole tables, and the same in SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import fescue as fe

from .operators import tools
from .operators.did import cohorts

LINE = [
    "ln(l_extendedprice) as y", "l_quantity / 50 as q", "l_discount * 10 as x", "l_tax * 10 as z", "l_tax + 1 as w", "l_suppkey as s", "l_returnflag as f", "l_linestatus as g",
    "l_orderkey as o", "l_linenumber as nr", "cast(l_orderkey % 4 + if(l_quantity > 30, 2, 0) as double) as c", "cast(if(l_quantity + l_linenumber > 28, 1, 0) as double) as hit",
]
LINE_SQL = """with t as (select ln(l_extendedprice) as y, l_quantity / 50 as q, l_discount * 10 as x, l_tax * 10 as z, l_tax + 1 as w, l_suppkey as s, l_returnflag as f,
 l_linestatus as g, l_orderkey as o, l_linenumber as nr, cast(l_orderkey % 4 + case when l_quantity > 30 then 2 else 0 end as double) as c,
 cast(case when l_quantity + l_linenumber > 28 then 1 else 0 end as double) as hit from lineitem)"""

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def line(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(*LINE)


def rows(spark: SparkSession, data: list, schema: str) -> DataFrame:
    return spark.createDataFrame(data, schema)


def coefs(spark: SparkSession, *models, digits: int = 6) -> DataFrame:
    return rows(spark, [(n, round(float(b), digits)) for m in models for n, b in m.coef.items()], "term string, estimate double")


def stats(spark: SparkSession, found: dict, digits: int = 6) -> DataFrame:
    return rows(spark, [(k, round(float(v["stat"] if isinstance(v, dict) else v), digits)) for k, v in found.items()], "stat string, value double")


def se(spark: SparkSession, model, kind, digits: int = 7) -> DataFrame:
    t = model.coeftable(kind)
    return rows(spark, [(a, round(float(b), 6), round(float(c), digits)) for a, b, c in zip(t.term, t.estimate, t.std_error)], "term string, estimate double, std_error double")


# Least squares.


@query(LINE_SQL + " select '(Intercept)' as term, round(regr_intercept(y, q), 6) as estimate from t union all select 'q', round(regr_slope(y, q), 6) from t")
def ols_simple(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q"))


_TWO = """m as (select avg(y) as my, avg(q) as mq, avg(x) as mx, sum({w}) as n, sum({w}*y)/sum({w}) as wy, sum({w}*q)/sum({w}) as wq, sum({w}*x)/sum({w}) as wx from {t}),
v as (select sum({w}*(q-wq)*(q-wq)) as qq, sum({w}*(x-wx)*(x-wx)) as xx, sum({w}*(q-wq)*(x-wx)) as qx, sum({w}*(q-wq)*(y-wy)) as qy, sum({w}*(x-wx)*(y-wy)) as xy from {t}, m),
e as (select (qy*xx - xy*qx)/(qq*xx - qx*qx) as bq, (xy*qq - qy*qx)/(qq*xx - qx*qx) as bx from v)"""


@query(LINE_SQL + ", " + _TWO.format(w="1", t="t") + " select '(Intercept)' as term, round(wy - bq*wq - bx*wx, 6) as estimate from m, e union all select 'q', round(bq, 6) from e union all select 'x', round(bx, 6) from e")
def ols_multi(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q + x"))


@query(LINE_SQL + ", " + _TWO.format(w="w", t="t") + " select '(Intercept)' as term, round(wy - bq*wq - bx*wx, 6) as estimate from m, e union all select 'q', round(bq, 6) from e union all select 'x', round(bx, 6) from e")
def wls(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q + x", weights="w"))


@query(LINE_SQL + " select '(Intercept)' as term, round(regr_intercept(y - 0.5*x, q), 6) as estimate from t union all select 'q', round(regr_slope(y - 0.5*x, q), 6) from t")
def ols_offset(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q", offset="0.5 * x"))


_DEMEAN = """, dm as (select y - avg(y) over (partition by {k}) as y, q - avg(q) over (partition by {k}) as q, x - avg(x) over (partition by {k}) as x, z - avg(z) over (partition by {k}) as z, s, f, g as fg, o from t), """


@query(LINE_SQL + _DEMEAN.format(k="s") + _TWO.format(w="1", t="dm") + " select 'q' as term, round(bq, 6) as estimate from e union all select 'x', round(bx, 6) from e")
def feols_1fe(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q + x | s"))


@query(LINE_SQL + ", t2 as (select y + 3e4 * s as y, q + 1e4 * s as q, s from t), dm as (select y - avg(y) over (partition by s) as y, q - avg(q) over (partition by s) as q from t2) select 'x' as term, round(sum(q*y)/sum(q*q), 6) as estimate from dm")
def feols_levels_far_apart(spark, d):
    """What varies within levels is a millionth of a millionth of the sums of squares."""
    return coefs(spark, fe.feols(line(spark, d).selectExpr("y + 3e4D * s as y", "q + 1e4D * s as x", "s"), "y ~ x | s"))


@query(LINE_SQL + ", m as (select avg(c) filter (where hit = 0) as a, avg(c) filter (where hit = 1) as b from t) select 'x' as term, round(ln(b / a) / 1000, 10) as estimate from m")
def poisson_far_from_zero(spark, d):
    """A regressor such as seconds since 1970, with a mean of a million times what varies about it."""
    return coefs(spark, fe.fepois(line(spark, d).withColumn("x", F.expr("1.7e9D + 1000 * hit")), "c ~ x"), digits=10).where("term = 'x'")


@query(LINE_SQL + _DEMEAN.format(k="s, f") + "r as (select sum(q*y)/sum(q*q) as v from dm) select 'q' as term, round(v, 6) as estimate from r")
def feols_combined_fe(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q | s^f"))


_FLAG = LINE_SQL + """, u as (select y, q, case when g = 'F' then 1.0 else 0.0 end as x, f from t), dm as (select y - avg(y) over (partition by f) as y, q - avg(q) over (partition by f) as q, x - avg(x) over (partition by f) as x from u), """


@query(_FLAG + _TWO.format(w="1", t="dm") + " select 'q' as term, round(bq, 6) as estimate from e")
def feols_2fe(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q | f + g"))


@query()
def feols_2fe_iterated(spark, d):
    """Two effects with many levels each, by conjugate gradients."""
    from .operators.absorb import absorb
    from .operators.estimate import sample
    from .plans.formula import parse

    li = table(spark, d, "lineitem").selectExpr("ln(l_extendedprice) as y", "l_quantity / 50 as q", "l_suppkey as s", "l_partkey as p")
    s = sample(li, parse("y ~ q | s + p")[0])
    a = absorb(s.df, s.blocks, ["_y", "_x0"], dense=0)
    return rows(spark, [("q", round(float(a.gram[0, 1] / a.gram[1, 1]), 6))], "term string, estimate double")


@query(LINE_SQL + """, r as (select s, regr_slope(y, x) as by_, regr_intercept(y, x) as ay, regr_slope(q, x) as bq, regr_intercept(q, x) as aq from t group by s),
e as (select t.y - ay - by_*t.x as y, t.q - aq - bq*t.x as q from t join r on t.s = r.s) select 'q' as term, round(sum(q*y)/sum(q*q), 6) as estimate from e""")
def slopes_fe(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ q | s[x]"))


@query(LINE_SQL + _DEMEAN.format(k="s") + "r as (select s, sum(y*y) as yy, sum(q*q) as qq, sum(q*y) as qy from dm group by s) select s, round(yy, 5) as yy, round(qq, 5) as qq, round(qy, 5) as qy from r")
def demean_1fe(spark, d):
    out = fe.demean(line(spark, d).withColumn("k", F.col("s")), ["y", "q"], "s")
    return out.groupBy(F.col("k").alias("s")).agg(F.round(F.sum(F.col("y") ** 2), 5).alias("yy"), F.round(F.sum(F.col("q") ** 2), 5).alias("qq"), F.round(F.sum(F.col("q") * F.col("y")), 5).alias("qy"))


@query(LINE_SQL + " select 'l' as term, count(*) as n from t where s <= 20 and q > 0.1")
def subset_rows(spark, d):
    m = fe.feols(line(spark, d), "y ~ q", subset="s <= 20 and q > 0.1")
    return rows(spark, [("l", m.n)], "term string, n long")


@query("""with t as (select c_acctbal as y, case when c_custkey % 7 = 0 then null else c_custkey % 11 end as a, case when c_custkey % 5 = 0 then 0 else c_custkey % 3 end as w from customer)
select count(*) as n, round(sum(w*(a-ma)*(y-my))/sum(w*(a-ma)*(a-ma)), 6) as estimate from t, (select sum(w*a)/sum(w) as ma, sum(w*y)/sum(w) as my from t where a is not null and w > 0) where a is not null and w > 0""")
def na_and_zero_weights(spark, d):
    df = table(spark, d, "customer").selectExpr("c_acctbal as y", "if(c_custkey % 7 = 0, null, c_custkey % 11) as a", "if(c_custkey % 5 = 0, 0, c_custkey % 3) as w")
    m = fe.feols(df, "y ~ a", weights="w")
    return rows(spark, [(m.n, round(m.coef["a"], 6))], "n long, estimate double")


@query(LINE_SQL + " select f as sample, round(regr_intercept(y, q), 6) as intercept, round(regr_slope(y, q), 6) as q from t group by f union all select 'Full sample', round(regr_intercept(y, q), 6), round(regr_slope(y, q), 6) from t")
def split_sample(spark, d):
    out = fe.feols(line(spark, d), "y ~ q", fsplit="f")
    return rows(spark, [(i["sample"], round(m.coef["(Intercept)"], 6), round(m.coef["q"], 6)) for i, m in zip(out.index, out)], "sample string, intercept double, q double")


@query(LINE_SQL + " select 'y' as lhs, round(regr_slope(y, q), 6) as q from t union all select 'c', round(regr_slope(c, q), 6) from t union all select 'x', round(regr_slope(x, q), 6) from t")
def multi_lhs(spark, d):
    out = fe.feols(line(spark, d), "c(y, c, x) ~ q")
    return rows(spark, [(i["lhs"], round(m.coef["q"], 6)) for i, m in zip(out.index, out)], "lhs string, q double")


@query(LINE_SQL + ", " + _TWO.format(w="1", t="t") + " select 1 as step, round(regr_slope(y, q), 6) as q from t union all select 2, round(bq, 6) from e")
def stepwise(spark, d):
    out = fe.feols(line(spark, d), "y ~ csw(q, x)")
    return rows(spark, [(i["rhs"], round(m.coef["q"], 6)) for i, m in zip(out.index, out)], "step int, q double")


@query(LINE_SQL + ", a as (select f, avg(y) as m from t group by f) select '(Intercept)' as term, round(m, 6) as estimate from a where f = 'A' union all select 'f::' || f, round(m - (select m from a where f = 'A'), 6) from a where f <> 'A'")
def factor_terms(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ i(f)"))


@query(LINE_SQL + " select 'f::' || f || ':q' as term, round(regr_slope(y, q), 6) as estimate from t group by f")
def factor_by_number(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ i(f, q) | f"))


# Covariances of y ~ q | s: one slope, so sums of scores do.

_SCORES = LINE_SQL + _DEMEAN.format(k="s") + "bb as (select sum(q*y)/sum(q*q) as b, sum(q*q) as qq, count(*) as n, count(distinct s) as g from dm), sc as (select q*(y - b*q) as u, (y - b*q)*(y - b*q) as ee, s, f, o, qq, n, g, b from dm, bb) "


def _slope_model(spark, d):
    return fe.feols(line(spark, d), "y ~ q | s")


@query(_SCORES + "select 'q' as term, round(max(b), 6) as estimate, round(sqrt(sum(ee)/(max(n) - max(g) - 1)/max(qq)), 7) as std_error from sc")
def vcov_iid(spark, d):
    return se(spark, _slope_model(spark, d), "iid")


@query(_SCORES + "select 'q' as term, round(max(b), 6) as estimate, round(sqrt(sum(u*u)*max(n)/(max(n) - max(g) - 1))/max(qq), 7) as std_error from sc")
def vcov_hetero(spark, d):
    return se(spark, _slope_model(spark, d), "hetero")


@query(_SCORES + ", k as (select s, sum(u) as u from sc group by s) select 'q' as term, round(max(b), 6) as estimate, round(sqrt((select sum(u*u) from k)*max(g)/(max(g) - 1.0)*(max(n) - 1.0)/(max(n) - 2.0))/max(qq), 7) as std_error from sc")
def vcov_cluster(spark, d):
    return se(spark, _slope_model(spark, d), "~s")


@query(_SCORES + """, k1 as (select sum(u) as u from sc group by s), k2 as (select sum(u) as u from sc group by f), k3 as (select sum(u) as u from sc group by s, f), m as (select (select sum(u*u) from k1) + (select sum(u*u) from k2) - (select sum(u*u) from k3) as v)
select 'q' as term, round(max(b), 6) as estimate, round(sqrt(max(v)*3/2*(max(n) - 1.0)/(max(n) - 2.0))/max(qq), 7) as std_error from sc, m""")
def vcov_twoway(spark, d):
    return se(spark, _slope_model(spark, d), "twoway ~ s + f")


def _ways_sql(keys: list[str], smallest: int) -> str:
    """The clustered error of one slope: cells of all combinations of the keys, odd ones added and even ones taken away; a negative
    sum counts as 1e-10."""
    from itertools import combinations

    ways = [w for r in range(1, len(keys) + 1) for w in combinations(keys, r)]
    cells = " union all ".join(f"select {'' if len(w) % 2 else '-'}sum(u*u) as v from (select sum(u) as u from sc group by {', '.join(w)})" for w in ways)
    return f""", cells as ({cells}), m as (select sum(v) as v from cells), z as (select max(b) as b, max((select v from m))*{smallest}/({smallest} - 1.0)*(max(n) - 1.0)/(max(n) - 2.0)/max(qq)/max(qq) as v from sc)
select 'q' as term, round(b, 6) as estimate, round(sqrt(case when v < 0 then 1e-10 else v end), 7) as std_error from z"""


_WAYS = _SCORES.replace("s, f, o, qq", "s, f, o, nr, fg as h, qq").replace("g as fg, o from t", "g as fg, o, nr from t")


@query(_WAYS + _ways_sql(["s", "f", "nr"], 3))
def vcov_threeway(spark, d):
    return se(spark, _slope_model(spark, d), "threeway ~ s + f + nr")


@query(_WAYS + _ways_sql(["s", "f", "nr", "h"], 2))
def vcov_fourway(spark, d):
    return se(spark, fe.feols(line(spark, d).withColumnRenamed("g", "h"), "y ~ q | s"), "fourway ~ s + f + nr + h")


@query(_SCORES + ", k as (select o, sum(u) as u from sc group by o) select 'q' as term, round(max(b), 6) as estimate, round(sqrt((select sum(u*u) from k))/max(qq), 7) as std_error from sc")
def vcov_no_correction(spark, d):
    return se(spark, _slope_model(spark, d), fe.cluster("o", ssc=fe.Ssc(adj=False, cluster_adj=False)))


_DAYS = """with t as (select cast(ts as date) as day, count(*) as n, sum(value) / 1000 as v from events group by 1), r as (select *, row_number() over (order by day) as k from t),
b as (select regr_slope(v, n) as b, regr_intercept(v, n) as a, avg(n) as mn, count(*) as t from r), s as (select k, (n - mn)*(v - a - b*n) as u, (n - mn)*(n - mn) as qq, b, b.t as t from r, b)"""


@query(_DAYS + """, w as (select sum(u*u) as v from s union all select 2*(1 - 1/4.0)*sum(x.u*y.u) from s x join s y on x.k = y.k + 1 union all select 2*(1 - 2/4.0)*sum(x.u*y.u) from s x join s y on x.k = y.k + 2
union all select 2*(1 - 3/4.0)*sum(x.u*y.u) from s x join s y on x.k = y.k + 3) select 'n' as term, round(max(b), 6) as estimate, round(sqrt((select sum(v) from w)*max(t)/(max(t) - 1.0)*(max(t) - 1.0)/(max(t) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_newey_west(spark, d):
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.sum("value") / 1000).alias("v"))
    return se(spark, fe.feols(days, "v ~ n"), "NW(3) ~ day").where("term = 'n'")


@query(_DAYS + """, p as (select count(*) as t, floor(3*pow(count(*)/100.0, 2/9.0)) as m from s), g as (select k, n*(v - a - b*n) as x from r, (select b, a from b)),
a as (select sum(x.x*y.x)/sum(y.x*y.x) as a from g x join g y on x.k = y.k + 1), h as (select x.k, x.x - a*y.x as h from g x join g y on x.k = y.k + 1, a),
c as (select x.k - y.k as j, sum(x.h*y.h) as v from h x join h y on x.k - y.k between 0 and (select m from p) group by 1),
l as (select floor(1.1447*pow(pow(2*sum(j*v)/(2*sum(v) - sum(case when j = 0 then v else 0 end)), 2), 1/3.0)*pow((select t from p), 1/3.0)) as l from c),
w as (select sum(case when x.k = y.k then 1 else 2*(1 - (x.k - y.k)/((select l from l) + 1)) end*x.u*y.u) as v from s x join s y on x.k - y.k between 0 and (select l from l))
select 'n' as term, round(max(b), 6) as estimate, round(sqrt((select v from w)*max(t)/(max(t) - 1.0)*(max(t) - 1.0)/(max(t) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_newey_west_automatic(spark, d):
    """The lag is found from the whitened scores."""
    days = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.sum("value") / 1000).alias("v"))
    return se(spark, fe.feols(days, "v ~ n"), "NW ~ day").where("term = 'n'")


_PANEL = """with t as (select user_id as i, cast(ts as date) as day, count(*) as n, sum(value) / 1000 as v from events group by 1, 2), r as (select *, dense_rank() over (order by day) as k from t),
b as (select regr_slope(v, n) as b, regr_intercept(v, n) as a, avg(n) as mn, count(*) as m, count(distinct day) as t from r), s as (select k, i, (n - mn)*(v - a - b*n) as u, (n - mn)*(n - mn) as qq, b, m, b.t as t from r, b)"""


def _panel(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("i"), F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), (F.sum("value") / 1000).alias("v"))


@query(_PANEL + """, p as (select k, sum(u) as u from s group by k), w as (select sum(u*u) as v from p union all select 2*(1 - 1/3.0)*sum(x.u*y.u) from p x join p y on x.k = y.k + 1 union all select 2*(1 - 2/3.0)*sum(x.u*y.u) from p x join p y on x.k = y.k + 2)
select 'n' as term, round(max(b), 6) as estimate, round(sqrt((select sum(v) from w)*max(t)/(max(t) - 1.0)*(max(m) - 1.0)/(max(m) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_driscoll_kraay(spark, d):
    return se(spark, fe.feols(_panel(spark, d), "v ~ n"), "DK(2) ~ day").where("term = 'n'")


@query(_PANEL + """, w as (select sum(u*u) as v from s union all select 2*(1 - 1/3.0)*sum(x.u*y.u) from s x join s y on x.i = y.i and x.k = y.k + 1 union all select 2*(1 - 2/3.0)*sum(x.u*y.u) from s x join s y on x.i = y.i and x.k = y.k + 2)
select 'n' as term, round(max(b), 6) as estimate, round(sqrt((select sum(v) from w)*max(t)/(max(t) - 1.0)*(max(m) - 1.0)/(max(m) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_newey_west_panel(spark, d):
    return se(spark, fe.feols(_panel(spark, d), "v ~ n"), "NW(2) ~ i + day").where("term = 'n'")


_PLACES = """with t as (select c_acctbal / 1000 as y, cast(c_custkey % 13 as double) as x, cast((cast(c_custkey as bigint) * 7919) % 6007 as double) / 100 - 30 as lat, cast((cast(c_custkey as bigint) * 104729) % 15013 as double) / 100 - 75 as lon from customer),
b as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, avg(x) as mx, count(*) as n from t), s as (select lat, lon, (x - mx)*(y - a - b*x) as u, (x - mx)*(x - mx) as qq, b, n from t, b)"""


def _places(spark, d):
    return table(spark, d, "customer").selectExpr("c_acctbal / 1000 as y", "cast(c_custkey % 13 as double) as x", "cast((cast(c_custkey as bigint) * 7919) % 6007 as double) / 100 - 30 as lat", "cast((cast(c_custkey as bigint) * 104729) % 15013 as double) / 100 - 75 as lon")


@query(_PLACES + """, w as (select sum(p.u*q.u) as v from s p, s q where (p.lat - q.lat)*(p.lat - q.lat) + pow(cos(radians((p.lat + q.lat)/2))*(p.lon - q.lon), 2) <= pow(200.5/111.0, 2))
select 'x' as term, round(max(b), 6) as estimate, round(sqrt((select v from w)*(max(n) - 1.0)/(max(n) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_conley(spark, d):
    return se(spark, fe.feols(_places(spark, d), "y ~ x"), fe.conley(200.5)).where("term = 'x'")


@query(_PLACES + """, w as (select sum(p.u*q.u) as v from s p, s q where 2*6376.0*asin(least(1.0, sqrt(pow(sin(radians(q.lat - p.lat)/2), 2) + cos(radians(p.lat))*cos(radians(q.lat))*pow(sin(radians(q.lon - p.lon)/2), 2)))) <= 300.5)
select 'x' as term, round(max(b), 6) as estimate, round(sqrt((select v from w)*(max(n) - 1.0)/(max(n) - 2.0))/sum(qq), 7) as std_error from s""")
def vcov_conley_spherical(spark, d):
    return se(spark, fe.feols(_places(spark, d), "y ~ x"), fe.conley(300.5, distance="spherical")).where("term = 'x'")


@query(LINE_SQL + """, e as (select regr_slope(y, q) as b, regr_intercept(y, q) as a, avg(q) as m, count(*) as n, var_pop(q)*count(*) as qq from t), r as (select (q-m)*(y-a-b*q)/(1 - 1.0/n - (q-m)*(q-m)/qq) as u, b, qq from t, e)
select 'q' as term, round(max(b), 6) as estimate, round(sqrt(sum(u*u))/max(qq), 7) as std_error from r""")
def vcov_hc3(spark, d):
    return se(spark, fe.feols(line(spark, d), "y ~ q"), "HC3").where("term = 'q'")


@query(LINE_SQL + """, k as (select sum(w) as n, sum(w*y)/sum(w) as my, sum(w*q)/sum(w) as mq from t), h as (select w, y - my as y, q - mq as q, n from t, k), b as (select sum(w*q*y)/sum(w*q*q) as b, sum(w*q*q) as qq from h)
select 'q' as term, round(max(b), 6) as estimate, round(sqrt(sum(w*w*q*q*(y-b*q)*(y-b*q))*count(*)/(count(*) - 2.0))/max(qq), 7) as std_error from h, b""")
def vcov_hetero_weighted(spark, d):
    return se(spark, fe.feols(line(spark, d), "y ~ q", weights="w"), "hetero").where("term = 'q'")


# Statistics.


@query(LINE_SQL + """, e as (select regr_slope(y, q) as b, regr_intercept(y, q) as a, avg(y) as m from t), r as (select count(*) as n, sum((y-a-b*q)*(y-a-b*q)) as ssr, sum((y-m)*(y-m)) as sst from t, e), l as (select *, -n/2.0*(ln(2*pi()*ssr/n) + 1) as ll from r)
select 'n' as stat, round(cast(n as double), 5) as value from l union all select 'r2', round(1 - ssr/sst, 5) from l union all select 'ar2', round(1 - ssr/sst*(n-1.0)/(n-2.0), 5) from l union all select 'rmse', round(sqrt(ssr/n), 5) from l union all select 'll', round(ll, 5) from l
union all select 'aic', round(4 - 2*ll, 5) from l union all select 'bic', round(2*ln(n) - 2*ll, 5) from l union all select 'f', round((sst-ssr)/(ssr/(n-2.0)), 5) from l union all select 'wald', round((sst-ssr)/(ssr/(n-2.0)), 5) from l""")
def fit_statistics(spark, d):
    return stats(spark, fe.feols(line(spark, d), "y ~ q", vcov="iid").fitstat("n", "r2", "ar2", "rmse", "ll", "aic", "bic", "f", "wald"), 5)


@query(_SCORES + """, z as (select sum(ee) as ssr, max(n) as n, max(g) as g from sc), y as (select sum(y*y) as yy from dm) select 'wr2' as stat, round(1 - ssr/yy, 7) as value from z, y
union all select 'war2', round(1 - ssr/yy*(n - g)/(n - g - 1.0), 7) from z, y union all select 'wf', round((yy - ssr)/(ssr/(n - g - 1.0)), 7) from z, y""")
def within_statistics(spark, d):
    return stats(spark, _slope_model(spark, d).fitstat("wr2", "war2", "wf"), 7)


@query(LINE_SQL + ", e as (select regr_slope(y, q) as b, regr_intercept(y, q) as a from t) select f, round(sum(y-a-b*q), 5) as residual, round(sum((y-a-b*q)*(y-a-b*q)), 4) as squared, round(sum(a+b*q), 4) as fitted from t, e group by f")
def residuals_and_fitted(spark, d):
    m = fe.feols(line(spark, d), "y ~ q")
    r = m.residuals()
    return r.groupBy("f").agg(F.round(F.sum("residual"), 5).alias("residual"), F.round(F.sum(F.col("residual") ** 2), 4).alias("squared"), F.round(F.sum(F.col("y") - F.col("residual")), 4).alias("fitted"))


@query(LINE_SQL + _DEMEAN.format(k="s") + "r as (select sum(q*y)/sum(q*q) as b from dm) select s, round(avg(y - b*q), 6) as effect from t, r group by s")
def fixed_effects(spark, d):
    return _slope_model(spark, d).fixef()["s"].select(F.col("key").alias("s"), F.round("c0", 6).alias("effect"))


@query(_FLAG + _TWO.format(w="1", t="dm") + ", a as (select f, avg(y) as my, avg(q) as mq, avg(x) as mx from u group by f) select f, round(my - bq*mq - bx*mx + bx, 6) as effect from a, e")
def fixed_effects_two(spark, d):
    return fe.feols(line(spark, d), "y ~ q | f + g").fixef()["f"].select(F.col("key").alias("f"), F.round("c0", 6).alias("effect"))


@query(LINE_SQL + ", tr as (select * from t where s % 10 <> 0), dm as (select y - avg(y) over (partition by s) as y, q - avg(q) over (partition by s) as q, s from tr), r as (select sum(q*y)/sum(q*q) as b from dm), a as (select s, avg(y - b*q) as a from tr, r group by s) select t.s, count(*) as n, round(sum(a + b*q), 4) as prediction from t left join a on t.s = a.s, r group by t.s")
def predict_new_rows(spark, d):
    li = line(spark, d)
    m = fe.feols(li, "y ~ q | s", subset="s % 10 <> 0")
    return m.predict(li).groupBy("s").agg(F.count("*").alias("n"), F.round(F.sum("prediction"), 4).alias("prediction"))


@query(LINE_SQL + ", e as (select avg(q) as m, count(*) as n, var_pop(q)*count(*) as qq from t) select f, round(sum(1.0/n + (q-m)*(q-m)/qq), 7) as hat from t, e group by f")
def hat_values(spark, d):
    return fe.feols(line(spark, d), "y ~ q").hatvalues().groupBy("f").agg(F.round(F.sum("hat"), 7).alias("hat"))


@query(LINE_SQL + " select 'f::' || f as \"column\", count(*) as n from t where f <> 'A' group by f union all select 'q', count(*) from t where q <> 0 union all select '(Intercept)', count(*) from t")
def sparse_model_matrix(spark, d):
    return fe.feols(line(spark, d), "y ~ q + i(f)").sparse_matrix("o").groupBy("column").agg(F.count("*").alias("n"))


@query(LINE_SQL + " select round(sum(q), 4) as q, round(sum(x), 4) as x, count(*) as n from t")
def model_matrix(spark, d):
    return fe.feols(line(spark, d), "y ~ q + x").model_matrix().agg(F.round(F.sum("q"), 4).alias("q"), F.round(F.sum("x"), 4).alias("x"), F.count("*").alias("n"))


@query(LINE_SQL + ", k as (select q, 5.0 as k, q * 2 as q2 from t) select 'k is constant' as problem from k having min(k) = max(k) union all select 'q2 is explained by the other variables' from k having regr_r2(q2, q) > 1 - 1e-10")
def collinear_columns(spark, d):
    m = fe.feols(line(spark, d).withColumn("k", F.lit(5.0)).withColumn("q2", F.col("q") * 2), "y ~ q + k + q2")
    return rows(spark, [(x,) for x in fe.collinearity(m)], "problem string")


# Instruments.


@query(LINE_SQL + _DEMEAN.format(k="f") + "r as (select sum(z*y)/sum(z*q) as b from dm) select 'fit_q' as term, round(b, 4) as estimate from r")
def iv_just_identified(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ 1 | f | q ~ z"), digits=4)


@query(LINE_SQL + _DEMEAN.format(k="f") + "r as (select sum(z*q)/sum(z*z) as b from dm) select 'z' as term, round(b, 6) as estimate from r")
def iv_first_stage_fit(spark, d):
    return coefs(spark, fe.first_stages(fe.feols(line(spark, d), "y ~ 1 | f | q ~ z"))["q"])


@query(LINE_SQL + _DEMEAN.format(k="f") + "r as (select sum(z*q)*sum(z*q)/sum(z*z) as ess, sum(q*q) as qq, count(*) as n from dm) select 'q' as stat, round(ess/((qq - ess)/(n - 4.0)), 5) as value from r")
def iv_first_stage(spark, d):
    return stats(spark, fe.feols(line(spark, d), "y ~ 1 | f | q ~ z").fitstat("ivf")["ivf"], 5)


_OVER = LINE_SQL + """, k as (select avg(y) as y, avg(q) as q, avg(x) as x, avg(z) as z from t), h as (select t.y - k.y as y, t.q - k.q as q, t.x - k.x as x, t.z - k.z as z from t, k),
g as (select count(*) as n, sum(x*x) as xx, sum(z*z) as zz, sum(x*z) as xz, sum(x*q) as xq, sum(z*q) as zq, sum(x*y) as xy, sum(z*y) as zy from h),
p as (select *, (xq*zz - zq*xz)/(xx*zz - xz*xz) as px, (zq*xx - xq*xz)/(xx*zz - xz*xz) as pz from g), b as (select *, (px*xy + pz*zy)/(px*xq + pz*zq) as b from p),
e as (select b.*, xy - b*xq as xe, zy - b*zq as ze from b), u as (select sum((y - b*q)*(y - b*q)) as ssr from h, e)"""


@query(_OVER + " select 'fit_q' as term, round(b, 4) as estimate from e")
def iv_over_identified(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ 1 | q ~ x + z"), digits=4).where("term = 'fit_q'")


@query(_OVER + " select 'sargan' as stat, round(n*(xe*xe*zz - 2*xe*ze*xz + ze*ze*xx)/(xx*zz - xz*xz)/ssr, 5) as value from e, u")
def iv_sargan(spark, d):
    return stats(spark, fe.feols(line(spark, d), "y ~ 1 | q ~ x + z").fitstat("sargan"), 5)


@query()
def iv_weak_tests(spark, d):
    return stats(spark, fe.feols(line(spark, d), "y ~ 1 | f | q ~ x + z").fitstat("cd", "kpr", "wh"), 5)


# Generalised linear models.


@query(LINE_SQL + ", a as (select f, ln(avg(c)) as m from t group by f) select '(Intercept)' as term, round(m, 6) as estimate from a where f = 'A' union all select 'f::' || f, round(m - (select m from a where f = 'A'), 6) from a where f <> 'A'")
def poisson_saturated(spark, d):
    return coefs(spark, fe.fepois(line(spark, d), "c ~ i(f)"))


@query(LINE_SQL + ", a as (select f, ln(sum(w*c)/sum(w)) as m from t group by f) select '(Intercept)' as term, round(m, 6) as estimate from a where f = 'A' union all select 'f::' || f, round(m - (select m from a where f = 'A'), 6) from a where f <> 'A'")
def poisson_weighted(spark, d):
    return coefs(spark, fe.fepois(line(spark, d), "c ~ i(f)", weights="w"))


@query(LINE_SQL + ", a as (select f, ln(avg(hit)/(1 - avg(hit))) as m from t group by f) select '(Intercept)' as term, round(m, 6) as estimate from a where f = 'A' union all select 'f::' || f, round(m - (select m from a where f = 'A'), 6) from a where f <> 'A'")
def logit_saturated(spark, d):
    return coefs(spark, fe.felogit(line(spark, d), "hit ~ i(f)"))


@query(LINE_SQL + ", a as (select f, ln(avg(exp(y))) as m from t group by f) select '(Intercept)' as term, round(m, 6) as estimate from a where f = 'A' union all select 'f::' || f, round(m - (select m from a where f = 'A'), 6) from a where f <> 'A'")
def gamma_saturated(spark, d):
    return coefs(spark, fe.feglm(line(spark, d).withColumn("e", F.exp("y")), "e ~ i(f)", "Gamma"))


@query(LINE_SQL + ", a as (select s, sum(c) as c, count(*) as n from t group by s), b as (select round(sum(c), 4) as fitted, count(*) as levels from a) select fitted, levels from b")
def poisson_one_effect(spark, d):
    """With an effect, fitted values add up to the outcomes in every level."""
    m = fe.fepois(line(spark, d), "c ~ q | s")
    return m.fitted().groupBy("s").agg(F.sum("fitted").alias("v")).agg(F.round(F.sum("v"), 4).alias("fitted"), F.count("*").alias("levels"))


@query(LINE_SQL + """ select 's' as part, cast(s as varchar) as level, round(cast(sum(c) as double), 4) as fitted from t group by s union all select 'f', f, round(cast(sum(c) as double), 4) from t group by f
union all select 'q', null, round(sum(q*c), 4) from t""")
def poisson_two_effects(spark, d):
    """What makes a Poisson fit with two effects the likelihood's maximum: fitted values add up to the outcomes in every level of both,
    and with the regressor they make the same products."""
    m = fe.femlm(line(spark, d), "c ~ q | s + f", glm_tol=1e-12)
    fitted = m.fitted()
    by = lambda k: fitted.groupBy(F.lit(k).alias("part"), F.col(k).cast("string").alias("level")).agg(F.round(F.sum("fitted"), 4).alias("fitted"))
    return by("s").union(by("f")).union(fitted.agg(F.round(F.sum(F.col("q") * F.col("fitted")), 4).alias("fitted")).select(F.lit("q"), F.lit(None).cast("string"), "fitted"))


@query()
def probit(spark, d):
    return coefs(spark, fe.feglm(line(spark, d), "hit ~ x", "probit"))


@query(LINE_SQL + ", m as (select hit, avg(c) as m from t group by hit), v as (select t.hit, max(m) as m, count(*) as n, sum((c - m)*(c - m)) as ss from t join m on t.hit = m.hit group by t.hit) select 'hit' as term, round(sqrt(sum(ss/(n*n*m*m))*(select count(*)*1.0/(count(*) - 2) from t)), 7) as std_error from v")
def poisson_robust(spark, d):
    return se(spark, fe.fepois(line(spark, d), "c ~ hit"), "hetero").where("term = 'hit'").select("term", "std_error")


@query(LINE_SQL + """, k as (select s, cast(count(*) as double) as n, cast(count(*) filter (where q > 0.5) as double) as m, cast(sum(hit) as double) as h from t group by s),
r as (select s, 2*(n - h) as a, n - m + 2*m - 3*h as b, -h as c from k where h > 0 and h < n) select s, round(ln((-b + sqrt(b*b - 4*a*c))/(2*a)), 6) as effect from r""")
def levels_solved(spark, d):
    """What each supplier adds to a logit whose other part is ln 2 where q is over a half."""
    from .operators.glm import FAMILIES
    from .operators.levels import solve_levels

    known = line(spark, d).selectExpr("s", "hit as _y", "if(q > 0.5, ln(2D), 0D) as _eta")
    mixed = known.groupBy("s").agg(F.min("_y").alias("a"), F.max("_y").alias("b")).where("a < b").select("s")
    return solve_levels(known.join(mixed, "s", "left_semi"), "s", FAMILIES["logit"], F.lit(1.0)).select(F.col("key").alias("s"), F.round("c0", 6).alias("effect"))


@query()
def negbin_errors(spark, d):
    """Standard errors of the observed information, theta's uncertainty included."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("n"), F.avg("l_discount").alias("v"), F.first("l_orderkey").alias("o"))
    m = fe.fenegbin(li.withColumn("g", F.col("o") % 5), "n ~ v | g")
    return se(spark, m, "hetero", 5).union(rows(spark, [(".theta", round(m.stats["theta"], 3), round(m.stats["theta_se"], 3))], "term string, estimate double, std_error double"))


@query()
def negative_binomial(spark, d):
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = fe.fenegbin(e, "n ~ i(event_type)")
    return coefs(spark, m).union(rows(spark, [(".theta", round(m.stats["theta"], 3))], "term string, estimate double"))


@query(LINE_SQL + ", " + _TWO.format(w="1", t="(select y, q, q*q as x from t)") + " select 'a' as term, round(bq, 4) as estimate from e union all select 'b', round(bx, 4) from e")
def nonlinear(spark, d):
    m = fe.fenmlm(line(spark, d), "y ~ 1", "a * q + b * q * q", {"a": 0.1, "b": 0.1})
    return coefs(spark, m, digits=4).where("term in ('a', 'b')")


@query(LINE_SQL + """, a as (select f, avg(hit) as p, count(*) as n from t group by f), k as (select avg(hit) as p, count(*) as n from t), l as (select (select sum(n*(p*ln(p) + (1-p)*ln(1-p))) from a) as ll, n*(p*ln(p) + (1-p)*ln(1-p)) as ll0 from k)
select 'll' as stat, round(ll, 4) as value from l union all select 'pr2', round(1 - ll/ll0, 4) from l union all select 'lr', round(2*(ll - ll0), 4) from l union all select 'aic', round(6 - 2*ll, 4) from l union all select 'deviance', round(-2*ll, 4) from l""")
def logit_statistics(spark, d):
    return stats(spark, fe.felogit(line(spark, d), "hit ~ i(f)").fitstat("ll", "pr2", "lr", "aic", "deviance"), 4)


@query(LINE_SQL + ", a as (select f, avg(c) as m from t group by f) select t.f, round(sum((c - m)/sqrt(m)), 4) as pearson, round(sum((c - m)/m), 4) as working, round(sum(2*(case when c > 0 then c*ln(c/m) else 0 end - (c - m))), 3) as deviance from t join a on t.f = a.f group by t.f")
def glm_residuals(spark, d):
    m = fe.fepois(line(spark, d), "c ~ i(f)")
    sums = lambda kind, e, digits: m.residuals(kind).groupBy("f").agg(F.round(F.sum(F.expr(e)), digits).alias(kind))
    out = sums("pearson", "residual", 4).join(sums("working", "residual", 4), "f").join(sums("deviance", "residual * residual", 3), "f")
    return out.select("f", *[(F.col(c) + 0.0).alias(c) for c in ("pearson", "working", "deviance")])


# Panels and differences in differences.


@query("""with t as (select user_id as i, cast(ts as date) as day, count(*) as n from events group by 1, 2) select t.i, cast(t.day as varchar) as day, t.n, p.n as before, q.n as after, t.n - p.n as diff from t left join t p on p.i = t.i and p.day = t.day - 1 left join t q on q.i = t.i and q.day = t.day + 2""")
def panel_lags(spark, d):
    p = fe.Panel(_panel(spark, d).select("i", "day", "n"), "i", "day", step=1)
    return p.lag("n", 1, "before").lead("n", 2, "after").diff("n", 1, "diff").data().withColumn("day", F.col("day").cast("string"))


@query("""with t as (select user_id as i, cast(ts as date) as day, count(*) as n from events group by 1, 2), j as (select t.n as n, p.n as l from t join t p on p.i = t.i and p.day = t.day - 1)
select '(Intercept)' as term, round(regr_intercept(n, l), 6) as estimate from j union all select 'l', round(regr_slope(n, l), 6) from j""")
def lag_in_formula(spark, d):
    m = fe.feols(_panel(spark, d), "n ~ l(n, 1)", panel=("i", "day", 1))
    return rows(spark, [("l" if "__l_" in n else n, round(b, 6)) for n, b in m.coef.items()], "term string, estimate double")


@query(LINE_SQL + """, a as (select case when g = 'F' then 1 else 0 end as k, y, q from t), r as (select 'y' as variable, avg(case when k = 1 then y end) as m1, avg(case when k = 0 then y end) as m0, stddev_samp(case when k = 1 then y end) as s1, stddev_samp(case when k = 0 then y end) as s0, sum(k) as n1, count(*) - sum(k) as n0 from a
union all select 'q', avg(case when k = 1 then q end), avg(case when k = 0 then q end), stddev_samp(case when k = 1 then q end), stddev_samp(case when k = 0 then q end), sum(k), count(*) - sum(k) from a)
select variable, round(m1, 6) as mean_treated, round(m0, 6) as mean_control, round(m1 - m0, 6) as difference, round((m1 - m0)/sqrt(s1*s1/n1 + s0*s0/n0), 4) as t_value from r""")
def means_by_group(spark, d):
    out = fe.did_means(line(spark, d), ["y", "q"], "g = 'F'")
    return out.select("variable", *[F.round(c, 6).alias(c) for c in ("mean_treated", "mean_control", "difference")], F.round("t_value", 4).alias("t_value"))


def _staggered(spark, d):
    e = table(spark, d, "orders").selectExpr("o_custkey as i", "year(o_orderdate) as t", "o_totalprice / 100000 as y").groupBy("i", "t").agg(F.avg("y").alias("y"))
    return e.withColumn("c", F.expr("case when i % 3 = 0 then 9999 else 1996 + i % 3 end"))


_STAGGERED = "with t as (select o_custkey as i, year(o_orderdate) as t, avg(o_totalprice / 100000) as y, case when o_custkey % 3 = 0 then 9999 else 1996 + o_custkey % 3 end as c from orders group by 1, 2, 4)"


@query(_STAGGERED + ", p as (select distinct t from t), s as (select c, min(t - c) as first, max(t - c) as last from t group by c) select c as cohort, first, last, (p.t is null or last < 0) as never, (p.t is not null and first >= 0) as always from s left join p on p.t = s.c")
def cohort_kinds(spark, d):
    return cohorts(_staggered(spark, d), "c", "t")


@query()
def staggered_effects(spark, d):
    m = fe.sunab(_staggered(spark, d), "y ~ 1 | i + t", "c", "t")
    t = fe.aggregate(m, "period")
    return rows(spark, [(a, round(b, 5)) for a, b in zip(t.term, t.estimate)], "term string, estimate double")


@query(_STAGGERED + ", k as (select distinct c, t from t where c <> 9999 and t - c <> -1 and c in (select distinct t from t)) select count(*) as cells from k")
def staggered_cells(spark, d):
    m = fe.sunab(_staggered(spark, d), "y ~ 1 | c + t", "c", "t")
    return rows(spark, [(len(m.names) + len(m.collinear),)], "cells long")


# Column tools.


@query("select l_returnflag as f, cast(floor(l_quantity / 7) * 7 as bigint) as bin, count(*) as n from lineitem group by 1, 2")
def bin_width(spark, d):
    li = table(spark, d, "lineitem")
    c, _ = fe.bin_column(li, "l_quantity", "bin::7")
    return li.groupBy(F.col("l_returnflag").alias("f"), c.cast("long").alias("bin")).agg(F.count("*").alias("n"))


@query("select case when p_size <= 10 then 'small' when p_size in (20, 30) then '20' else cast(p_size as varchar) end as bin, count(*) as n from part group by 1")
def bin_values(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_size").cast("string"))
    c, _ = fe.bin_column(p, "k", {"small": [str(i) for i in range(1, 11)], "20": ["20", "30"]})
    return p.groupBy(c.alias("bin")).agg(F.count("*").alias("n"))


@query("""with k as (select quantile_cont(l_quantity, 0.25) as a, quantile_cont(l_quantity, 0.5) as b, quantile_cont(l_quantity, 0.75) as c from lineitem), p as (select case when l_quantity <= a then 0 when l_quantity <= b then 1 when l_quantity <= c then 2 else 3 end as k, l_quantity as v from lineitem, k)
select cast(cast(min(v) as bigint) as varchar) || '-' || cast(cast(max(v) as bigint) as varchar) as bin, count(*) as n from p group by k""")
def cut_quartiles(spark, d):
    li = table(spark, d, "lineitem")
    return li.groupBy(fe.cut_column(li, "l_quantity", "q1]q2]q3]").alias("bin")).agg(F.count("*").alias("n"))


@query("with k as (select l_returnflag, l_suppkey, dense_rank() over (order by l_returnflag, l_suppkey) as id from (select distinct l_returnflag, l_suppkey from lineitem)) select k.id, count(*) as n from lineitem l join k on l.l_returnflag = k.l_returnflag and l.l_suppkey = k.l_suppkey group by k.id")
def integer_ids(spark, d):
    return fe.to_integer(table(spark, d, "lineitem"), "l_returnflag", "l_suppkey").groupBy("id").agg(F.count("*").alias("n"))


@query(LINE_SQL + ", m as (select avg(q) as a, count(*) as n from t), p as (select y, q, q - a as p1 from t, m), a as (select sum(q*p1*p1)/sum(p1*p1) as a1, sum(p1*p1) as n1 from p), r as (select y, p1, (q - a1)*p1 - n1/n as p2 from p, a, m) select '(Intercept)' as term, round(avg(y), 6) as estimate from r union all select 'poly(q, 2)1', round(sum(p1*y)/sqrt(sum(p1*p1)), 6) from r union all select 'poly(q, 2)2', round(sum(p2*y)/sqrt(sum(p2*p2)), 6) from r")
def orthogonal_terms(spark, d):
    return coefs(spark, fe.feols(line(spark, d), "y ~ poly(q, 2)"))


@query(LINE_SQL + ", dm as (select q - avg(q) over (partition by s) as q, y - avg(y) over (partition by s) as y, x - avg(x) over (partition by s) as x, z - avg(z) over (partition by s) as z, y*q - avg(y*q) over (partition by s) as yq from t)" + " union all".join(f" select '{n}' as outcome, round(sum(q*{c})/sum(q*q), 6) as estimate from dm" for n, c in (("y", "y"), ("x", "x"), ("z", "z"), ("y * q", "yq"))))
def prepared_outcomes(spark, d):
    """Three outcomes from one reading of the rows, and one that was not prepared."""
    p = fe.prepare(line(spark, d), "c(y, x, z) ~ q | s")
    got = {y: p.coef(y)["q"] for y in p.outcomes} | {"y * q": p.another("y * q")["q"]}
    return rows(spark, [(y, round(b, 6)) for y, b in got.items()], "outcome string, estimate double")


@query(" union all ".join(f"select cast({p} as double) as share, round(cast(quantile_cont(l_extendedprice, {p}) as double), 4) as price from lineitem" for p in (0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0)))
def exact_quantiles(spark, d):
    shares = [0.0, 0.013, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = fe.quantiles(table(spark, d, "lineitem"), "l_extendedprice", shares)
    return rows(spark, [(s, round(v, 4)) for s, v in zip(shares, got)], "share double, price double")


@query("""with s as (select o_custkey as k, 0 as t, o_orderkey as w from orders union all select user_id, 1, event_id from events), f as (select k, min((t, w)) as w from s group by k), i as (select k, row_number() over (order by w, k) as id from f)
select i.id, i.k, count(*) as n from orders o join i on i.k = o.o_custkey group by 1, 2""")
def joint_ids(spark, d):
    """Ids of the customers of two tables, in the order in which they are first met."""
    orders, events = table(spark, d, "orders").selectExpr("o_custkey as k", "o_orderkey as w"), table(spark, d, "events").selectExpr("user_id as k", "event_id as w")
    ids = fe.dictionary([orders, events], "k", order="w")
    return fe.to_integer(orders, "k", items=ids).groupBy("id", "k").agg(F.count("*").alias("n"))


@query("select count(*) as n, count(distinct l_suppkey) as suppliers, count(distinct (l_suppkey, l_returnflag)) as pairs, count(distinct case when l_quantity > 40 then l_suppkey end) as large from lineitem")
def distinct_counts(spark, d):
    out = fe.n_unique(table(spark, d, "lineitem"), ".N", "l_suppkey", "l_suppkey^l_returnflag", "l_suppkey[large]", where={"l_suppkey[large]": "l_quantity > 40"})
    return out.toDF("n", "suppliers", "pairs", "large")


@query("""select 'k' as key, (select count(*) from (select distinct o_custkey from orders) where o_custkey not in (select user_id from events)) as only_a,
(select count(*) from (select distinct user_id from events) where user_id not in (select o_custkey from orders)) as only_b,
(select count(*) from (select distinct user_id from events) where user_id in (select o_custkey from orders)) as common""")
def keys_compared(spark, d):
    return fe.compare_keys(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "events").select(F.col("user_id").alias("k")), ["k"])


@query("select o_custkey as level, count(*) as n from orders group by 1 having count(*) = 1 or (min(case when o_totalprice > 200000 then 1 else 0 end) = 0 and max(case when o_totalprice > 200000 then 1 else 0 end) = 0)")
def removed_levels(spark, d):
    return tools.removable_levels(table(spark, d, "orders"), "o_custkey", "cast(o_totalprice > 200000 as int)")


@query("with k as (select o_custkey from orders group by 1 having count(*) > 1), t as (select o.o_custkey as k, o_totalprice / 100000 as y, o_orderkey % 10 as x from orders o join k on o.o_custkey = k.o_custkey), dm as (select y - avg(y) over (partition by k) as y, x - avg(x) over (partition by k) as x from t) select count(*) as n, round(sum(x*y)/sum(x*x), 6) as estimate from dm")
def singletons_removed(spark, d):
    m = fe.feols(table(spark, d, "orders").selectExpr("o_custkey as k", "o_totalprice / 100000 as y", "o_orderkey % 10 as x"), "y ~ x | k", fixef_rm="singleton")
    return rows(spark, [(m.n, round(m.coef["x"], 6))], "n long, estimate double")


@query("select case when p_size <= 3 then '1' else cast(p_size as varchar) end as level, count(*) as n from part group by 1")
def reference_level(spark, d):
    p = table(spark, d, "part").withColumn("k", F.col("p_size").cast("string"))
    c, _ = fe.ref_levels(p, "k", ["1", "2", "3"])
    return p.groupBy(c.alias("level")).agg(F.count("*").alias("n"))


@query(LINE_SQL + _DEMEAN.format(k="s") + "r as (select sum(q*y)/sum(q*q) as b from dm), a as (select s, avg(y - b*q) as a from t, r group by s) select count(*) as n, round(avg(a), 6) as mean, round(var_samp(a), 6) as variance, round(min(a), 6) as least, round(max(a), 6) as most from a")
def effects_described(spark, d):
    from .operators.fixef import describe

    out = describe(_slope_model(spark, d).fixef()["s"])
    return out.select("n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "least", "most")])


@query("select l_orderkey, count(*) as n from lineitem group by 1 having count(*) > 1")
def duplicate_keys(spark, d):
    return tools.duplicates(table(spark, d, "lineitem"), "l_orderkey")


@query()
def sampled_rows(spark, d):
    return fe.sample_rows(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 100)


@query()
def coefficient_table(spark, d):
    t = fe.etable(fe.feols(line(spark, d), "y ~ sw(q, x) | f"))
    return rows(spark, [(i, *map(str, r)) for i, r in zip(t.index, t.to_numpy())], "item string, m1 string, m2 string")


@query(LINE_SQL + " select '(Intercept)' as term, round(regr_intercept(y, q), 6) as estimate from t union all select 'q', round(regr_slope(y, q), 6) from t")
def stream_ols(spark, d):
    """The same fit as ols_simple, from a stream of files."""
    from .streaming.ols import fit_stream

    schema = table(spark, d, "lineitem").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parquet*")
    found = fit_stream(stream, {"y": "ln(l_extendedprice)", "q": "l_quantity / 50"}, "y", f"s{uuid.uuid4().hex}")
    return rows(spark, [(n, round(b, 6)) for n, b in found.items()], "term string, estimate double")


@query(LINE_SQL + _DEMEAN.format(k="s") + "bb as (select sum(q*y)/sum(q*q) as b, sum(q*q) as qq, count(*) as n from dm), k as (select dm.s, sum(q*(y - b*q)) as u from dm, bb group by dm.s), v as (select count(*) as g, sum(u*u) as uu from k) select 'q' as term, round(b, 6) as estimate, round(sqrt(uu*g/(g - 1.0)*(n - 1.0)/(n - 2.0))/qq, 7) as std_error from bb, v")
def flagship(spark, d):
    """y ~ q with supplier effects, standard errors clustered by supplier."""
    return se(spark, fe.feols(line(spark, d), "y ~ q | s"), None)
