import glob
import os

import duckdb

from fescue.llm import queries as Q


def test_sql_gives_the_same_rows(spark, sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    for name, sql in Q.oracle_sql().items():
        got = Q.queries()[name](spark, sf)
        rel = con.sql(sql)
        cols = sorted(got.columns)
        assert sorted(rel.columns) == cols
        want = [tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()]
        assert sorted(map(tuple, got.select(*cols).collect())) == sorted(want)


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in Q.queries()] == [f"op{k}" for k in range(1, 14)]
