"""Every query of the estimation operators that has SQL, held against DuckDB on the small tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from fescue.queries import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def plain(v):
    return None if pd.isna(v) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)


QUICK = ["ols_multi", "wls", "feols_1fe", "feols_2fe", "slopes_fe", "split_sample", "vcov_cluster", "vcov_twoway", "vcov_newey_west_panel", "vcov_conley", "vcov_conley_spherical", "poisson_two_effects", "fit_statistics", "iv_sargan", "poisson_saturated", "panel_lags", "cut_quartiles", "stream_ols", "flagship"]


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    key = lambda r: [str(x) for x in r]
    a, b = (sorted(([plain(v) for v in r] for r in t[cols].to_numpy().tolist()), key=key) for t in (got, want))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == y or all(p == q or isinstance(p, float) and p == pytest.approx(q, rel=1e-5, abs=2e-5) for p, q in zip(x, y))


def test_entry_imports_without_text_operators(sf):
    import subprocess
    import sys
    import tempfile

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with tempfile.TemporaryDirectory() as d:
        subprocess.run(f"cp -r {root}/fescue {root}/__spark_entry__.py {d}/ && rm -rf {d}/fescue/llm", shell=True, check=True)
        out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=d, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": d})
        assert out.returncode == 0 and int(out.stdout.split()[0]) > 50, out.stderr
