"""Every core query against its SQL at the smallest scale, and the shape of the registry."""

import glob
import os

import numpy as np
import pandas as pd
import pytest

from factweave.queries import collect

QUERIES, SQL = collect()


def canonical(df):
    def text(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
            return "<null>"
        if isinstance(x, float | np.floating):
            return f"{x:.8g}"
        if isinstance(x, list | tuple | np.ndarray):
            return "[" + ",".join(map(text, x)) + "]"
        return str(int(x)) if isinstance(x, int | np.integer) and not isinstance(x, bool | np.bool_) else str(x)

    df = df[sorted(df.columns)]
    return list(df.columns), sorted("|".join(map(text, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(small):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, small, con, name):
    assert canonical(QUERIES[name](spark, small).toPandas()) == canonical(con.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() >= 0


def test_nothing_imports_the_text_subpackage():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for base, _, files in os.walk(os.path.join(root, "factweave")):
        for f in files:
            if f.endswith(".py") and os.sep + "llm" not in base:
                with open(os.path.join(base, f), encoding="utf-8") as h:
                    assert "factweave.llm" not in h.read()
