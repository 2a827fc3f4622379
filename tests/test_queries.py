"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import glob
import math
import os

import duckdb
import pytest

from quillgraph.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9) + 0.0)
    return repr(x)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_oracle(spark, con, name):
    df = registry.queries()[name](spark, SF)
    rel = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    order = sorted(cols)
    assert sorted(df.columns) == order
    want = sorted(tuple(plain(r[cols.index(c)]) for c in order) for r in rel.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    rows = registry.queries()[name](spark, SF)
    assert len(rows.columns) == len(set(rows.columns))
    assert rows.count() > 0 or name == "r15_hybrid_search"  # which finds none on these tables, without vectors
