"""Every registered query of the engine against its DuckDB oracle, on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from terraloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return 0.0 if isinstance(v, float) and v == 0 else v


def _rows(frame, columns):
    return sorted((tuple(map(_plain, r)) for r in frame[columns].itertuples(index=False, name=None)), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert _rows(got, columns) == _rows(want, columns)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", ["surface_nets", "marching_tets"])
def test_meshes_close(spark, name):
    for r in catalog.QUERIES[name](spark, SF).collect():
        assert r["volume"] > 0
        if name == "marching_tets":
            assert r["watertight"]


def test_entry_registers_everything():
    queries = entry.queries()
    assert set(catalog.QUERIES) <= set(queries)
    assert set(entry.oracle_sql()) <= set(queries)


def test_no_python_in_relational_plans(spark):
    for name in ("st_intersects_join", "fulltext_bm25", "rrf_fuse", "condition_blend", "slope_magnitude", "surface_nets_vertices"):
        plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan, name
