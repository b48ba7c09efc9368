"""Every query with a DuckDB counterpart gives the same rows; the others run."""

import glob
import math
import os

import duckdb
import pytest

from millrace.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


def table(rows, columns):
    at = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted([tuple(plain(r[k]) for k in at) for r in rows], key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    if name == "balanced_mix" and duck.sql("SELECT min(n) FROM (SELECT count(*) AS n FROM documents WHERE lang IN ('en', 'de') GROUP BY lang)").fetchall()[0][0] < 50:
        pytest.skip("too few rows at this size")
    got = catalogue.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in catalogue.ORACLE_SQL:
        want = duck.sql(catalogue.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert table(rows, got.columns) == table(want.fetchall(), want.columns)


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
