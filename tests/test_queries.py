"""Every query with SQL gives the same rows as DuckDB; the others run and keep their columns."""

import math
import pathlib

import duckdb
import pytest

from seqloom.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_same_as_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.oracle_sql()[name])
    names = list(rel.columns)
    assert sorted(names) == columns
    rows = [dict(zip(names, r)) for r in rel.fetchall()]
    assert got == sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", ["crf_train_tag_lbfgs", "crf_train_pa", "marginals"])
def test_runs(spark, name):
    rows = catalogue.queries()[name](spark, SF).collect()
    assert rows and all(0 <= r["marginal"] <= 1 + 1e-9 for r in rows)
