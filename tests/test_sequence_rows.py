"""Sequences are grouped once; stages and tags work in their rows."""

import pytest

from seqloom.operators import crf_layout
from seqloom.operators.crf import BlockCRFModel, LinearChainCRF

SCHEMA = "seq long, pos int, label string, feats array<struct<attr:string,value:double>>"
ROWS = [(1, 1, "x", [("b", 2.0), ("a", None), ("b", 1.0)]), (1, 0, "y", [("never", 1.0), ("c", 0.5)]), (2, 5, None, None), (2, 7, "x", [(None, 1.0), ("a", 3.0)]), (3, 0, "z", [])]


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("names", [crf_layout.NAMES, 0])
def test_packed_rows(spark, monkeypatch, names):
    monkeypatch.setattr(crf_layout, "NAMES", names)
    attrs = spark.createDataFrame([("c", 2), ("a", 0), ("b", 1)], "attr string, aid long")
    got = crf_layout.pack(spark.createDataFrame(ROWS, SCHEMA).repartition(3), attrs, ["x", "y"], places=True)
    found = {r["seq"]: (r["y"], r["sizes"], r["aids"], r["values"], [tuple(p) for p in r["places"]]) for r in got.collect()}
    assert found == {
        "1": ([1, 0], [1, 3], [2, 0, 1, 1], [0.5, 1.0, 1.0, 2.0], [(0, "y"), (1, "x")]),
        "2": ([2, 0], [0, 1], [0], [3.0], [(5, None), (7, "x")]),
        "3": ([2], [0], [], [], [(0, "z")]),
    }
    if names:
        assert plan_of(got).count("ObjectHashAggregate") <= 2 and "Join" not in plan_of(got)


def test_shards_are_tagged_where_they_are_built(spark, tmp_path):
    rows = spark.createDataFrame([r for r in ROWS if r[2] is not None], SCHEMA)
    LinearChainCRF(maxIter=2).fit(rows).save(str(tmp_path / "m"))
    plan = plan_of(BlockCRFModel.load(str(tmp_path / "m")).transform(rows))
    assert "CoGroups" in plan and "MapInArrow" not in plan and "MapInPandas" not in plan
