"""Graphs with few edges are described in their sets' rows, as by joins."""

import random

import pytest
from pyspark.sql import functions as F

from seqloom.operators import graphlets


def graph(spark):
    r = random.Random(5)
    rows = [(g, r.choice("abcde"), r.choice("abcde"), r.choice([1, 2, 10])) for g in range(4) for _ in range(4 + 6 * g)]
    rows += [(1, "a", None, 1), (2, "a", "b", None)]
    return spark.createDataFrame(rows, "g int, src string, dst string, type int")


@pytest.mark.parametrize("most", [0, 12, 256])
@pytest.mark.parametrize("make", [graphlets.triples, graphlets.pairs, lambda e: graphlets.singles(e.select("g", F.col("src").alias("n")).unionByName(e.sparkSession.sql("select null g, 'a' n union select 9, 'z'")).distinct())])
def test_rows_as_joins(spark, monkeypatch, make, most):
    monkeypatch.setattr(graphlets, "NET_EDGES", most)
    edges = graph(spark)
    by_joins = graphlets._joined_texts(make(edges), edges).groupBy("g", "feat").count()
    assert sorted(map(repr, map(tuple, graphlets.describe(make(edges), edges).collect()))) == sorted(map(repr, map(tuple, by_joins.collect())))


def test_sets_are_not_cut_into_nodes(spark):
    """Where no graph is large, sets are joined with their graph once and grouped by text alone."""
    edges = graph(spark)
    out = graphlets.describe(graphlets.triples(edges), edges)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "posexplode" not in final and "Generate explode(nodes" not in final
