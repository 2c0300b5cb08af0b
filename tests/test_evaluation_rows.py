"""Sequences are evaluated in their rows."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import evaluation, validation
from seqloom.operators.crf import LinearChainCRF


def test_measures_of_rows_and_of_sequences(spark):
    held = [(1, ["x", "y", "x"], ["x", "x", "x"]), (2, ["y", "y"], ["y", "y"]), (3, ["x", "y", "y"], ["x", None, "y"]), (4, ["z"], [None]), (5, ["x", "z"], ["x", "y"])]
    seqs = spark.createDataFrame(held, "seq int, pred array<string>, ref array<string>")
    labels = spark.createDataFrame([(x,) for x in "wxyz"], "label string")
    rows = seqs.select("seq", F.posexplode(F.arrays_zip("pred", "ref")).alias("pos", "z")).select("seq", "pos", "z.pred", "z.ref")
    one, two = evaluation.overall(rows, labels).first(), evaluation.overall_of_sequences(seqs, labels).first()
    assert one.asDict() == pytest.approx(two.asDict()) and (two["items"], two["item_hits"], two["instances"], two["instance_hits"]) == (8, 6, 3, 1)


def test_evaluation_deals_no_items(spark):
    rows = spark.createDataFrame([(s, p, "xy"[p % 2], [("a" if p % 2 else "b", 1.0)]) for s in range(6) for p in range(4)], "seq long, pos int, label string, feats array<struct<attr:string,value:double>>")
    trainer = LinearChainCRF(maxIter=3, partitions=2)
    model, told = validation.with_holdout(trainer, rows.where("seq < 4"), rows.where("seq > 3"))
    assert [(r["items"], r["item_hits"]) for r in told.collect()] == [(8, 8)] * told.count()
    found = validation.cross_validate(trainer, rows, validation.round_robin(rows, 2), 2).orderBy("fold").collect()
    assert [(r["fold"], r["items"], r["instances"]) for r in found] == [(0, 12, 3), (1, 12, 3)]
    tags = model.beside(rows)
    assert "pred" in tags.columns and "Generate" not in tags._jdf.queryExecution().executedPlan().toString()
