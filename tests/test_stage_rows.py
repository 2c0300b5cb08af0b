"""Stages of the pipeline work in an item's own row."""

from pyspark.sql import functions as F

from seqloom.operators.stages import InformationSelectorModel, SequenceTemplates


def test_stages_need_no_join_by_item(spark):
    items = spark.createDataFrame([(1, 0, "s1", ["u", "v", "u", "w"]), (1, 1, "s2", []), (1, 2, "s3", None), (2, 0, "s1", ["v", "q"])], "seq long, pos int, size string, grams array<string>")
    model = InformationSelectorModel(spark.createDataFrame([("v", 0.1, 2.0), ("u", 0.2, 4.0)], "feat string, mi double, scale double"))
    model._setDefault(inputCol="grams", outputCol="feats")
    out = SequenceTemplates(templates=["size[0]", "size[-1]|size[0]"]).transform(model.transform(items))
    found = {(r["seq"], r["pos"]): [tuple(f) for f in r["feats"]] for r in out.select("seq", "pos", "feats").collect()}
    assert found == {
        (1, 0): [("u", 0.5), ("v", 0.5), ("size[0]=s1", 1.0)],
        (1, 1): [("size[-1]|size[0]=s1|s2", 1.0), ("size[0]=s2", 1.0)],
        (1, 2): [("size[-1]|size[0]=s2|s3", 1.0), ("size[0]=s3", 1.0)],
        (2, 0): [("v", 0.5), ("size[0]=s1", 1.0)],
    }
    few = out.select("seq", "pos", F.size("feats"))
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan
