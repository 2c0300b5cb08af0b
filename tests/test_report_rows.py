"""The report of segments is made without pivots and joins by range."""

from seqloom.operators import sequences
from seqloom.sources import tag_text


def test_report(spark):
    runs = spark.createDataFrame([(1, "a", 0, 3, 3, 3), (1, "c", 3, 20, 2, 5), (1, "a", 3, 20, 1, 6), (2, "b", 8, 9, 1, 1)], "seq int, label string, start long, end long, seg_len long, cum_count long")
    report = sequences.segment_report(runs, ["a", "b", "c"])
    assert sorted(map(tuple, report.collect())) == [(1, 0, 3, 3, 0, 0), (1, 3, 20, 6, 0, 5), (2, 8, 9, 0, 1, 0)]
    text = tag_text.report_lines(report, ["a", "b", "c"])
    assert {r["seq"]: r["value"] for r in text.collect()} == {1: "Address range, a, c\n[0x0 - 0x3), 3, 0\n[0x3 - 0x14), 6, 5", 2: "Address range, b\n[0x8 - 0x9), 1"}
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert "pivot" not in plan and "Join" not in plan
