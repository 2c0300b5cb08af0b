"""Lines of instances: whole counts are not formatted as fractions, and parts of a folder are in the order of addresses."""

from pathlib import Path

from seqloom.sources import feature_files


def test_whole_counts_and_order_over_parts(spark, tmp_path, monkeypatch):
    rows = [(b, a, f"w{k}", 1 + (a + k) % 3) for b in ("p", "q") for a in range(1, 90) for k in range(1 + a % 4)]
    counts = spark.createDataFrame(rows, "bin string, addr long, feat string, cnt long").repartition(7)
    features = feature_files.local_features(counts)

    def read(name, cnt):
        feature_files.write_instances(counts.withColumn("cnt", counts["cnt"].cast(cnt)), features, str(tmp_path / name))
        lines = {b: [line for part in sorted((tmp_path / name / f"bin={b}").glob("part-*")) for line in Path(part).read_text().splitlines()] for b in "pq"}
        back = feature_files.read_instances(spark, str(tmp_path / name), features).collect()
        assert sorted((r["bin"], r["addr"], r["feat"], int(r["cnt"])) for r in back) == sorted(rows)
        return lines

    fractions = read("double", "double")
    monkeypatch.setattr(feature_files, "three_places", None)
    assert read("long", "long") == fractions
    for lines in fractions.values():
        assert [int(line.split(" ")[0], 16) for line in lines] == [*range(1, 90)]
    assert fractions["p"][4] == "5 1:3.000 2:1.000"
