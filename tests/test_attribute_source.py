"""Attribute text by the data source: any cut, any line end, written, read and streamed."""

import io

import pytest

from seqloom.sources import attribute_source as source
from seqloom.sources import attribute_text

TEXT = "\n\nA\ta:1\tb\\:c:0.5\n\tB\t\tx:y\n\n\n\nC\n\nD\tq:1e3\ttab\\\\\n\nE"
ITEMS = "seq string, pos long, label string, feats array<struct<attr:string,value:double>>"


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
@pytest.mark.parametrize("tail", ["", "\n", "\n\n"])
@pytest.mark.parametrize("chunk", [1, 3, 1 << 20])
def test_ranges_meet_at_every_byte(end, tail, chunk, monkeypatch):
    monkeypatch.setattr(source, "CHUNK", chunk)
    held = (TEXT + tail).replace("\n", end).encode()
    whole = [*source.sequences(io.BytesIO(held), 0, len(held))]
    assert [lines for _, lines in whole] == [[b"A\ta:1\tb\\:c:0.5", b"\tB\t\tx:y"], [b"C"], [b"D\tq:1e3\ttab\\\\"], [b"E"]]
    assert all(held[at:].startswith(lines[0]) for at, lines in whole)
    for cut in range(len(held) + 1):
        parts = [*source.sequences(io.BytesIO(held), 0, cut), *source.sequences(io.BytesIO(held), cut, len(held))]
        assert parts == whole
    for size in (1, 2, 5):
        assert [s for at in range(0, len(held), size) for s in source.sequences(io.BytesIO(held), at, at + size)] == whole


def test_fields():
    assert source.parsed(b"A\\:1:7\ta:1\tb\\\\\\:c:0.5\t\tx:y\tz:") == ("A:1", [{"attr": "a", "value": 1.0}, {"attr": "b\\:c", "value": 0.5}, {"attr": "x", "value": None}, {"attr": "z", "value": None}])
    assert source.parsed(b"\t\t") is None and source.parsed("ä".encode()) == ("ä", [])
    for label, feats in (("a:b\\", [{"attr": "x\\:y", "value": 0.25}, {"attr": "z", "value": None}, {"attr": "w", "value": 1e-9}]), ("plain", [])):
        want = [{"attr": f["attr"], "value": 1.0 if f["value"] is None else f["value"]} for f in feats]
        assert source.parsed(source.line_of(label, feats).encode()) == (label, want)


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_read_by_spark(spark, tmp_path, size):
    (tmp_path / "d").mkdir()
    for k in range(3):
        (tmp_path / "d" / f"f{k}").write_bytes(TEXT.replace("\n", ["\n", "\r\n", "\r"][k]).encode())
    (tmp_path / "d" / "_hidden").write_text("H\n")
    (tmp_path / "d" / "empty").write_text("")
    df = source.scan(spark, f"file://{tmp_path}/d", rangeBytes=size)
    rows = sorted((r["grp"][-2:], r["block"], r["pos"], r["label"], [tuple(f) for f in r["feats"]]) for r in df.collect())
    assert [r[2:] for r in rows] == 3 * [(0, "A", [("a", 1.0), ("b:c", 0.5)]), (1, "B", [("x", None)]), (0, "C", []), (0, "D", [("q", 1000.0), ("tab\\", 1.0)]), (0, "E", [])]
    assert len({r[:2] for r in rows}) == 12


def test_written_and_read_as_by_the_other_reader(spark, tmp_path):
    held = [(f"s{k}", p, f"l:{p}\\", [("a\\:b", 0.1 * k), (f"w{p}", 1.0), ("ü", None)][: p + 1]) for k in range(20) for p in range(k % 4 + 1)]
    rows = spark.createDataFrame(held, ITEMS).repartition(4)
    source.save(rows, str(tmp_path / "d"))
    assert not [*(tmp_path / "d" / "_temporary").iterdir()]

    def shown(df):
        return sorted((r["grp"].rpartition("/")[2], r["pos"], r["label"], [tuple(f) for f in r["feats"]]) for r in df.collect())

    got = source.scan(spark, str(tmp_path / "d"))
    assert shown(got) == shown(attribute_text.read(spark, str(tmp_path / "d"))) and got.count() == len(held)
    assert got.select("grp", "block").distinct().count() == 20
    source.register(spark)
    rows.where("seq = 's0'").coalesce(1).write.format(source.NAME).mode("overwrite").save(str(tmp_path / "d"))
    assert source.scan(spark, str(tmp_path / "d")).count() == 1


def test_streamed(spark, tmp_path):
    from seqloom.streaming.tagging import run_available

    source.register(spark)
    (tmp_path / "in").mkdir()
    for k in range(2):
        (tmp_path / "in" / f"f{k}").write_text(f"L{k}\ta:{k}\n\nM{k}\n")
        stream = spark.readStream.format(source.NAME).load(str(tmp_path / "in"))
        run_available(stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
        assert sorted(r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == sorted(f"{x}{j}" for j in range(k + 1) for x in "LM")
