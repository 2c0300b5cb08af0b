"""Files, blocks, validation, streams and the command line on small inputs."""

import random
import time

import pytest
from pyspark.sql import functions as F

from seqloom.__main__ import main
from seqloom.operators import blocks, dictionary, validation
from seqloom.operators.crf import LinearChainCRF, LinearChainCRFModel
from seqloom.sources import attribute_text, feature_files, staging, tag_text
from seqloom.streaming.tagging import run_available, tag_stream

ITEMS = "seq string, pos long, label string, feats array<struct<attr:string,value:double>>"


def sequences(n=40, seed=1):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        y = "a"
        for pos in range(r.randrange(1, 9)):
            y = r.choice(["a", "b"]) if r.random() < 0.3 else y
            rows.append((f"s{k}", pos, y, [(f"w:{y if r.random() < 0.9 else 'x'}", 1.0), ("bias", 0.5)]))
    return rows


def test_instances_are_read_as_written(spark, tmp_path):
    rows = [("x", 255, "f g", 2.0), ("x", 255, "h:1", 1.5), ("x", 16, "f g", 1.0), ("y", 16, "z", 0.0), ("y", 17, "z", 3.0)]
    counts = spark.createDataFrame(rows, "bin string, addr long, feat string, cnt double")
    feature_files.write_features(feature_files.local_features(counts), str(tmp_path / "l"))
    features = feature_files.read_features(spark, str(tmp_path / "l"))
    feature_files.write_instances(counts, features, str(tmp_path / "i"))
    text = [r["value"] for r in spark.read.text(str(tmp_path / "i")).where("bin = 'x'").collect()]
    assert text == ["10 1:1.000", "ff 1:2.000 2:1.500"]
    got = sorted(tuple(r) for r in feature_files.read_instances(spark, str(tmp_path / "i"), features).collect())
    assert got == sorted(r for r in rows if r[3])


def test_chains_end_at_gaps(spark, tmp_path):
    addresses = spark.createDataFrame([("x", k) for k in (1, 2, 3, 4, 9)] + [("y", 1)], "bin string, addr long")
    found = spark.createDataFrame([("x", k, 7, [(2, 1.0), (1, 0.5)]) for k in (1, 2, 4, 9)], "bin string, addr long, label int, feats array<struct<id:int,value:double>>")
    chains = feature_files.chain_lines(addresses, found)
    feature_files.write_data(chains, str(tmp_path / "d"), str(tmp_path / "m"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "d")).collect()] == ["7\t1:0.5\t2:1.0"] * 2 + [""] + ["7\t1:0.5\t2:1.0"] * 2
    assert [r["value"] for r in spark.read.text(str(tmp_path / "m")).collect()] == ["x", "1", "2", "4", "9"]
    assert feature_files.read_data(spark, str(tmp_path / "d")).count() == 4
    assert sorted(r["addr"] for r in feature_files.read_map(spark, str(tmp_path / "m")).collect()) == [1, 2, 4, 9]


def test_ids_over_ranges(spark):
    keys = random.Random(4).sample(range(10**6), 3000)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)
    got = {r["k"]: r["id"] for r in dictionary.dense_ids(df, ["k"], "id").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys), 1)}
    assert dictionary.dense_ids(df.limit(0), ["k"], "id").count() == 0


def test_running_sums_over_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice("xxxxxyz") if k % 50 else None, k, r.randrange(3)) for k in range(2000)]
    r.shuffle(rows)
    want, sums = {}, {}
    for g, k, v in sorted(rows, key=lambda t: t[1]):
        sums[g] = sums.get(g, 0) + v
        want[k] = sums[g]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = dictionary.running_sums(spark.createDataFrame(rows, "range string, k long, v int"), ["range"], ["k"], {"s": F.col("v")}).collect()
        assert len({x["range"] for x in got}) == 4 and {x["k"]: x["s"] for x in got} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert dictionary.running_sums(spark.createDataFrame([], "g string, k long"), ["g"], ["k"], {"s": F.lit(1)}).count() == 0


def test_tables_are_made_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert [staging.kept_at(spark, str(tmp_path / "t"), make).count() for _ in range(2)] == [3, 3] and len(made) == 1


@pytest.mark.parametrize("field, want", [("a:b:2", ("a:b", 2.0)), ("a", ("a", 1.0)), ("http://x:0.5", ("http://x", 0.5)), (":3", ("", 3.0))])
def test_weights_behind_the_last_colon(spark, field, want):
    assert tuple(spark.range(1).select(tag_text.weighted(F.lit(field)).alias("f")).first()["f"]) == want


def test_template_lines():
    assert tag_text.read_templates(["# x", "U00:%x[0,0]", "B", "", "U01:a:%x[1,0]"]) == ["U00=%x[0,0]", "U01=a=%x[1,0]"]
    with pytest.raises(ValueError, match="two labels"):
        tag_text.read_templates(["B01:%x[0,0]"])


def test_ngrams_over_edges_by_enumeration(spark):
    r = random.Random(5)
    words = {n: [r.choice("pqr") for _ in range(r.randrange(1, 4))] for n in range(5)}
    edges = [(a, b) for a in range(5) for b in range(5) if r.random() < 0.3]
    terms = spark.createDataFrame([(1, n, k, w) for n, ws in words.items() for k, w in enumerate(ws)], "g int, n int, ord int, tok string")
    steps = spark.createDataFrame([(1, a, b) for a, b in edges], "g int, src int, dst int")
    want = {}

    def walk(n, k, heads, left):
        w = words[n][k]
        if left == 1:
            for mask in range(1 << len(heads)):
                feat = "_".join([*("*" if mask >> i & 1 else h for i, h in enumerate(heads)), w])
                want[feat] = want.get(feat, 0) + 1
            return
        nexts = [(n, k + 1)] if k + 1 < len(words[n]) else [(b, 0) for a, b in edges if a == n]
        for m, j in nexts:
            walk(m, j, [*heads, w], left - 1)

    for n, ws in words.items():
        for k in range(len(ws)):
            walk(n, k, [], 3)
    assert {x["feat"]: x["cnt"] for x in blocks.successor_ngrams(terms, steps, 3).collect()} == want


def test_folds_hold_out_what_they_say(spark):
    rows = spark.createDataFrame(sequences(), ITEMS)
    folds = validation.round_robin(rows, 4)
    assert sorted(r["count"] for r in folds.groupBy("fold").count().collect()) == [10] * 4
    found = validation.cross_validate(LinearChainCRF(maxIter=5), rows, folds, 4).collect()
    assert [r["fold"] for r in found] == [0, 1, 2, 3] and sum(r["instances"] for r in found) == 40 and all(r["item_accuracy"] > 0.6 for r in found)
    learn, held = validation.split_by_group(rows.join(folds, "seq"), "fold", 2)
    for algorithm in ("lbfgs", "ap", "arow", "l2sgd"):
        model, report = validation.with_holdout(LinearChainCRF(algorithm=algorithm, maxIter=3, maxTrials=3, candidates=2), learn.drop("fold"), held.drop("fold"))
        told = report.orderBy("iteration").collect()
        assert [r["iteration"] for r in told][:1] == [1] and told[-1]["instances"] == 10
        if algorithm != "l2sgd":
            assert told[-1]["item_hits"] == validation.evaluate(model, held.drop("fold")).first()["item_hits"]


def test_streams_are_tagged_as_tables_are(spark, tmp_path):
    rows = spark.createDataFrame(sequences(12), ITEMS)
    model = LinearChainCRF(maxIter=5).fit(rows)
    want = {(r["seq"], r["pos"]): (r["pred"], round(r["marginal"], 9)) for r in model.transform(rows).collect()}
    data = rows.collect()
    ends = {r["seq"]: r["pos"] for r in data}
    for k in range(3):  # items of a sequence come in several batches
        part = [(r["seq"], r["pos"], [tuple(f) for f in r["feats"]], r["pos"] == ends[r["seq"]]) for r in data if r["pos"] == ends[r["seq"]] and k == 2 or r["pos"] != ends[r["seq"]] and r["pos"] % 2 == k]
        spark.createDataFrame(part, "seq string, pos long, feats array<struct<attr:string,value:double>>, last boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run_available(tag_stream(stream, model).writeStream.format("memory").queryName("tags").option("checkpointLocation", str(tmp_path / "c")))
    assert {(r["seq"], r["pos"]): (r["pred"], round(r["marginal"], 9)) for r in spark.table("tags").collect()} == want


def test_streams_go_on_after_a_stop_and_end_by_time(spark, tmp_path):
    """Open sequences outlive the query; one that gets no more items ends by itself, and what comes later begins anew."""
    rows = spark.createDataFrame(sequences(4), ITEMS)
    model = LinearChainCRF(maxIter=5).fit(rows)
    schema = "seq string, pos long, feats array<struct<attr:string,value:double>>, last boolean"
    data = sorted((r["pos"], [tuple(f) for f in r["feats"]]) for r in rows.where("seq = 's0'").collect())
    data += [(data[-1][0] + 1 + k, [("w:b", 1.0)]) for k in range(3)]

    def batch(part, idle):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        run_available(tag_stream(stream, model, idle=idle).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")))
        return sorted((r["seq"], r["pos"], r["pred"]) for r in spark.read.schema("seq string, pos long, pred string, marginal double, probability double").parquet(str(tmp_path / "out")).collect())

    want = [r["pred"] for r in sorted(model.transform(spark.createDataFrame([("w", p, None, f) for p, f in data], ITEMS)).collect(), key=lambda r: r["pos"])]
    half = len(data) // 2
    assert batch([("ends", p, f, False) for p, f in data[:half]] + [("open", p, f, False) for p, f in data], 1_000) == []
    time.sleep(1.2)
    # the restarted query has the first half of "ends", and "open" has waited long enough
    got = batch([("late", 0, None, False)] + [("ends", p, f, k == 0) for k, (p, f) in enumerate(reversed(data[half:]))], 3_600_000)
    assert got == [("ends", p, y) for (p, _), y in zip(data, want)] + [("open", p, y) for (p, _), y in zip(data, want)]
    again = batch([("open", 7, None, True)], 3_600_000)
    assert [r[:2] for r in again if r not in got] == [("open", 7)]


def test_command_line(spark, tmp_path, capsys):
    attribute_text.write(spark.createDataFrame(sequences(), ITEMS), str(tmp_path / "d"))
    main(["learn", str(tmp_path / "d"), "-m", str(tmp_path / "m"), "-p", "maxIter=4", "-g", "4", "-e", "1"], spark)
    main(["tag", str(tmp_path / "d"), "-m", str(tmp_path / "m"), "-t", "-r", "-p", "-i", "-o", str(tmp_path / "o")], spark)
    main(["dump", str(tmp_path / "m")], spark)
    shown = capsys.readouterr().out
    assert "item_accuracy" in shown and "iteration" in shown and "bias" in shown
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert sum(x.startswith("@probability\t") for x in lines) == 40 and any("\ta:" in x or "\tb:" in x for x in lines)
    assert LinearChainCRFModel.load(str(tmp_path / "m")).labels == ["a", "b"]


def test_online_steps_by_hand(spark):
    """One partition and one sequence an epoch: the scaled weights are those of plain gradient steps."""
    import numpy as np

    from seqloom.operators import crf

    features = [(0, 0, 0, 0), (1, 0, 0, 1), (2, 0, 1, 1), (3, 1, 0, 1), (4, 1, 1, 0)]
    layout = crf.Layout(features, 2, 2)
    item = {"seq": "s", "y": np.array([0, 1, 0]), "sizes": np.array([1, 1, 1]), "at": np.arange(3), "aids": np.array([0, 1, 0]), "values": np.array([1.0, 0.5, 2.0])}
    state = {"w": np.zeros(6), "c": np.zeros(1), "scale": np.ones(1)}
    plain, p = np.zeros(6), {"lam": 0.1, "t0": 3.0}
    for t in range(25):
        grad = np.zeros(6)
        loss = crf.likelihood(layout, plain, item, grad)
        eta = 1 / (p["lam"] * (p["t0"] + t))
        plain = plain * (1 - eta * p["lam"]) - eta * grad
        plain[-1] = 0
        assert crf._sgd(layout, state, item, p) == pytest.approx(loss)
        assert state["w"] * state["scale"][0] == pytest.approx(plain)


def test_sizes_are_read():
    assert feature_files.sizes("1:2:3") == [1, 2, 3] and feature_files.sizes("4") == [4] and feature_files.sizes("") == []
    with pytest.raises(ValueError):
        feature_files.sizes("1::2")


def test_files_that_are_gone_are_passed_over(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"f{k}") for k in range(40)], "n int, t string").repartitionByRange(4, "n")
    feature_files.write_numbered(rows, str(tmp_path / "l"), "n", "t")
    held = feature_files.read_numbered(spark, str(tmp_path / "l"), "n", "t")
    assert held.count() == 40
    gone = sorted(p for p in (tmp_path / "l").iterdir() if p.name.startswith("part-") and p.stat().st_size)[0]
    lost = {line.split()[1] for line in gone.read_text().splitlines()}
    gone.unlink()
    assert lost and {r["t"] for r in held.collect()} == {f"f{k}" for k in range(40)} - lost


def test_columns_are_written_with_escapes(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "b", [("x:y", None), ("z", 0.5)]), ("s", 0, "a", []), ("t", 0, "c", None)], ITEMS)
    tag_text.write_columns(rows.coalesce(1), str(tmp_path / "c"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "c")).collect()]
    assert sorted(lines) == ["", "", "a", "b\tx__COLON__y\tz:0.500000", "c"]
