"""Chains with weights in blocks go the way of chains with weights on the driver."""

import numpy as np
import pytest

from seqloom.operators import crf_blocks
from seqloom.operators.crf import BlockCRFModel, LinearChainCRF, LinearChainCRFModel


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    held = []
    for s in range(40):
        for p in range(int(rng.integers(1, 9))):
            y = "xyz"[int(rng.integers(3))]
            feats = [(f"a{int(rng.integers(12))}", float(rng.integers(1, 3))) for _ in range(int(rng.integers(0, 4)))] + ([(f"is{y}", None)] if rng.random() < 0.7 else [])
            held.append((s, p, y, feats))
    held.append((99, 0, None, [("a1", 1.0)]))  # not learnt from
    return spark.createDataFrame(held, "seq long, pos int, label string, feats array<struct<attr:string,value:double>>")


def weights(model, spark):
    return {(r["type"], r["src"], r["dst"]): r["weight"] for r in model.dump(spark).collect()}


@pytest.mark.parametrize("settings", [{"c2": 0.5, "maxIter": 8}, {"c1": 0.3, "c2": 0.0, "maxIter": 6}])
def test_training_in_blocks(spark, rows, settings, monkeypatch):
    monkeypatch.setattr(crf_blocks, "SHARD", 40)  # some shards, and groups of them
    told = {}

    def fit(**more):
        trainer = LinearChainCRF(partitions=2, **settings, **more)
        trainer.listener = lambda k, loss: told.setdefault(len(more), []).append(loss)
        return trainer.fit(rows), trainer.result

    (plain, one), (blocks, two) = fit(), fit(blockSize=7)
    assert isinstance(blocks, BlockCRFModel)
    assert told[0] == pytest.approx(told[1], abs=1e-9) and (one.why, one.evaluations) == (two.why, two.evaluations)
    a, b = weights(plain, spark), weights(blocks, spark)
    assert a.keys() == b.keys() and [b[k] for k in a] == pytest.approx([*a.values()], abs=1e-9)
    assert sorted(map(tuple, plain.active(spark).collect())) == sorted(map(tuple, blocks.active(spark).collect()))


def test_tags_and_files_of_block_models(spark, rows, tmp_path):
    plain = LinearChainCRF(partitions=2, maxIter=5).fit(rows)
    plain.save(str(tmp_path / "m"))
    blocks = BlockCRFModel.load(str(tmp_path / "m"))
    new = rows.unionByName(spark.createDataFrame([(500, 0, None, []), (500, 1, "x", [("never", 2.0)]), (501, 3, None, None)], rows.schema))

    def tagged(model):
        return sorted((r["seq"], r["pos"], r["label"] or "", r["pred"], round(r["marginal"], 9), round(r["probability"], 9), tuple(round(m, 9) for m in r["marginals"])) for r in model.transform(new).collect())

    assert tagged(plain) == tagged(blocks) and len(tagged(plain)) == new.count()
    blocks.save(str(tmp_path / "n"))
    again = LinearChainCRFModel.load(str(tmp_path / "n"))
    assert tagged(again) == tagged(plain)
    assert sorted(map(tuple, plain.ranked(rows, 2).select("seq", "pos", "rank", "label").collect())) == sorted(map(tuple, blocks.ranked(rows, 2).select("seq", "pos", "rank", "label").collect()))


def test_many_features_go_to_blocks_by_themselves(spark, rows, monkeypatch):
    from seqloom.operators import crf

    monkeypatch.setattr(crf, "MOST_FEATURES", 5)
    assert isinstance(LinearChainCRF(maxIter=1).fit(rows), BlockCRFModel)
    with pytest.raises(ValueError, match="weights"):
        LinearChainCRF(algorithm="ap", maxIter=1).fit(rows)
