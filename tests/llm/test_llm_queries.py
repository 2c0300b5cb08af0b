"""Queries with SQL give DuckDB's rows; the pipeline's stages keep what they should."""

import pathlib

import duckdb
import pytest

import corpus_pipeline
from seqloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for p in pathlib.Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    df = queries.queries()[name](spark, SF)
    rel = con.sql(queries.oracle_sql()[name])
    columns, names = sorted(df.columns), list(rel.columns)
    rows = [dict(zip(names, r)) for r in rel.fetchall()]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    scored = queries.op6_toxicity(spark, SF).collect()
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "SimHash near-dedup", "benchmark decontamination", "SentencePiece encoding and decoding"]
    for name, stage in list(stages.items())[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        if name == "toxicity":
            assert left == {r["doc_id"] for r in scored if r["score"] < 0.3}
        if name == "line dedup":
            assert left == ids
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_of_odd_documents(spark, tmp_path, empty):
    """Null and empty texts, null and repeated keys, a very long text, and the form that is written between stages."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(1, None, "en", "web", 0), (2, "", None, None, None), (None, "no key\nat all", "en", "web", 13), (None, "no key\nat all", "en", "web", 13), (3, " \n\t", "en", "web", 3), (4, "wörd " * 60_000, "de", "web", 300_000), (5, "x\ny", "en", "web", 3), (5, "x\ny", "en", "web", 3)]
    odd = spark.createDataFrame([] if empty else rows, docs.schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, odd, SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        back = spark.read.parquet(str(tmp_path / f"{k}"))
        n = back.count()
        if k + 1 < len(corpus_pipeline.STAGES):
            assert [f.dataType for f in back.schema] == [f.dataType for f in docs.schema] and back.columns == docs.columns
        assert n == 0 if empty else n >= 5 if k == 2 else n == len(rows)


def test_scores_of_whole_texts_by_a_plain_pass(spark):
    """Scores are the softmax over the mean of the subwords' numbers, word by word."""
    import re

    import numpy as np
    import pyarrow as pa

    from seqloom.llm import toxicity

    rng = np.random.default_rng(3)
    weight, bias = rng.normal(size=toxicity.BUCKETS), -0.4
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, (weight, bias)).collect()}
    for r in docs.collect():
        words = [w.encode() for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", r["text"] or "")]
        words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
        rows = [toxicity.subwords(pa.array([w], pa.binary()))[0] for w in set(words)]
        numbers = dict(zip(set(words), ((weight[x].sum(), len(x)) for x in rows)))
        total, many = (sum(numbers[w][k] for w in words) for k in (0, 1))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-(total / max(1, many) + bias))))
