"""Words and n-grams of documents are counted in the documents' own rows."""

from collections import Counter
from itertools import product

import pytest

from seqloom.operators import dictionary, ngrams
from seqloom.sources import adapters

TEXTS = [(1, "a b a b\n\n b  c\n"), (2, "a"), (3, ""), (4, None), (5, "c b\nc b"), (5, "b a\nc b"), (None, "x a"), (None, "a\nx"), (6, "é a é")]


def plain(size):
    found = Counter()
    for doc, text in TEXTS:
        for line in (text or "").split("\n"):
            w = [x for x in line.split(" ") if x]
            for k in range(len(w) - size + 1):
                for kept in product((0, 1), repeat=size - 1):
                    found[doc, "_".join([t if on else "*" for t, on in zip(w[k:], kept)] + [w[k + size - 1]])] += 1
    return found


@pytest.mark.parametrize("longest", [adapters.LONGEST, 3])
@pytest.mark.parametrize("size", [1, 2, 3])
def test_counts_of_documents(spark, monkeypatch, size, longest):
    """With ids that several rows share, no ids, and texts that are too long for a row."""
    monkeypatch.setattr(adapters, "LONGEST", longest)
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = ngrams.document_ngram_counts(docs, size).collect()
    assert len(rows) == len({(r["doc_id"], r["feat"]) for r in rows})
    assert {(r["doc_id"], r["feat"]): r["cnt"] for r in rows} == plain(size)


@pytest.mark.parametrize("many", [adapters.BROADCAST_IDS, 0])
def test_first_places(spark, monkeypatch, many):
    monkeypatch.setattr(adapters, "BROADCAST_IDS", many)
    docs = spark.createDataFrame([t for t in TEXTS if t[0] is not None], "doc_id long, text string")
    ids = {r["tok"]: r["feat_id"] for r in dictionary.first_seen_vocab(docs).collect()}
    assert sorted(ids, key=ids.get) == ["a", "b", "c", "é"] and sorted(ids.values()) == [1, 2, 3, 4]


@pytest.mark.parametrize("make", [lambda d: ngrams.document_ngram_counts(d, 3), dictionary.first_places])
def test_no_table_of_many_documents(spark, make):
    """No sum by document holds the words of rows that stand alone: the one in the plan is that of the other rows."""
    docs = spark.createDataFrame([t for t in TEXTS if t[0] in (1, 2, 3)], "doc_id long, text string")
    out = make(docs)
    rows = out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert rows and "ObjectHashAggregate" not in plan
    final = plan.split("== Initial Plan ==")[0]
    alone = [part for part in final.split("Union") if "Generate" in part]
    assert alone and "HashAggregate" not in final  # the others are known to be none once they are read
