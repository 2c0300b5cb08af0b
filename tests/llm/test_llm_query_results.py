"""Queries without SQL against brute force: whole tables, with the strings and digests that they return."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from test_llm_operators import MODEL, RANKS, SF, edits_by_hand, print_by_hand, spans_by_hand, words

from seqloom.llm import pii, queries, tokencount


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op4_nearest_of_every_hundredth(spark):
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    ids = np.array([i for i, v in rows.items() if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)])
    x = np.array([rows[i] for i in ids], np.float64)
    got = {}
    for r in queries.op4_neighbours(spark, SF).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == {i for i in ids if i % 100 == 0}
    hit = 0
    for q, near in got.items():
        d = dict(zip(ids.tolist(), np.sqrt(((x - x[ids == q]) ** 2).sum(1))))
        del d[q]
        assert [n for n, _, _ in near] == list(range(1, 1 + min(10, len(d))))
        assert all(s == pytest.approx(d[i], abs=1e-12) for _, i, s in near)
        assert [(s, i) for _, i, s in near] == sorted((s, i) for _, i, s in near)
        hit += len({i for _, i, _ in near} & set(sorted(d, key=lambda i: (d[i], i))[:10]))
    assert hit >= 0.95 * sum(map(len, got.values()))


def test_op5_counts_of_whole_edited_texts(spark, texts):
    coder = tokencount.counter(RANKS, public_tokenizers.PATTERN).coder
    got = {r["doc_id"]: r for r in queries.op5_token_counts(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        a, b, c = (len(t) * j // 4 for j in (1, 2, 3))
        edits = [(a, a + 10, ""), (b, b, " edited words "), (c, c + 5, "XXXXX")]
        now = t[:a] + t[a + 10 : b] + " edited words " + t[b:c] + "XXXXX" + t[c + 5 :] if len(t) >= 40 else tokencount.apply_edits(t, tokencount.usable(edits, len(t)))
        assert (got[k]["n_before"], got[k]["n_after"]) == (len(coder.encode_ordinary(t)), len(coder.encode_ordinary(now)))


def test_op7_items_found_in_documents(spark, texts):
    items = {r["item_id"]: words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    rows = queries.op7_decontamination(spark, SF).collect()
    want = set()
    for k, t in texts.items():
        there = words(t)
        some = set(there)
        for i, w in items.items():
            slack = int(0.2 * len(w) + 1e-9)
            if sum(x not in some for x in w) <= slack and edits_by_hand(w, there) <= slack:
                want.add((k, i))
    assert {(r["doc_id"], r["item_id"]) for r in rows} == want and want
    for r in rows:  # the bytes from start to end hold the item, within the edits that are told
        place = texts[r["doc_id"]].encode()[r["start"] : r["end"]].decode()
        assert edits_by_hand(items[r["item_id"]], words(place)) <= r["edits"] <= int(0.2 * len(items[r["item_id"]]) + 1e-9)


def test_op8_digests_of_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op8_sentencepiece(spark, SF).collect()}
    coded = {k: sp.encode(t, add_eos=True) for k, t in texts.items()}
    assert got == {k: (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids))) for k, ids in coded.items()}


def test_op9_fingerprints_and_components(spark, texts):
    prints = {k: print_by_hand(t) for k, t in texts.items()}
    least = {k: k for k in prints}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    while any(least[a] != least[b] for a, b in links):
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {k: (f"{p:016x}", least[k]) for k, p in prints.items()}


def test_op10_base_spans_and_what_the_model_adds(spark, texts):
    rows = queries.op10_pii(spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        base = spans_by_hand(texts[r["doc_id"]])
        shown = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert [r[f"n_{kind}"] for kind in pii.KINDS] == [sum(k == n for k, _, _ in base) for n in range(4)]
        assert r["base_sha256"] == sha(",".join(shown))
        spans = r["spans"].split(",") if r["spans"] else []
        assert set(shown) <= set(spans)
        told = [(int(a), pii.KINDS.index(kind), int(b)) for kind, a, b in (s.split(":") for s in spans)]
        assert told == sorted(told) and all(0 <= a < b <= len(texts[r["doc_id"]]) for a, _, b in told)
