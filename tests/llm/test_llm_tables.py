"""Filter audit, I-Match fingerprints and vector codes against plain forms, with nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import math
import random
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqloom.llm import codebooks, filteraudit, imatch, inorder, queries

SF = "/root/testdata/sf0.001"


# -- filter audit


def audited_by_hand(docs, labels):
    """(part, order, step) to its counts, by running the filters on lists of documents."""
    least = {}
    for k, _, t in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    good, toxic = ({k for k, *v in labels if v[i] == 1 and k is not None} for i in (0, 1))
    rows = []
    for k, part, t in docs:
        t = t or ""
        w = t.split()
        fails = "".join(c for c, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), k is not None and k > least[t])) if x)
        rows.append((part or "", fails, k in good, k in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            there = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                removed = [r for r in there if f in r[1]]
                failing = sum(f in r[1] for r in rows if r[0] == part)
                there = [r for r in there if f not in r[1]]
                shapley[f] += len(removed)
                out[part, order, step] = [len(there), len(removed), failing - len(removed), sum(r[1] == f for r in rows if r[0] == part), sum(r[2] for r in removed), sum(r[3] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return out


def audited(spark, docs, labels):
    conditions = {k: F.expr(c) if c else None for k, c in queries.CONDITIONS.items()}
    rows = filteraudit.audit(docs, labels, conditions).collect()
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in rows}
    assert len(got) == len(rows)
    return got


def test_audit_against_running_the_filters(spark):
    r = random.Random(5)
    texts = [None, "", "a b", "A" * 9, "x # y", " ".join(f"w{k}" for k in range(250)), "same " * 300, " \t\n", "é\x0bb\x1cc " * 150] + [" ".join(r.choice(["Up", "low", "$", "mid", "x1"]) for _ in range(r.randrange(400))) for _ in range(6)]
    docs = [(r.choice([None, *range(40)]), r.choice([None, "", "web", "wiki"]), r.choice(texts)) for _ in range(90)]
    labels = [(k, r.choice([0, 1, None]), r.choice([0, 1, None])) for k in [None, *range(0, 40, 2), *range(0, 40, 4)]]
    plain = [(k, p, t.replace("\x1c", "_") if t else t) for k, p, t in docs]  # split() parts words at \x1c too
    df = spark.createDataFrame([(*d, "old", True) for d in plain], "doc_id long, source string, text string, part string, mask boolean")
    got = audited(spark, df, spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, good int"))
    assert got == audited_by_hand(plain, labels)
    assert len(got) == 3 * 600


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, source string, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(spark, none, labels) == {}
    some = spark.createDataFrame([(1, "s", "x")], none.schema)
    assert audited(spark, some, labels)["s", "ABCDE", 1] == [0, 1, 0, 1, 0, 0, 120]
    with pytest.raises(ValueError):
        filteraudit.outcomes(filteraudit.masks(some, labels, [None]), "ABCDEFG")


def test_incidence_parts_documents():
    m = filteraudit.incidence(3)
    assert m["kept"].shape == (8, 18)
    after = m["kept"] + np.cumsum(m["removed"].reshape(8, 6, 3), axis=2).reshape(8, 18)
    assert (after == 1).all()
    assert (m["removed"].reshape(8, 6, 3).sum(2) == (np.arange(8) > 0)[:, None]).all()


# -- documents beside their successors


def loosened(held):
    return inorder.unpacked(pa.array([bytes(held)], pa.binary()))[0].as_py()


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_next_text(spark, ranges):
    r = random.Random(2)
    rows = [(r.choice([None, *range(-5, 30)]), r.choice([None, "", "a", "b" * 2000, f"t{k}"])) for k in range(120)] + [(7, "twice")] * 40
    df = spark.createDataFrame([(*x, 1, "k") for x in rows], "doc_id long, text string, r int, k string").repartition(5)
    h = {x["t"]: x["h"] for x in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    got = inorder.with_next(df, ranges=ranges)
    rows_ = [x.asDict() | {c: loosened(x[c]) for c in ("text", "next_text")} for x in got.collect()]
    assert got.columns == ["doc_id", "text", "r", "k", "next_text"]
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, h[x[1] or ""]))
    want = sorted(((k, t or "", n or "") for (k, t), (_, n) in zip(order, order[1:] + order[:1])), key=repr)
    assert sorted(((x["doc_id"], x["text"], x["next_text"]) for x in rows_), key=repr) == want


def test_next_text_of_few(spark):
    df = spark.createDataFrame([(3, "x")], "doc_id long, text string")
    assert [(r["doc_id"], loosened(r["text"]), loosened(r["next_text"])) for r in inorder.with_next(df).collect()] == [(3, "x", "x")]
    assert inorder.with_next(df.where("false")).collect() == []


# -- fingerprints


def plain_terms(text):
    import re

    return {bytes(c + 32 if 65 <= c <= 90 else c for c in w.encode()) for w in re.findall(r"[A-Za-z0-9\x80-\U0010ffff]+", text or "")}


def hashed(term):
    return int(imatch.terms(pa.array([term.decode()]))[0][0])


def fingerprint_by_hand(text, lexicon):
    """The terms of each subset, sorted and hashed."""
    found = {hashed(t) for t in plain_terms(text)}
    band = found & lexicon
    used = band if len(band) >= imatch.FEW else found
    if not used and text:
        raw = text.encode()
        used = {int(imatch.range_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])}
    level = int(math.log2(len(used))) if used else 0
    out = f"{level:02x}"
    for at in range(level, level + imatch.LEVELS):
        for bucket in range(min(32, 1 << at)):
            inside = []
            for h in sorted(used):
                g = int(imatch.mix(np.array([h], np.uint64) ^ imatch.SALT)[0])
                if g % min(32, 1 << at) == bucket and (at <= 5 or (g >> 5) % (1 << (at - 5)) == 0):
                    inside.append(h)
            held = np.array(inside, np.uint64).view(np.uint8)
            out += f"{max(1, int(imatch.range_hashes(held, np.array([0]), np.array([len(held)]))[0]) & 0xFFFF) if inside else 0:04x}"
    return out


def test_fingerprints_against_sets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    seen = {}
    for t in texts:
        for term in plain_terms(t):
            seen[term] = seen.get(term, 0) + 1
    for lexicon, common in ((imatch.LEXICON, imatch.COMMON), (2000, 0.3)):
        edge = max(len(texts), sum(seen.values()))
        want = {hashed(t) for t, n in seen.items() if n * lexicon >= edge and n <= common * len(texts)}
        got = imatch.fit(docs, lexicon=lexicon, common=common)
        assert set(got.tolist()) == want and 0 < len(got) <= lexicon and (np.diff(got.astype(object)) > 0).all()
    odd = [None, "", "!!", "??", "a", "A a.", "the of", *texts[:25]]
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(odd)], "doc_id long, text string, fingerprint string")
    out = imatch.add_fingerprints(df, got, {"fingerprint": "text"})
    found = {r["doc_id"]: r["fingerprint"] for r in out.collect()}
    assert out.columns == ["doc_id", "text", "fingerprint"]
    assert [found[k] for k in range(len(odd))] == [fingerprint_by_hand(t, set(got.tolist())) for t in odd]
    assert found[0] == found[1] and found[2] != found[3] and found[4] == found[5]


def test_likeness():
    text = " ".join(f"w{k}" for k in range(400))
    edited = " ".join([f"w{k}" for k in range(300)] + [f"x{k}" for k in range(100)])
    none = np.zeros(0, np.uint64)
    a, b, c = imatch.fingerprints(pa.array([text, edited, " ".join(f"y{k}" for k in range(400))]), none)
    assert imatch.likeness(a, a) == 1 and 0.3 < imatch.likeness(a, b) == imatch.likeness(b, a) < 0.9 and imatch.likeness(a, c) == 0
    short, empty = imatch.fingerprints(pa.array(["one", ""]), none)
    assert imatch.likeness(short, a) == 0 and imatch.likeness(empty, empty) == 1 and imatch.likeness(empty, short) == 0


def test_query_of_fingerprints(spark):
    rows = sorted(queries.op12_fingerprints(spark, SF).collect(), key=lambda r: r["doc_id"])
    docs = sorted(spark.read.parquet(f"{SF}/documents.parquet").collect(), key=lambda r: r["doc_id"])
    texts = [d["text"] or "" for d in docs]
    lexicon = imatch.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    for k, (r, d) in enumerate(zip(rows, docs, strict=True)):
        next_ = texts[(k + 1) % len(texts)]
        cut = len(texts[k]) // 4
        edited = texts[k][: len(texts[k]) - cut] + next_[:cut]
        prints = imatch.fingerprints(pa.array([texts[k], edited, next_]), lexicon)
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (d["doc_id"], len(texts[k]), hashlib.sha256(edited.encode()).hexdigest(), *prints[:2])
        assert (r["near_edited"], r["near_next"]) == (imatch.likeness(*prints[:2]), imatch.likeness(prints[0], prints[2]))
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows]) > 0.95 and np.mean([r["near_next"] for r in rows]) < 0.05


def test_fingerprints_of_an_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert len(imatch.fit(none)) == 0
    assert imatch.add_fingerprints(none, imatch.fit(none), {"f": "text"}).collect() == []


# -- vector codes


def codes_by_hand(rows, parts=8, entries=16, scale=4096, rounds=6):
    """Plain Lloyd in Python integers."""
    kept = [(k, [math.floor(scale * x) for x in v]) for k, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[v[p * width : (p + 1) * width] for _, v in kept] for p in range(parts)]
    books = [[list(e) for e in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(x, books[p])[1] for x in cut[p]]
            for k in range(len(books[p])):
                group = [x for x, m in zip(cut[p], mine) if m == k]
                if group:
                    books[p][k] = [sum(c) // len(group) for c in zip(*group)]
    found = [[nearest(x, books[p]) for x in cut[p]] for p in range(parts)]
    out = sorted(((k, "".join(f"{found[p][i][1]:02x}" for p in range(parts)), sum(found[p][i][0] for p in range(parts))) for i, (k, _) in enumerate(kept)), key=repr)
    return out, ",".join(str(x) for b in books for e in b for x in e)


@pytest.mark.parametrize("seed,grid,n", [(1, 0.5, 150), (2, 1e-4, 200), (3, 1.0, 9), (4, 0.25, 60)])  # coarse grids are full of ties and of equal entries
def test_codes_against_plain_rounds(spark, seed, grid, n, monkeypatch):
    monkeypatch.setattr(codebooks, "BLOCK", 32)
    r = random.Random(seed)
    rows = [(k, [round(r.gauss(0, 1) / grid) * grid for _ in range(16)]) for k in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[0][1]), (1000, None), (1001, [None] + [0.0] * 15), (1002, [math.nan] * 16), (1003, [math.inf] * 16), (1004, [])]
    df = spark.createDataFrame([(*x, "old", 1) for x in rows], "vec_id long, embedding array<double>, code string, ints int").repartition(3)
    got = codebooks.compress(df)
    want, text = codes_by_hand([x for x in rows if x[0] != 1004])
    assert got.rows.columns == ["vec_id", "code", "error"]
    assert sorted(map(tuple, got.rows.collect()), key=repr) == want and got.text() == text


def test_codes_of_few_and_odd_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert codebooks.compress(none).rows.collect() == [] and codebooks.compress(none).text() == ""
    rows = [(1, [1.0] * 8), (2, [2.0] * 8), (3, [1.0] * 16), (4, [1.0] * 7), (5, [1e30] * 8)]
    got = codebooks.compress(spark.createDataFrame(rows, none.schema))
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in got.rows.collect()) == [(1, "00" * 8, 0), (2, "01" * 8, 0)]
    assert got.text() == ",".join(["4096,8192"] * 8)


@pytest.mark.parametrize("most", [codebooks.MOST_GROUPS, 0])
def test_totals_of_labels(spark, most):
    rows = [(k, k % 3 if k % 4 else None, k * 10) for k in range(50)]
    got = codebooks.with_totals(spark.createDataFrame(rows, "vec_id long, label int, error long"), "label", "error", "label_error", most=most).collect()
    want = {k: sum(e for _, m, e in rows if m == label) for k, label, _ in rows}
    assert {r["vec_id"]: r["label_error"] for r in got} == want and len(got) == 50


def test_bounds_hold_and_spare_distances():
    """After any shifts the bounds enclose the distances, and settled rounds look at few entries."""
    r = np.random.default_rng(7)
    centres = r.integers(-9000, 9000, (16, 8))
    x = centres[r.integers(0, 16, 4000)] + r.integers(-300, 300, (4000, 8))
    book = x[:16].copy()
    b = codebooks.first_bounds(x, book)
    looked = []
    for _ in range(8):
        total = codebooks.part_sums(x[None], b.code[None], 16)[0]
        new = np.where(total[:, 8:] > 0, total[:, :8] // np.maximum(total[:, 8:], 1), book)
        b, book = codebooks.shifted(b, codebooks.root_up(((new - book) ** 2).sum(1))), new
        looked.append(codebooks.reassign(x, book, b))
        d = codebooks.squares(x, book)
        assert (b.code == d.argmin(1)).all()
        assert (b.upper**2 >= d[np.arange(len(x)), b.code]).all() and (b.lower**2 <= d).all()
    assert looked[-1] < 4000 * 16 * 0.2
