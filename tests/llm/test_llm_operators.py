"""Operators against brute force on small inputs, with nulls, empty tables, repeated rows and clashing names."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from seqloom.llm import ann, components, decontam, linededup, lstmcrf, pii, sentencepieces, simhash, tokencount, toxicity, urlfilter, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_docs(spark, more=""):
    """Null and empty texts, a null key, repeated rows, a very long text, and columns named like results."""
    rows = [(1, None), (2, ""), (None, "a b c"), (None, "a b c"), (3, "a b c"), (4, " \n\t"), (5, "wörd " * 60_000), (6, "x\ny\nz"), (6, "x\ny\nz")]
    clash = ("score", "spans", "base", "matches", "token_ids", "n_lines", "n_removed", "verdict", "lang")
    return spark.createDataFrame([(*r, *("old",) * len(clash)) for r in rows], DOCS + "".join(f", {c} string" for c in clash))


# -- line dedup


def dedup_by_hand(rows):
    """(key, text) to (text left, lines, lines lost): every two successive lines with text, known from an earlier place, go."""
    seen, out = set(), {}
    for k, text in rows:
        lines = (text or "").split("\n")
        full = [i for i, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for i, j in zip(full, full[1:]):
            if (lines[i], lines[j]) in seen:
                gone.update(range(i, j + 1))
            seen.add((lines[i], lines[j]))
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        out[k] = (left if gone else text, len(lines), len(gone))
    return out


@pytest.mark.parametrize("bits", [64, 5])  # with 5 bits most hashes clash, and bytes decide
def test_line_dedup_against_brute_force(spark, docs, texts, bits):
    some = docs if bits == 64 else docs.where("doc_id < 40")
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in linededup.dedup(some, bits=bits).collect()}
    want = dedup_by_hand([(k, texts[k]) for k in sorted(texts) if bits == 64 or k < 40])
    assert got == want and (bits < 64 or any(n for _, _, n in want.values()))


def test_passages_of_every_length_go(spark):
    r = random.Random(1)
    rows, passages = [], []
    for k in range(60):
        p = [f"shared {r.random()} of some words" for _ in range(2 + k % 9)]
        passages.append(p)
        for _ in range(2):
            rows.append((len(rows), "\n".join([f"own {r.random()}" for _ in range(r.randrange(4))] + p + [f"own {r.random()}" for _ in range(r.randrange(4))])))
    got = {x["doc_id"]: x["text"] for x in linededup.dedup(spark.createDataFrame(rows, DOCS)).collect()}
    for k, p in enumerate(passages):
        assert "\n".join(p) in got[2 * k] and not any(line in got[2 * k + 1] for line in p)
    assert sum(t.count("own") for t in got.values()) == sum(t.count("own") for _, t in rows)


def test_line_dedup_of_copies(spark):
    df = spark.createDataFrame([(3, "a\nb\nc"), (1, "a\nb\nc"), (2, "one line"), (4, "one line"), (None, "a\nb\nc"), (5, None), (6, "\n\n"), (7, "\n\n")], DOCS)
    assert {r["doc_id"]: r["text"] for r in linededup.dedup(df).collect()} == {1: "a\nb\nc", 3: "", None: "", 2: "one line", 4: "one line", 5: None, 6: "\n\n", 7: "\n\n"}


def test_line_dedup_of_rows_that_share_keys(spark):
    rows = [(1, "a\nb"), (None, "a\nb"), (None, "unique x\nunique y"), (7, "a\nb"), (7, "only\nhere"), (7, "only\nhere"), (None, "n\nm"), (None, "n\nm"), (None, "n\nm")]
    df = spark.createDataFrame([(*r, "kept", 1) for r in rows], f"{DOCS}, `a.b` string, row int")
    out = linededup.dedup(df)
    assert out.columns == ["doc_id", "text", "a.b", "row", "n_lines", "n_removed"]
    left = sorted((r["doc_id"] or 0, r["text"]) for r in out.collect())
    assert left == [(0, ""), (0, ""), (0, ""), (0, "n\nm"), (0, "unique x\nunique y"), (1, "a\nb"), (7, ""), (7, ""), (7, "only\nhere")]


# -- url filter


def test_urls_against_plain_rules(spark):
    r = random.Random(4)
    rules = [urlfilter.parse_rule(*x) for x in [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"), ("block", "net"), ("allow", "a.net/x")]]
    hosts = ["example.org", "WWW.Example.org", "org", "notexample.org", "a.com", "com", "x.net", "a.net", "", "b.a.net."]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/12/3", "/en/2", "/fr/a?b#c", "/de/", "#x", "?q=/de/", "/x/y"]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)] + [None, "", "no scheme", "://"]

    def judged(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h.split(".")), len(p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)] if host else []
        return (host, path, *(max(fits)[2:] if fits else (None, "allow")))

    df = spark.createDataFrame([(k, u, "old") for k, u in enumerate(urls)], "page_id long, url string, verdict string")
    for most in (urlfilter.MOST, 0):  # the trie, and the joins for rule sets past its bound
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(df, rules, most=most).collect()}
        assert got == {k: judged(u) for k, u in enumerate(urls)}
    assert urlfilter.judge(df.limit(0), rules).count() == 0


# -- warc


def test_warc_round_trip(spark, tmp_path):
    long = "ä" * 600 + "\r\n\r\nWARC/1.1\r\n"
    rows = [(1, "http://a/", long), (2, "http://b/", long), (3, None, None), (4, "http://c/", "short"), (5, "http://d/", "short"), (6, "http://e/\r\nx", "\r\n"), (7, "u", long + "x")]
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    found = warc.captures(warc.read(spark, str(tmp_path / "w"))).collect()
    by_page = {int(re.search(rb"page-id: (\d+)", r["metadata"][0]["content"])[1]): r for r in found}
    assert sorted(by_page) == [1, 2, 3, 4, 5, 6, 7]
    for k, _, html in rows:
        data = (html or "").encode()
        r = by_page[k]
        assert (r["payload_bytes"], r["digest"], r["type"]) == (len(data), hashlib.sha1(data).hexdigest(), "revisit" if k == 1 else "response")
        assert len(r["requests"]) == 1 and (k == 1 or bytes(r["payload"]) == (html or "").encode())
    assert by_page[1]["refers_to"] == by_page[2]["capture_id"]


def test_warc_of_odd_rows(spark, tmp_path, monkeypatch):
    """Null and repeated keys, repeated rows, clashing names, an empty table; and the join beyond the broadcast's bound."""
    long = "x" * 1500
    rows = [(None, "u", long), (None, "u", long), (5, "u", long), (5, "u", long), (5, None, "other"), (None, None, None)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], "page_id long, url string, html string, sha1 string, body string, nth int")
    for bound in (1 << 20, 0):
        monkeypatch.setattr(warc, "BROADCAST", bound)
        path = str(tmp_path / f"w{bound}")
        warc.write(df, path)
        found = warc.captures(warc.read(spark, path, content=False), warc.read(spark, path)).collect()
        assert len({r["capture_id"] for r in found}) == 6 and sorted(r["type"] for r in found) == ["response"] * 4 + ["revisit"] * 2
        known = {r["capture_id"] for r in found if r["type"] == "response"}
        assert all(r["refers_to"] in known for r in found if r["type"] == "revisit")
        assert sorted(bytes(r["payload"]).decode() for r in found if r["type"] == "response") == ["", "other", long, long]
    warc.write(df.limit(0), str(tmp_path / "none"))
    assert warc.captures(warc.read(spark, str(tmp_path / "none"))).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    """Plain archives, those with a gzip member per record, records behind each other without order, and broken ones."""
    import gzip

    def record(kind, me, to, block, http=False):
        head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {me}\r\n" + (f"WARC-Concurrent-To: {to}\r\n" if to else "") + ("Content-Type: application/http; msgtype=response\r\n" if http else "")
        return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"\xff\x00 a\r\n\r\n\r\nb\r\n"
    parts = [record("metadata", "<m>", "<r>", b"x: y\r\n"), record("request", "<q>", "<r>", b"GET /"), record("response", "<r>", None, b"HTTP/1.1 200 OK\r\n\r\n" + body, True), record("warcinfo", "<i>", None, b"\r\n\r\n")]
    (tmp_path / "one").mkdir(), (tmp_path / "two").mkdir(), (tmp_path / "bad").mkdir()
    (tmp_path / "one" / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "two" / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    for name in ("one", "two"):
        (row,) = warc.captures(warc.read(spark, str(tmp_path / name))).collect()
        assert bytes(row["payload"]) == body and row["digest"] == hashlib.sha1(body).hexdigest()
        assert [bytes(m["content"]) for m in row["metadata"]] == [b"x: y\r\n"] and len(row["requests"]) == 1
    (tmp_path / "bad" / "a.warc").write_bytes(b"".join(parts)[:-30])
    with pytest.raises(Exception, match="within a record"):
        warc.read(spark, str(tmp_path / "bad")).collect()


# -- neighbours


def test_neighbours_reach_the_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[100:110] = x[0]  # copies, and so ties
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 32), (5002, [float("nan")] + [1.0] * 31), (5003, [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(ann.build(df), df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = x.astype(np.float64)
    assert sorted(got) == list(range(0, 3000, 50))
    hits = 0
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(3000), d))[:10]
        found.sort()
        assert [f[0] for f in found] == list(range(1, 11))
        assert [f[2] for f in found] == pytest.approx([d[f[1]] for f in found])
        hits += len({f[1] for f in found} & set(best.tolist()))
    assert hits / (10 * len(got)) >= 0.9
    assert [f[1] for f in got[0]] == list(range(100, 110))


def test_neighbours_reach_the_recall_past_leaves_and_lists(spark, monkeypatch):
    """First lists as small beside the table as they are beside a large one; the queries are not in the index."""
    for name, value in (("ENTRIES", 8), ("BEGIN", 2)):
        monkeypatch.setattr(ann, name, value)
    x = np.random.default_rng(1).normal(size=(2040, 48))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(ann.build(df.where("vec_id < 2000")), df.where("vec_id >= 2000"), size=11).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    d = np.sqrt(((x[2000:, None] - x[None, :2000]) ** 2).sum(2))
    hits = sum(len(got[2000 + q] & set(np.argsort(d[q])[:10].tolist())) for q in range(40))
    assert hits / 400 >= 0.94


def test_descent_makes_the_graph(spark):
    """The first graph knows few of the neighbours, the rounds find the others."""
    x = np.random.default_rng(2).normal(size=(3000, 24))
    nodes = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node long, vec array<double>").cache()
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    best = np.argsort(d, axis=1)[:, :10]

    def recall(graph):
        near = {}
        for r in graph.collect():
            near.setdefault(r["a"], set()).add(r["b"])
        return np.mean([len(near.get(k, set()) & set(best[k].tolist())) for k in range(len(x))]) / 10

    graph = ann.write_table(ann.first_graph(nodes, 3000, 20), "g")
    before = recall(graph)
    for _ in range(8):
        graph = ann.write_table(ann.descend(graph, nodes, 20), "g")
    assert before < 0.5 and recall(graph) >= 0.9
    assert graph.where("fresh").count() < 0.01 * 60_000


def test_neighbours_of_several_lengths_and_repeated_rows(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 2.0, 0.0]), (5, [1.0, 1.0]), (5, [0.0, 0.5]), (None, [1.0, 0.0]), (6, [7.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, `embed.ding` array<float>, rank string, node int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 6)) for r in ann.search(ann.build(df, vector="embed.ding"), df.where("vec_id in (1, 3, 6)"), vector="embed.ding").collect())
    assert got == [(1, 1, 5, 1.0), (1, 2, 2, 1.414214), (3, 1, 4, 2.236068)]


def test_queries_with_equal_vectors_leave_out_their_own_ids(spark):
    rows = [(k, [1.0, 2.0]) for k in range(15)] + [(20, [4.0, 6.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(ann.build(df), df.where("vec_id in (0, 7, 14, 20)"), k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in (0, 7, 14):
        assert got[q] == [(n + 1, v, 0.0) for n, v in enumerate([k for k in range(15) if k != q][:10])]
    assert got[20] == [(n + 1, n, 5.0) for n in range(10)]


def test_neighbours_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    rows = [tuple(r) for r in ann.search(ann.build(df), df.where("vec_id = 1")).orderBy("rank").collect()]
    assert rows == [(1, 1, 3, 0.0), (1, 2, 2, pytest.approx(2**0.5))]
    assert ann.search(ann.build(df.limit(0)), df.limit(0)).count() == 0


# -- token counts


def random_edits(r, text, many=5):
    return [(a := r.randrange(len(text) + 1), a + r.randrange(9), r.choice(["", " ", "\n", "é9", "some words", "'s"])) for _ in range(many)]


def test_recounts_equal_counts_of_the_edited_text(spark, texts):
    coder = tokencount.counter(RANKS, public_tokenizers.PATTERN)
    r = random.Random(2)
    for text in [*list(texts.values())[:40], "", "a", "   ", "\n\n  x"]:
        tree = tokencount.Tree.load(text, tokencount.Tree.of(text, coder).store(), coder)
        edits = tokencount.usable(random_edits(r, text), len(text))
        for e in edits:
            tree.apply(*e)
        after = tokencount.apply_edits(text, edits)
        assert tree.flat()[0] == after
        assert tree.total == len(coder.coder.encode_ordinary(after))
        kept = tokencount.Tree.load(after, tree.store(), coder)
        assert kept.total == tree.total and kept.flat()[1].sum() == len(after)


def test_trees_are_kept_over_edits(spark, texts, tmp_path):
    """Trees are written, edited from the table, written again and edited again; counts are those of the texts as they then are."""
    coder = tokencount.counter(RANKS, public_tokenizers.PATTERN).coder
    r = random.Random(3)
    now = {k: t or "" for k, t in list(texts.items())[:60]} | {-1: "", -2: "wörd " * 5000}
    trees = tokencount.build(spark.createDataFrame([(k, t, "x") for k, t in now.items()], f"{DOCS}, n_after string"), RANKS, public_tokenizers.PATTERN)
    for turn in range(2):
        trees.write.parquet(str(tmp_path / f"t{turn}"))
        trees = spark.read.parquet(str(tmp_path / f"t{turn}"))
        edits = {k: random_edits(r, t, 3) for k, t in now.items()}
        told = spark.createDataFrame([(k, [dict(zip(("start", "end", "new"), e)) for e in v]) for k, v in edits.items()], "doc_id long, e array<struct<start:int,end:int,new:string>>")
        trees = tokencount.recount(trees.join(told, "doc_id"), F.col("e"), RANKS, public_tokenizers.PATTERN).drop("e")
        before, now = now, {k: tokencount.apply_edits(t, tokencount.usable(edits[k], len(t))) for k, t in now.items()}
        for row in trees.collect():
            k = row["doc_id"]
            assert row["text"] == now[k]
            assert (row["n_before"], row["n_after"]) == (len(coder.encode_ordinary(before[k])), len(coder.encode_ordinary(now[k])))
            assert row["n_tokens"] == row["n_after"] and (k != -2 or row["n_recounted"] < 200)


# -- toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out()).join(labels, "doc_id").where("held").collect()
    hit = sum(r["predicted"] == r["toxic"] for r in rows) / len(rows)
    bad, good = (np.array([r["score"] for r in rows if r["toxic"] == y]) for y in (1, 0))
    assert hit >= 0.93 and (bad[:, None] > good[None, :]).mean() >= 0.93
    hard = spark.createDataFrame([(1, None, 5), (2, "", 6)], "doc_id long, text string, score int")
    scores = [r["score"] for r in toxicity.score(hard, model).collect()]
    assert len(scores) == 2 and all(0 <= s <= 1 for s in scores)


def test_misspellings_share_grams():
    words = ["horrible", "lovely"]
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["the", "of", "tree", "river"], k=12) + [words[k % 2]]) for k in range(400)]
    weight, bias = toxicity.train(texts, np.array([1 - k % 2 for k in range(400)]), 0.5)
    import pyarrow as pa

    def score(text):
        heads, weights, _ = toxicity.bag(pa.array([text]))
        return 1 / (1 + np.exp(-(weight[heads] @ weights + bias)))

    assert score("the river horrrible tree") > score("the river lovvely tree")


# -- decontamination


def edits_by_hand(item, window):
    row = [0] * (len(window) + 1)
    for k, w in enumerate(item, 1):
        row, old = [k], row
        for j, v in enumerate(window, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (w != v)))
    return min(row)


def words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_leaks_against_brute_force(spark, docs, texts):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    held = {r["item_id"]: words(r["text"]) for r in items.collect()}
    r = random.Random(3)
    planted = []
    for k, (i, w) in enumerate(held.items()):  # with up to a fifth of the words changed
        w = list(w)
        for at in r.sample(range(len(w)), min(len(w) // 5, k % 4)):
            w[at] = "changed"
        planted.append((10_000 + k, "before these " + " ".join(w) + " and after"))
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, DOCS))
    got = {(row["doc_id"], m["item"]) for row in decontam.find(both, items).collect() for m in row["matches"]}
    want = set()
    for k, text in [*texts.items(), *planted]:
        there = words(text)
        some = set(there)
        for i, w in held.items():
            slack = int(0.2 * len(w) + 1e-9)
            if sum(x not in some for x in w) <= slack and edits_by_hand(w, there) <= slack:
                want.add((k, i))
    assert got == want and len(want) >= len(held)


@pytest.mark.parametrize("spread", ["random", "even"])
def test_leaks_of_every_length_with_all_edits_allowed(spread):
    import pyarrow as pa

    r = random.Random(11)
    lengths = [1, 3, 4, 5, 6, 8, 9, 10, 13, 14, 15, 16, 19, 20, 25, 30, 60]
    held = [[f"w{r.randrange(10**6)}" for _ in range(n)] for n in lengths for _ in range(100)]
    texts = []
    for w in held:
        w, slack = list(w), len(w) // 5
        places = r.sample(range(len(w)), slack) if spread == "random" else [(2 * k + 1) * len(w) // (2 * slack) for k in range(slack)]
        for at in sorted(places, reverse=True):  # a word changed, put in or taken out
            w[at : at + 1] = r.choice([["changed"], [w[at], "added"], []])
        texts.append(" ".join(["before"] * r.randrange(4) + w + ["after"] * r.randrange(4)))
    index = decontam.Index(list(enumerate(" ".join(w) for w in held)))
    words, bounds, _, _ = decontam.hashed_words(pa.array(texts))
    found = {(t, i) for t, i, *_ in decontam.verified(index, words, bounds, decontam.candidates(index, words, bounds))}
    missed = [len(w) for t, w in enumerate(held) if (t, t) not in found]
    assert all(missed.count(n) <= 0.01 * 100 for n in lengths), missed


def test_leaks_of_many_blocks_and_places(spark):
    items = spark.createDataFrame([(k, f"item {k} has some few words of its own {k}") for k in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x item 3 has some few words of its own 3 y " * 2), (2, "item 7 has some few words of its own 7"), (3, "clean")], DOCS)
    one, many = (sorted((r["doc_id"], [tuple(m) for m in r["matches"] if m["edits"] == 0]) for r in decontam.find(docs, items, block=b).collect()) for b in (1000, 7))
    assert one == many and [len(m) for _, m in one] == [2, 1, 0]
    text = docs.first()["text"]
    assert all(text[a:b] == "item 3 has some few words of its own 3" for _, a, b, _ in one[0][1])


# -- sentencepiece


def test_pieces_equal_the_library(spark, texts):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    hard = ["", None, " ", "  a  b ", "a\n\n b", "▁x ▁▁ y", "　 wide", "tab\there", "é́ ﬁ ½", "\x00\x01", "日本語 テキスト", "🙂" * 50, "x" * 30_000, "</s> <unk>", "a\r\nb"]
    rows = [(k, t) for k, t in enumerate([*hard, *texts.values()])]
    got = {r["doc_id"]: r for r in sentencepieces.encode(spark.createDataFrame(rows, DOCS), MODEL).collect()}
    for k, t in rows:
        ids = sp.encode(t or "", add_eos=True)
        assert list(got[k]["token_ids"]) == ids, t
        assert got[k]["decoded"] == sp.decode(ids), t


# -- simhash


def print_by_hand(text):
    from xxhash import xxh64_intdigest

    parts = [p for p in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if p]
    grams = [" ".join(parts[k : k + 3]) for k in range(max(1, len(parts) - 2))] if parts else []
    h = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = {k: print_by_hand(t) for k, t in texts.items()}
    assert {k: r["fp"] % 2**64 for k, r in got.items()} == prints
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(prints)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert {k: r["component_id"] for k, r in got.items()} == {k: top(k) for k in keys}


def test_every_link_over_shards(spark, monkeypatch):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 2**63, 150, dtype=np.int64).view(np.uint64)
    points = np.unique(np.concatenate([seeds, *(seeds ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64)) for _ in range(3))]))
    monkeypatch.setattr(simhash, "SHARD", 64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, every=True).collect()}
    want = {frozenset((int(a), int(b))) for i, a in enumerate(points.view(np.int64)) for b in points.view(np.int64)[i + 1 :] if int(np.bitwise_count(np.uint64(a.view(np.uint64) ^ b.view(np.uint64)))) <= 3}
    assert got == want and len(want) > 300


def test_shards_are_parted_until_small(spark, monkeypatch):
    """With small bounds shards are parted over several rounds, and no link is lost."""
    rng = np.random.default_rng(6)
    seeds = rng.integers(0, 2**63, 400, dtype=np.int64)
    points = np.unique(np.concatenate([seeds, *(seeds ^ (1 << rng.integers(0, 63, 400)) for _ in range(3))]))
    for name, value in (("SHARD", 32), ("MOST", 64), ("SAMPLE", 40)):
        monkeypatch.setattr(simhash, name, value)
    df = spark.createDataFrame([(int(p),) for p in points], "fp long")
    rows = simhash._sharded(df, 3)
    assert rows.where("home").count() == len(points) and rows.where("home").groupBy("shard").count().agg(F.max("count")).first()[0] <= 64
    got = {frozenset((r["a"], r["b"])) for r in simhash.links(df, every=True).collect()}
    want = {frozenset((int(a), int(b))) for i, a in enumerate(points) for b in points[i + 1 :] if int(a ^ b).bit_count() <= 3}
    assert got == want


def test_one_document_of_each_group_stays(spark):
    df = spark.createDataFrame([(3, "a b c d"), (1, "a b c d"), (2, "other words here now"), (None, "a b c d"), (5, None), (6, "")], DOCS)
    assert sorted((r["doc_id"] for r in simhash.one_of_each(df).collect()), key=str) == [1, 2, 5, None]
    # rows of one key and different texts are of different groups; equal rows are of one
    df = spark.createDataFrame([(1, "a b c d", "x", 2), (1, "quite other words stand here", "x", 2), (1, "a b c d", "x", 2), (2, "a b c d", "x", 2)], f"{DOCS}, `a.b` string, fp int")
    out = simhash.one_of_each(df)
    assert out.columns == df.columns and sorted(r["text"] for r in out.collect()) == ["a b c d", "quite other words stand here"]


def test_components_of_a_path_and_loops(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 100), (7, 7), (200, 201), (200, 201)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(51)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- personal data

FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def spans_by_hand(text):
    out = []
    for k, (kind, form) in enumerate(FORMS):
        for m in re.finditer(form, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            if kind == "ip" and max(map(int, m.group().split("."))) > 255:
                continue
            if kind == "card" and not (14 <= len(d) <= 19 and sum(x if j % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for j, x in enumerate(d[::-1])) % 10 == 0):
                continue
            if kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_patterns_against_plain_regular_expressions(texts):
    r = random.Random(6)
    made = ["".join(r.choice(["1", "23", "4.", ".", "@", "a", "-", " ", "+", "(", ")", "b.c", "0", "255", "٣", "é", "%"]) for _ in range(r.randrange(60))) for _ in range(4000)]
    cards = ["4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (724) 555-7058", "1.2.3.4.5.6.7.8", "256.1.1.1.1", "a@b.c.d@e.f", "a@b@c.d"]
    for t in [*texts.values(), *made, *cards]:
        assert pii.patterns(t or "") == spans_by_hand(t or ""), t


def test_lstm_gradient_by_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in lstmcrf.start(3).items()}
    x, y = rng.integers(32, 120, (4, 9)).astype(np.int16), rng.integers(0, 3, (4, 9)).astype(np.int8)
    _, grad = lstmcrf.loss_and_gradient(p, x, y)
    for name, g in grad.items():
        flat = int(np.abs(g).argmax())
        at = np.unravel_index(flat, g.shape)
        old = p[name][at]
        p[name][at] = old + 1e-4
        high, _ = lstmcrf.loss_and_gradient(p, x, y)
        p[name][at] = old - 1e-4
        low, _ = lstmcrf.loss_and_gradient(p, x, y)
        p[name][at] = old
        assert g[at] == pytest.approx((high - low) / 2e-4, rel=2e-2), name


def test_model_adds_what_patterns_miss(spark, docs):
    model = pii.fit(docs)
    x, y = pii.training_windows(["these", "are", "other", "words"], 300, seed=99)
    assert (lstmcrf.decode(model, x) == y).mean() >= 0.95
    df = spark.createDataFrame([(1, "please call (614) 555-1234 or mail jo.smith7 [at] corp9.example.com soon"), (2, None), (3, "nothing here"), (4, "call +1 (614) 555-1234")], DOCS)
    rows = {r["doc_id"]: r for r in pii.find(df, model).collect()}
    assert rows[1]["base"] == [] and len(rows[1]["spans"]) >= 1
    assert rows[2]["spans"] == rows[3]["spans"] == [] and [s["kind"] for s in rows[4]["base"]] == ["phone"]


def test_reading_around_triggers_equals_reading_all(texts):
    model = lstmcrf.train(*pii.training_windows("the of and river tree house".split(), 600), 1 + 2 * len(pii.KINDS))
    r = random.Random(8)
    made = ["".join(r.choice(["jane.doe", "[at]", "(at)", " ", "@", "mail.example.com", "x" * 40, "555-1234", "(614) ", "the ", "1.2[.]3.4"]) for _ in range(r.randrange(40))) for _ in range(150)]
    for some in ([*texts.values()][:60], made, ["", "x", "5" * 31, "x" * 48 + "7"]):
        assert pii.find_in([t or "" for t in some], model) == pii.find_in([t or "" for t in some], model, every=True)


def test_mails_without_a_digit_or_at_sign_are_read():
    words = "the of and river tree house walks under green hills jane doe".split()
    model = lstmcrf.train(*pii.training_windows(words), 1 + 2 * len(pii.KINDS))
    for mark in ("[at]", "(at)"):
        for pad in (0, 15, 27, 30, 40):  # in one window, and over the bounds of two
            text = "the river " * 20 + "x" * pad + f" jane.doe{mark}mail.example.com " + "under the green hills " * 20
            begin = text.index("jane")
            end = text.index(".com") + 4
            _, (spans,) = pii.find_in([text], model)
            assert any(k == 0 and a < text.index(mark) and b >= end - 4 and begin <= a and b <= end for k, a, b in spans), (mark, pad, spans)


def sentences(many, seed):
    """Texts with a value in one of eleven forms that the patterns do not take, and something like a value behind it: text, kind, start, end."""
    r = random.Random(seed)
    plain = "please call the river said to about under green house write and it was from now number server office order see".split()

    def d(n):
        return "".join(str(r.randrange(10)) for _ in range(n))

    def card(gap):
        first = [r.randrange(10) for _ in range(15)]
        total = sum((v * 2 - 9 * (v > 4)) if i % 2 == 0 else v for i, v in enumerate(reversed(first)))
        whole = "".join(map(str, first)) + str(-total % 10)
        return gap.join(whole[i : i + 4] for i in range(0, 16, 4))

    def words(a):
        return " ".join(r.choice(plain) for _ in range(r.randrange(a, 9)))

    for k in range(many):
        name, host = r.choice(["anna.k", "bob", "j_smith7", "mary-ann", "x.y"]), r.choice(["post.example.net", "corp.example.com", "mail7.example.org", "web.example.co.uk"])
        kind, value = [
            (0, f"{name}[at]{host}"), (0, f"{name} (at) {host}"), (0, f"{name} @ {host}"), (1, " . ".join(str(r.randrange(256)) for _ in range(4))), (1, "[.]".join(str(r.randrange(256)) for _ in range(4))),
            (2, card(".")), (3, f"{d(3)} {d(3)} {d(4)}"), (3, f"({d(3)}) {d(3)}-{d(4)}"), (3, f"{d(3)}-{d(3)}-{d(4)}"), (3, f"{d(3)}.{d(3)}.{d(4)}"), (3, f"00{r.randrange(1, 99)} {d(3)} {d(7)}"),
        ][k % 11]
        like = r.choice(["978-3-16-148410-0", f"{r.randrange(1900, 2100)}-{r.randrange(1, 13):02d}-{r.randrange(1, 29):02d}", d(r.randrange(3, 12)), f"{d(3)}-{d(3)}-{d(6)}", f"v{d(1)}.{d(2)}.{d(1)}", f"{d(2)}:{d(2)}"])
        before = words(2) + " "
        yield before + value + " " + words(2) + " " + like + " " + words(1), kind, len(before), len(before) + len(value)


def test_added_spans_have_the_bounds_of_their_values(spark, docs):
    """Exact bounds and kinds: nine of ten values are found, and nine of ten added spans are values."""
    model = pii.fit(docs)
    held = [*sentences(440, 77)]
    base, spans = pii.find_in([h[0] for h in held], model)
    hits = sum((k, a, b) in s for (_, k, a, b), s in zip(held, spans))
    wrong = sum(x != (k, a, b) for (_, k, a, b), s, p in zip(held, spans, base) for x in s if x not in p)
    assert hits >= 0.9 * len(held) and hits >= 0.9 * (hits + wrong), (hits, wrong)
    cut = ["mail to anna.k[at]post.example.org now", "anna.k (at) corp.example.com said", "ISBN 978-3-16-148410-0 here", "no 614-555-123456 there"]
    _, found = pii.find_in(cut, model)
    assert all((0, text.index("anna"), text.index("example.") + 11) == s for text, row in zip(cut, found[:2]) for s in row) and found[2:] == [[], []]


# -- all: odd rows and empty tables


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, docs, empty):
    df = odd_docs(spark)
    df = df.limit(0) if empty else df
    many = 0 if empty else 9
    items = spark.createDataFrame([(1, "wörd wörd wörd"), (1, "a b c"), (2, None), (None, "a b c")], "item_id long, text string")
    labels = spark.createDataFrame([(3, 1), (1, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert linededup.dedup(df).count() == many
    assert toxicity.score(df, toxicity.fit(df, labels)).where("score between 0 and 1").count() == many
    found = decontam.find(df, items)
    assert found.count() == many and found.where(F.size("matches") > 0).count() == (4 if many else 0)
    assert decontam.find(df, items.limit(0)).where(F.size("matches") > 0).count() == 0
    assert sentencepieces.digests(sentencepieces.encode(df, MODEL)).count() == many
    assert simhash.near_duplicates(df).count() == many
    assert pii.find(df, lstmcrf.start(9)).count() == many
    trees = tokencount.build(df, RANKS, public_tokenizers.PATTERN)
    assert tokencount.recount(trees, F.lit(None), RANKS, public_tokenizers.PATTERN).where("n_before = n_after").count() == many


def test_names_with_dots_and_ticks(spark, docs):
    """Columns that are kept may have any name."""
    df = docs.select("doc_id", "text", F.lit(1).alias("a.b"), F.lit(2).alias("c`d")).limit(20)
    items = spark.createDataFrame([(1, "some words of an item")], "item_id long, text string")
    kept = ["doc_id", "text", "a.b", "c`d"]
    made = [linededup.dedup(df), toxicity.score(df, (np.zeros(toxicity.BUCKETS), 0.0)), decontam.find(df, items), sentencepieces.encode(df, MODEL), simhash.one_of_each(df), pii.find(df, lstmcrf.start(9)), tokencount.build(df, RANKS, public_tokenizers.PATTERN)]
    pages = df.withColumnRenamed("text", "url")
    made += [urlfilter.judge(pages, [urlfilter.parse_rule("block", "com/")], most=m).withColumnRenamed("url", "text") for m in (10, 0)]
    for out in made:
        assert out.columns[:4] == kept and all(r["a.b"] == 1 and r["c`d"] == 2 for r in out.collect())


def test_toxicity_learns_alike_under_any_names(spark, docs):
    """Keys, texts and labels with dots, or named like what the trainer makes."""
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    want = toxicity.fit(docs, labels)
    for names in (("the.key", "t", "y"), ("k", "a`b", "la.bel"), ("y", "k", "t")):
        some = docs.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "text"), names)))
        told = labels.select(*(F.col(c).alias(n) for c, n in zip(("doc_id", "toxic"), names[::2])))
        got = toxicity.fit(some, told, *names)
        assert np.array_equal(got[0], want[0]) and got[1] == want[1] and want[0].any()
