import itertools

import pytest
from pyspark.sql import functions as F

from seqloom.functions import tokens
from seqloom.operators import dictionary, graphlets, ngrams, sequences
from seqloom.sources import attribute_text


def texts(df):
    return {(r["g"], r["feat"]): r["cnt"] for r in df.collect()}


@pytest.mark.parametrize(
    "edges, size, expected",
    [
        ([("a", "b"), ("b", "c"), ("a", "c")], 3, {"/5x2/_5/5/_5x2//": 3}),
        ([("a", "b"), ("b", "a")], 2, {"5/5/_5/5/": 2}),
        ([("a", "b"), ("b", "a"), ("a", "c")], 3, {"5//_5/5/_5/5x2/": 2}),
    ],
)
def test_graphlets_by_hand(spark, edges, size, expected):
    df = spark.createDataFrame([(1, a, b, 5) for a, b in edges], "g int, src string, dst string, type int")
    made = graphlets.pairs(df) if size == 2 else graphlets.triples(df)
    assert texts(graphlets.describe(made, df)) == {(1, k): v for k, v in expected.items()}


def test_node_texts_are_ordered_by_size_and_type(spark):
    """Not as texts: one edge of type 10 comes before two of type 5, and type 5 before type 10."""
    df = spark.createDataFrame([(1, "a", "b", 10), (1, "b", "c", 5), (1, "b", "c", 5), (1, "d", "a", 5)], "g int, src string, dst string, type int")
    sets = spark.createDataFrame([(1, "x", ["a", "b", "c", "d"])], "g int, id string, nodes array<string>")
    assert texts(graphlets.describe(sets, df)) == {(1, "/5/_5/10/_10/5x2/_5x2//"): 1}


def test_connected_sets_by_enumeration(spark):
    import random

    r = random.Random(2)
    nodes = list("abcdefg")
    edges = {(a, b) for a in nodes for b in nodes if a != b and r.random() < 0.2}
    links = {frozenset(e) for e in edges}

    def connected(s):
        seen, todo = {s[0]}, [s[0]]
        while todo:
            x = todo.pop()
            for y in s:
                if y not in seen and frozenset((x, y)) in links:
                    seen.add(y), todo.append(y)
        return len(seen) == len(s)

    n = spark.createDataFrame([(1, x) for x in nodes], "g int, n string")
    e = spark.createDataFrame([(1, a, b, 1) for a, b in edges], "g int, src string, dst string, type int")
    got = {tuple(r["nodes"]) for r in graphlets.connected_sets(n, e, 4).collect()}
    assert got == {s for s in itertools.combinations(nodes, 4) if connected(s)}


def test_wildcard_multiplicity(spark):
    df = spark.createDataFrame([(1, k, t) for k, t in enumerate("abc")], "b int, o int, tok string")
    for size, many in ((1, 3), (2, 4), (3, 4)):
        rows = [r["feat"] for r in ngrams.ngrams(df, size, ["b"], "o").collect()]
        by_array = spark.createDataFrame([(["a", "b", "c"],)], "w array<string>").select(F.explode(ngrams.array_ngrams("w", size)).alias("f")).collect()
        assert len(rows) == many and sorted(rows) == sorted(r["f"] for r in by_array)


@pytest.mark.parametrize("args, text", [((0x1A, 0xFFFD, 0xFFFE), "I1afffdfffe"), ((0x1A, 5, 0xFFFF), "I1a0005"), ((0x1A, 0xFFFF, 0xFFFF), "I1a")])
def test_packed_text(spark, args, text):
    row = spark.range(1).select(ngrams.pack_text(ngrams.pack(*(F.lit(a) for a in args))).alias("t"))
    assert row.first()["t"] == text
    entry, one, two = ngrams.unpack_text(F.col("t"), entry_bits=8)
    assert tuple(row.select(entry, one, two).first()) == args


@pytest.mark.parametrize("there, mi", [((1, 2), 0.6931471806), ((1, 3), 0.0), ((1, 2, 3, 4), 0.0), ((1,), 0.2157615543)])
def test_mutual_information_by_hand(spark, there, mi):
    df = spark.createDataFrame([(k, "AABB"[k - 1], ["f"] if k in there else ["g"]) for k in (1, 2, 3, 4)], "doc int, label string, words array<string>")
    found = {r["tok"]: r["mi"] for r in dictionary.mutual_information(df, "label").collect()}
    assert found["f"] == pytest.approx(mi, abs=1e-9)


def test_segments_count_on(spark):
    df = spark.createDataFrame([(1, k, y, k * 10) for k, y in enumerate("112221")], "seq int, pos int, label string, ts int")
    rows = sorted(sequences.segments(df).collect(), key=lambda r: r["start"])
    assert [(r["label"], r["start"], r["end"], r["seg_len"], r["cum_count"]) for r in rows] == [("1", 0, 20, 2, 2), ("2", 20, 50, 3, 5), ("1", 50, 50, 1, 6)]


def test_chains_over_ranges(spark):
    keys = [1, 2, 3, 7, 9, 10, (1 << 20) - 1, 1 << 20, (1 << 20) + 1, 1 << 22] + [k for k in range((3 << 20) - 2, (3 << 20) + 2)] + list(range((5 << 20) - 1, (5 << 20) + 1)) + [None, 7]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    rows = sorted(tuple(r) for r in sequences.chains(df, "k").collect())
    assert [(a, b) for a, b, _ in rows] == [(1, 3), (7, 7), (9, 10), ((1 << 20) - 1, (1 << 20) + 1), ((3 << 20) - 2, (3 << 20) + 1), (1 << 22, 1 << 22), ((5 << 20) - 1, 5 << 20)]


def test_templates_need_all_parts(spark):
    df = spark.createDataFrame([(1, 0, "x"), (1, 1, "y")], "seq int, pos int, w string")
    rows = sequences.template_features(df, [(("w", -1), ("w", 0))]).collect()
    assert [(r["pos"], r["feat"]) for r in rows] == [(1, "w[-1]|w[0]=x|y")]


def test_shapes(spark):
    row = spark.range(1).select(tokens.shape(F.lit("Ab-12,")).alias("s"), tokens.degenerate(F.lit("UULL")).alias("d"), tokens.token_type(F.lit("")).alias("e")).first()
    assert tuple(row) == ("UL-DD.", "UL", "EMPTY")


def test_order_of_rows_does_not_matter(spark):
    df = spark.createDataFrame([(k % 3, k, "ab"[k % 2], k) for k in range(60)], "seq int, pos int, label string, ts int")
    one = sorted(tuple(r) for r in sequences.segments(df).collect())
    assert one == sorted(tuple(r) for r in sequences.segments(df.repartition(7).orderBy(F.rand(3))).collect())


def test_attribute_text(spark, tmp_path):
    feats = [("a:b\\c", 1.0), ("d", 0.25)]
    df = spark.createDataFrame([(1, 0, "x", feats), (1, 1, "y:z", []), (2, 0, "x", feats)], "seq int, pos int, label string, feats array<struct<attr:string,value:double>>")
    attribute_text.write(df, str(tmp_path / "t"))
    rows = attribute_text.read(spark, str(tmp_path / "t")).collect()
    assert sorted((r["label"], [tuple(f) for f in r["feats"]]) for r in rows) == [("x", feats), ("x", feats), ("y:z", [])]
    assert len({(r["grp"], r["block"]) for r in rows}) == 2


def test_column_text(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a N x\nb V y\n\nc N z\n")
    rows = attribute_text.read_columns(spark, str(tmp_path / "c.txt"), ["w", "pos_tag", "y"]).collect()
    assert sorted((r["pos"], r["w"], r["y"]) for r in rows) == [(0, "a", "x"), (0, "c", "z"), (1, "b", "y")]
    (tmp_path / "d.txt").write_text("a\n")
    with pytest.raises(Exception, match="too few fields"):
        attribute_text.read_columns(spark, str(tmp_path / "d.txt"), ["w", "y"]).collect()


def test_toolchain_key(spark):
    row = spark.createDataFrame([("/data/proj/GCC/4.8/O2/x.bin",), ("/data/none",)], "p string")
    key = attribute_text.toolchain_key(F.col("p"), ["GCC", "ICC"])
    assert [r["k"] and tuple(r["k"]) for r in row.select(key.alias("k")).collect()] == [("proj", "GCC", "4.8", "O2"), None]


def test_connected_sets_come_about_once(spark):
    """Against all subsets of random graphs, with sets shuffled no more often than there are sets."""
    import itertools
    import random

    r = random.Random(8)
    for size in (1, 2, 3, 5):
        graphs = {g: [(a, b) for a in range(8) for b in range(8) if a != b and r.random() < 0.14] + [(3, 3)] for g in range(4)}
        nodes = spark.createDataFrame([(g, n) for g in graphs for n in range(8)], "g int, n int")
        edges = spark.createDataFrame([(g, a, b, 1) for g, e in graphs.items() for a, b in e], "g int, src int, dst int, type int")
        want = []
        for g, e in graphs.items():
            for some in itertools.combinations(range(8), size):
                reached, before = {some[0]}, set()
                while reached != before:
                    before = set(reached)
                    reached |= {y for a, b in e for x, y in ((a, b), (b, a)) if x in reached and y in some}
                if len(reached) == size:
                    want.append((g, list(some)))
        got = [(x["g"], x["nodes"]) for x in graphlets.connected_sets(nodes, edges, size).collect()]
        assert sorted(got) == sorted(want)


def test_large_graphs_have_no_sets(spark, monkeypatch):
    monkeypatch.setattr(graphlets, "MOST_NODES", 3)
    nodes = spark.createDataFrame([(1, n) for n in range(3)] + [(2, n) for n in range(4)], "g int, n int")
    edges = spark.createDataFrame([(g, a, a + 1, 1) for g in (1, 2) for a in range(2)], "g int, src int, dst int, type int")
    assert {r["g"] for r in graphlets.connected_sets(nodes, edges, 2).collect()} == {1}


def test_matching_is_that_of_taking_pairs_in_order(spark):
    import hashlib
    import random

    from seqloom.operators import blocks

    r = random.Random(3)
    rows = [(g, r.randrange(30), r.randrange(30), r.randrange(2)) for g in range(3) for _ in range(40)]
    edges = spark.createDataFrame(rows, "g int, src int, dst int, type int")
    got = sorted(tuple(x) for x in blocks.matching(edges, 5).collect())
    pairs = {(g, min(a, b), max(a, b)) for g, a, b, _ in rows if a != b}
    want, used = [], set()
    for g, a, b in sorted(pairs, key=lambda p: (hashlib.md5(f"5|{p[0]}|{p[1]}|{p[2]}".encode()).hexdigest(), p)):
        if not {(g, a), (g, b)} & used:
            want.append((g, a, b))
            used |= {(g, a), (g, b)}
    assert got == sorted(want)
    assert all((g, a) in used or (g, b) in used for g, a, b in pairs)  # no pair can be added
    assert blocks.matching(edges.where("false")).count() == 0
    nodes = spark.createDataFrame([(g, n, 1 << (n % 5)) for g in range(3) for n in range(30)], "g int, n int, color int")
    level, kept = blocks.coarser(nodes, edges, 1, 5)
    assert level.count() == 90 - len(want) and kept.where("src <> dst").count() <= len([x for x in rows if x[1] != x[2]])


def test_last_runs_end_with_their_ranges(spark):
    rows = spark.createDataFrame([("s", p, y, a) for p, (y, a) in enumerate([("x", 10), ("x", 11), ("y", 17)])] + [("t", 0, "x", 5), ("u", 0, "x", 99)], "seq string, pos int, label string, at long")
    ranges = spark.createDataFrame([("s", 0, 16), ("s", 16, 40), ("s", 17, 30), ("s", 18, 99), ("t", 6, 9), ("u", 0, 99)], "seq string, begin long, end long")
    got = {(r["seq"], r["start"]): r["end"] for r in sequences.segments(rows, at="at", ranges=ranges).collect()}
    assert got == {("s", 10): 17, ("s", 17): 30, ("t", 5): 5, ("u", 99): 99}


def test_ngrams_of_a_document_are_counted_in_its_own_row(spark, tmp_path):
    """Rows of one document count together, those without n-grams are left out, and no row per n-gram is grouped."""
    from seqloom.plans.mining import instance_union

    rows = [(1, "a b a b\n\nc"), (1, "a b"), (2, None), (3, " \n"), (None, "x"), (None, "x y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = instance_union(spark, str(tmp_path))
    # document 1: a, b, c and a_b, *_b, b_a, *_a; 7 words and two forms of each of 4 pairs
    assert sorted((r["doc_id"] or 0, r["n_feats"], r["total"]) for r in found.collect()) == [(0, 4, 5), (1, 7, 15)]
    assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()
