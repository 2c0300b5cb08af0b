"""n-grams that go on into successors: their terms are shuffled, not their forms."""

from seqloom.operators import blocks


def test_ngrams_beyond_blocks(spark):
    """With a block of two successors, a cycle, a term that could not be read, and a place that two terms share."""
    terms = spark.createDataFrame([(1, 1, 0, "a"), (1, 1, 1, "b"), (1, 2, 0, "c"), (1, 3, 0, "d"), (1, 3, 0, "e"), (1, 4, 0, None)], "g int, n int, ord int, tok string")
    edges = spark.createDataFrame([(1, 1, 2), (1, 1, 3), (1, 2, 1), (1, 2, 4)], "g int, src int, dst int")
    out = blocks.successor_ngrams(terms, edges, 3)
    raw = {("a", "b", "c"): 1, ("a", "b", "d"): 1, ("a", "b", "e"): 1, ("b", "c", "a"): 1, ("c", "a", "b"): 1}
    want = {}
    for (a, b, c), n in raw.items():
        for feat in (f"{a}_{b}_{c}", f"*_{b}_{c}", f"{a}_*_{c}", f"*_*_{c}"):
            want[feat] = want.get(feat, 0) + n
    assert {r["feat"]: r["cnt"] for r in out.collect()} == want
    dealt = [line for line in out._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("feat#" in line or "_groupingexpression#" in line for line in dealt)
