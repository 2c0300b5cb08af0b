"""Feature families called from SQL."""

import pytest
from pyspark.sql import functions as F

from seqloom.operators import families, ngrams

BLOCKS = "fun long, line int, words array<string>"


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [(1, 0, ["a", "b", "a", "b"]), (1, 1, ["a", None, "c", "d"]), (1, 2, []), (2, 0, ["x"]), (3, 0, None), (None, 0, ["n", "m"]), (4, 0, ["it's", "q"])]
    return spark.createDataFrame(rows, BLOCKS).repartition(3)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 3])
def test_ngrams_by_sql_are_those_of_windows(spark, blocks, size):
    families.register(spark, "wildcard_ngrams", families.WildcardNgrams)
    terms = blocks.select("fun", "line", F.posexplode("words").alias("ord", "tok"))
    want = ngrams.ngrams(terms, size, ["fun", "line"], "ord").groupBy("fun", "feat").agg(F.count(F.lit(1)).alias("cnt"))
    assert rows_of(families.count_features(blocks, "wildcard_ngrams", "fun", "words", size=size)) == rows_of(want)


def test_a_family_of_ones_own(spark, blocks):
    class Lengths(families.FeatureFamily):
        options = {"least": 0}

        def features(self, terms, least):
            yield from (f"len{len(t)}" for t in terms if t is not None and len(t) >= least)

    families.register(spark, "lengths", Lengths)
    blocks.createOrReplaceTempView("held_blocks")
    got = spark.sql("SELECT * FROM lengths(TABLE(held_blocks) PARTITION BY fun ORDER BY line, key => 'fun', terms => 'words', least => 2)")
    assert got.columns == ["fun", "feat", "cnt"] and rows_of(got) == [(4, "len4", 1)]
    families.register(spark, "skip_pairs", families.SkipPairs)
    assert rows_of(families.count_features(blocks, "skip_pairs", "fun", "words", distance=2)) == [(1, "a_*2_b", 1), (1, "a_*2_d", 1)]


def test_calls_are_checked(spark, blocks):
    families.register(spark, "wildcard_ngrams", families.WildcardNgrams)
    blocks.createOrReplaceTempView("held_blocks")
    for call, told in (("key => 'fun', terms => 'line'", "array of strings"), ("key => 'none', terms => 'words'", "lack"), ("key => 'fun', terms => 'words', big => 1", "no options")):
        with pytest.raises(Exception, match=told):
            spark.sql(f"SELECT * FROM wildcard_ngrams(TABLE(held_blocks) PARTITION BY fun, {call})").collect()


def test_many_keys_share_a_partition(spark, monkeypatch):
    """One call counts several keys, hands counts on in parts, and passes over what holds a null."""
    monkeypatch.setattr(families, "PART", 3)
    family, got = families.WildcardNgrams(), []
    for key, terms in [(None, ["n", "m"]), (1, ["a", "b", None, "a", "b"]), (1, ["a", "b"]), (2, None), (3, ["c", "d"])]:
        got.append([*family.eval({"key": key, "terms": terms})])
    got.append([*family.terminate()])
    assert [len(g) for g in got] == [0, 0, 0, 4, 0, 2]
    assert sorted((x for g in got for x in g), key=repr) == sorted([(None, "n_m", 1), (None, "*_m", 1), (1, "a_b", 3), (1, "*_b", 3), (3, "c_d", 1), (3, "*_d", 1)], key=repr)
