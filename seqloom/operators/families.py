"""Feature families as table functions: one function's blocks in, features and their counts out.

A family is a class with ``features()``; ``register()`` makes it a function for SQL, called as
``SELECT * FROM name(TABLE(blocks) PARTITION BY key ORDER BY ..., size => 2)``. The table has the key, by which
it is dealt out, and the terms of a block in each row; a null term could not be read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import chain, groupby, product, repeat

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from seqloom.operators.ngrams import WILDCARD


#: Counts that are handed on at a time.
PART = 1 << 13
#: Partitions of keys that count_features() deals out.
DEALS = 512


def _analyzed(known: tuple[str, ...], rows: AnalyzeArgument, key: AnalyzeArgument | None = None, terms: AnalyzeArgument | None = None, **options: AnalyzeArgument) -> AnalyzeResult:
    """``key, feat, cnt``, the key of the table's own name and type; calls that do not fit are refused."""
    if not rows.isTable:
        raise ValueError("the blocks are a TABLE argument")
    if wrong := sorted(options.keys() - set(known)):
        raise ValueError(f"no options of this family: {', '.join(wrong)}")
    names = [a.value if a is not None else default for a, default in ((key, "key"), (terms, "terms"))]
    fields = {f.name: f.dataType for f in rows.dataType.fields}
    if missing := [n for n in names if n not in fields]:
        raise ValueError(f"the blocks lack the columns {', '.join(missing)}")
    if fields[names[1]].simpleString() != "array<string>":
        raise ValueError(f"{names[1]} is an array of strings")
    return AnalyzeResult(StructType([StructField(names[0], fields[names[0]]), StructField("feat", StringType()), StructField("cnt", LongType())]))


class FeatureFamily:
    """Features of blocks, counted by function. Options reach ``features()`` by name; the columns are ``key`` and ``terms`` unless named otherwise."""

    #: Names of options and what they are without a call's say.
    options: dict = {}

    def __init__(self):
        self.counts: Counter = Counter()
        self.key = None
        self.out: list[tuple] = []

    def __init_subclass__(cls, **kwargs):
        super().__init_subclass__(**kwargs)
        cls.analyze = staticmethod(partial(_analyzed, tuple(cls.options)))

    def eval(self, rows: Row, key: str = "key", terms: str = "terms", **options) -> Iterator[tuple]:
        """A partition has one key, or several in their order; what is counted goes on in large parts, as each costs by itself."""
        if (now := rows[key]) != self.key and (now == now or self.key == self.key):
            self._close()
            self.key = now
        self.counts.update(self.features(rows[terms] or [], **{**self.options, **options}))
        if len(self.out) >= PART:
            yield from self.out
            self.out = []

    def terminate(self) -> Iterator[tuple]:
        self._close()
        yield from self.out

    def _close(self) -> None:
        key = self.key
        self.out += [(key, feat, n) for feat, n in self.counts.items()]
        self.counts.clear()

    def features(self, terms: list[str | None], **options) -> Iterator[str]:
        """Each feature of a block as often as it occurs."""
        raise NotImplementedError


class WildcardNgrams(FeatureFamily):
    """Every ``size`` successive terms, all but the last kept or replaced by the wildcard; a term that could not be read is in none."""

    options = {"size": 2, "wildcard": WILDCARD}

    def features(self, terms: list[str | None], size: int, wildcard: str) -> Iterator[str]:
        masks = [(*kept, True) for kept in product((True, False), repeat=size - 1)]
        runs = [terms] if None not in terms else [[*run] for there, run in groupby(terms, lambda t: t is not None) if there]
        return chain.from_iterable(map("_".join, zip(*(run[k:] if kept else repeat(wildcard) for k, kept in enumerate(mask)))) for run in runs for mask in masks)


class SkipPairs(FeatureFamily):
    """Pairs of terms with ``distance`` others between them, written ``a_*n_b``."""

    options = {"distance": 1}

    def features(self, terms: list[str | None], distance: int) -> Iterator[str]:
        for a, b in zip(terms, terms[distance + 1 :]):
            if a is not None and b is not None:
                yield f"{a}_*{distance}_{b}"


def register(spark: SparkSession, name: str, family: type[FeatureFamily]) -> None:
    """A SQL table function of that name."""
    spark.udtf.register(name, udtf(family, useArrow=True))


def count_features(blocks: DataFrame, name: str, key: str, terms: str, **options) -> DataFrame:
    """``key, feat, cnt`` of a registered family over blocks (key, terms). Keys are dealt out many to a partition: one for each costs more than its counts."""
    spark = blocks.sparkSession
    named = "".join(f", {k} => {v!r}" for k, v in options.items())
    dealt = blocks.select(key, terms, F.pmod(F.xxhash64(key), F.lit(DEALS)).alias("deal" + "_" * sum(c.startswith("deal") for c in (key, terms))))
    return spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{dealt}}) PARTITION BY `{dealt.columns[-1]}` ORDER BY `{key}`, key => '{key}', terms => '{terms}'{named})", dealt=dealt)
