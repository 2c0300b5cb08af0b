"""The steps from terms to tags as stages of a ``pyspark.ml.Pipeline``: n-grams, selection and scale, templates; the chain is the last.

Rows are items ``seq, pos, label`` with further columns; a stage adds a column and keeps the others. The
fitted pipeline is saved and loaded as a whole.
"""

from __future__ import annotations

import re

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.semirings import let
from seqloom.operators import dictionary, sequences
from seqloom.operators.ngrams import WILDCARD, array_ngrams
from seqloom.sources.staging import staged

FEATS = "array<struct<attr:string,value:double>>"


class TablesWriter(MLWriter):
    """Parameters as metadata, and what the model writes by itself with ``write_tables(path)``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.write_tables(path)


class TablesReader(MLReader):
    """Models of a class that makes them with ``read_tables(spark, path)``."""

    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> Model:
        held = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = self.kind.read_tables(self.sparkSession, path)
        model._resetUid(held["uid"])
        DefaultParamsReader.getAndSetParams(model, held)
        return model


class InTables(MLWritable, MLReadable):
    """A model that is saved as tables beside its parameters."""

    def write(self) -> TablesWriter:
        return TablesWriter(self)

    @classmethod
    def read(cls) -> TablesReader:
        return TablesReader(cls)

    def save(self, path: str) -> None:
        """Write, in place of what is there."""
        self.write().overwrite().save(path)


class _Columns(Params):
    inputCol = Param(Params._dummy(), "inputCol", "column that is read", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "column that is added", TypeConverters.toString)


class WildcardTerms(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """The wildcard n-grams of an array of terms, of all sizes, in one array."""

    sizes = Param(Params._dummy(), "sizes", "terms of a gram", TypeConverters.toListInt)
    wildcard = Param(Params._dummy(), "wildcard", "what stands for any term", TypeConverters.toString)

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(inputCol="words", outputCol="grams", sizes=[1, 2], wildcard=WILDCARD)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        grams = [F.coalesce(array_ngrams(get(self.inputCol), n, get(self.wildcard)), F.array().cast("array<string>")) for n in get(self.sizes)]
        return dataset.withColumn(get(self.outputCol), F.concat(*grams))


class _Selection(_Columns):
    labelCol = Param(Params._dummy(), "labelCol", "label that features tell of", TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "features kept; they are broadcast", TypeConverters.toInt)


class InformationSelector(Estimator, _Selection, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the features of the greatest mutual information with the label, and their greatest counts. Rows without a label are not learnt from."""

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(inputCol="grams", outputCol="feats", labelCol="label", keep=1000)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> InformationSelectorModel:
        get = self.getOrDefault
        rows = dataset.select(F.col(get(self.labelCol)).alias("label"), F.col(get(self.inputCol)).alias("words")).where("label is not null")
        rows = staged(rows, "selection")
        top = staged(dictionary.top_features(dictionary.mutual_information(rows, "label"), get(self.keep)), "top")
        names = top.agg(F.collect_list("tok").alias("names"))  # they are broadcast
        own = rows.crossJoin(F.broadcast(names)).select("words", F.array_intersect("words", "names").alias("own")).where("size(own) > 0")
        counts = own.select(F.explode(F.transform("own", lambda f: F.struct(f.alias("feat"), F.size(F.filter("words", lambda g: g == f)).cast("long").alias("cnt")))).alias("c"))
        scales = dictionary.scales(counts.select("c.*"))
        selected = top.withColumnRenamed("tok", "feat").join(scales, "feat").withColumn("scale", F.col("scale").cast("double"))
        return self._copyValues(InformationSelectorModel(staged(selected.select("feat", "mi", "scale"), "selected")))


class InformationSelectorModel(Model, _Selection, InTables):
    """Counts of the selected features over their greatest, as an array of (attr, value) in order of names; ``selected`` is (feat, mi, scale)."""

    def __init__(self, selected: DataFrame):
        super().__init__()
        self.selected = selected

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        grams = F.coalesce(F.col(get(self.inputCol)), F.array().cast("array<string>"))
        held = self.selected.select("feat", "scale").agg(F.array_sort(F.collect_list(F.struct("feat", "scale"))).alias("__s"))  # they are broadcast
        names, scales = F.col("__s")["feat"], F.col("__s")["scale"]

        def value(feat: Column, hits: Column) -> Column:
            many = F.size(F.filter(hits, lambda g: g == feat))
            return F.struct(feat.alias("attr"), (many / F.get(scales, F.array_position(names, feat).cast("int") - 1)).alias("value"))

        # the selected ones of an item, all their places, then a count of each
        there = let(F.array_sort(F.array_intersect(grams, names)), lambda own: let(F.filter(grams, lambda g: F.array_contains(own, g)), lambda hits: F.transform(own, lambda f: value(f, hits))))
        return dataset.crossJoin(F.broadcast(held)).withColumn(get(self.outputCol), F.when(F.size(F.array_intersect(grams, names)) > 0, there).otherwise(F.array().cast(FEATS))).drop("__s")

    def write_tables(self, path: str) -> None:
        self.selected.write.parquet(f"{path}/selected")

    @classmethod
    def read_tables(cls, spark: SparkSession, path: str) -> InformationSelectorModel:
        return cls(spark.read.parquet(f"{path}/selected"))


class SequenceTemplates(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the features of templates, written ``field[offset]|field[offset]``, of value 1, behind those of ``inputCol``."""

    templates = Param(Params._dummy(), "templates", "templates, each a text", TypeConverters.toListString)

    @keyword_only
    def __init__(self, **kwargs):
        super().__init__()
        self._setDefault(inputCol="feats", outputCol="feats", templates=[])
        self._set(**self._input_kwargs)

    @staticmethod
    def parsed(template: str) -> sequences.Template:
        parts = [re.fullmatch(r"(\w+)\[(-?\d+)\]", p) for p in template.split("|")]
        if not all(parts):
            raise ValueError(f"no template: {template}")
        return tuple((m[1], int(m[2])) for m in parts)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        made = sequences.template_texts(dataset, [*map(self.parsed, get(self.templates))], "__f")
        feats = F.transform(F.array_sort("__f"), lambda f: F.struct(f.alias("attr"), F.lit(1.0).alias("value")))
        return made.withColumn(get(self.outputCol), F.concat(F.coalesce(get(self.inputCol), F.array().cast(FEATS)), feats)).drop("__f")
