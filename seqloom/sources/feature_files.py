"""The text files of feature mining: file lists, feature lists, instances, sequence data with address maps, selections.

Folders of a binary's files are partitions of one table (column ``bin``); reading passes over files
that are gone. Files are written in ranges, those of one large binary by several tasks: the parts of a
folder in the order of their names are the file, and lines are in order within and over the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from seqloom.operators.dictionary import running_sums


def sizes(text: str) -> list[int]:
    """``1:2:3`` as numbers; no text, no sizes."""
    return [int(n) for n in text.split(":")] if text else []


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/", -1), -1)


def prefixed_name(key: Column, path: Column) -> Column:
    """Project, compiler, version and options (of toolchain_key()) and the file's name, joined by ``_``."""
    return F.concat_ws("_", key["project"], key["compiler"], key["version"], key["opt"], base_name(path))


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """``path``: one row per line that is not empty."""
    return spark.read.text(path).select(F.rtrim("value").alias("path")).where("path <> ''")


def three_places(x: Column) -> Column:
    """Number with three decimals. Ties of the decimal text go up, where C rounds the binary value: compare numbers, not texts."""
    return F.format_string("%.3f", x.cast("double"))


# -- lists: "number text" a line


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("ignoreMissingFiles", "true").text(path)


def _write_by_bin(rows: DataFrame, order: list[str], path: str) -> None:
    """``value`` lines of each ``bin`` in order; no binary is one task's alone."""
    _named(rows).orderBy("bin", *order).select("bin", "value").write.partitionBy("bin").text(path)


def _named(rows: DataFrame) -> DataFrame:
    """A ``bin`` that is never null keeps the writer from sorting by it once more."""
    return rows.withColumn("bin", F.coalesce(F.col("bin").cast("string"), F.lit("")))


def write_numbered(rows: DataFrame, path: str, number: str, text: str) -> None:
    """``number text`` lines in order of the number over all parts (label and feature lists)."""
    rows.orderBy(number).select(F.concat_ws(" ", F.col(number).cast("string"), F.col(text)).alias("value")).write.text(path)


def read_numbered(spark: SparkSession, path: str, number: str, text: str) -> DataFrame:
    at = F.instr("value", " ")
    held = _lines(spark, path).where(at > 0)
    return held.select(F.substring(F.col("value"), F.lit(1), at - 1).cast("long").alias(number), F.substring(F.col("value"), at + 1, F.length("value")).alias(text), *[c for c in held.columns if c != "value"])


def local_features(counts: DataFrame) -> DataFrame:
    """``bin, idx, feat``: the features of each binary (of counts bin, addr, feat, cnt), numbered from 1 by text."""
    feats = counts.select("bin", "feat").distinct()
    return running_sums(feats, ["bin"], ["feat"], {"idx": F.lit(1)}).select("bin", F.col("idx").cast("int").alias("idx"), "feat")


def write_features(features: DataFrame, path: str) -> None:
    """A list per binary, sorted by index."""
    _write_by_bin(features.select("bin", "idx", F.concat_ws(" ", F.col("idx").cast("string"), "feat").alias("value")), ["idx"], path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """``bin, idx, feat``."""
    return read_numbered(spark, path, "idx", "feat").select(F.col("bin").cast("string").alias("bin"), F.col("idx").cast("int").alias("idx"), "feat")


# -- instances: "address index:count ..." a line, per binary


def write_instances(counts: DataFrame, features: DataFrame, path: str) -> None:
    """Lines of hex addresses with ``index:count`` by index, per binary in order of addresses.

    Counts are dealt out in ranges once, in which lines are made and sorted; so lines are made once, and don't travel.
    """
    whole = isinstance(counts.schema["cnt"].dataType, (ByteType, ShortType, IntegerType, LongType))
    coded = _named(counts.join(features, ["bin", "feat"])).select("bin", "addr", "idx", "cnt").repartitionByRange("bin", "addr")
    rows = coded.groupBy("bin", "addr").agg(F.array_sort(F.collect_list(F.struct("idx", "cnt"))).alias("f"))
    shown = F.transform("f", lambda f: F.concat(f["idx"].cast("string"), F.lit(":"), F.concat(f["cnt"].cast("string"), F.lit(".000")) if whole else three_places(f["cnt"])))
    lines = rows.select("bin", "addr", F.concat_ws(" ", F.lower(F.hex("addr")), F.array_join(shown, " ")).alias("value"))
    lines.sortWithinPartitions("bin", "addr").select("bin", "value").write.partitionBy("bin").text(path)


def read_instances(spark: SparkSession, path: str, features: DataFrame) -> DataFrame:
    """``bin, addr, feat, cnt``: indexes become texts by the binary's own list; counts of zero are left out."""
    parts = _lines(spark, path).select(F.col("bin").cast("string").alias("bin"), F.split("value", " ").alias("p"))
    pairs = parts.select("bin", F.conv(F.col("p")[0], 16, 10).cast("long").alias("addr"), F.explode(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0)))).alias("pair"))
    cut = pairs.select("bin", "addr", F.split_part("pair", F.lit(":"), F.lit(1)).cast("int").alias("idx"), F.split_part("pair", F.lit(":"), F.lit(2)).cast("double").alias("cnt"))
    return cut.where("cnt <> 0").join(features, ["bin", "idx"]).select("bin", "addr", "feat", "cnt")


# -- sequence data: "label<TAB>id:count..." a line, an empty line where a chain ends, and the addresses beside


def chain_lines(addresses: DataFrame, instances: DataFrame) -> DataFrame:
    """``bin, chain, pos, addr, label, feats``: the addresses (bin, addr) in order that have an instance (bin, addr, label,
    feats); one without ends the chain."""
    met = addresses.join(instances, ["bin", "addr"], "left")
    gap = F.col("feats").isNull()
    held = running_sums(met, ["bin"], ["addr"], {"chain": gap.cast("int"), "nth": (~gap).cast("int")}).where("feats is not null")
    return held.select("bin", "chain", (F.col("nth") - 1).alias("pos"), "addr", "label", "feats")


def write_data(chains: DataFrame, data_path: str, map_path: str) -> None:
    """The data lines of each binary, and its map: the binary's name, then a hex address per line."""
    shown = F.transform(F.array_sort("feats"), lambda f: F.concat(f["id"].cast("string"), F.lit(":"), f["value"].cast("string")))
    line = F.concat_ws("\t", F.col("label").cast("string"), F.array_join(shown, "\t"))
    later = chains.select(F.col("bin").alias("b"), (F.col("pos") - 1).alias("p"), F.col("chain").alias("next"))
    ended = chains.join(later, F.col("bin").eqNullSafe(F.col("b")) & (F.col("pos") == F.col("p")), "left")
    lines = F.when(F.col("next") != F.col("chain"), F.array(line, F.lit(""))).otherwise(F.array(line))
    _write_by_bin(ended.select("bin", "pos", F.posexplode(lines).alias("nth", "value")), ["pos", "nth"], data_path)
    names = chains.select("bin").distinct().select("bin", F.lit(-1).alias("pos"), F.col("bin").cast("string").alias("value"))
    _write_by_bin(names.unionByName(chains.select("bin", "pos", F.lower(F.hex("addr")).alias("value"))), ["pos"], map_path)


def read_data(spark: SparkSession, path: str) -> DataFrame:
    """``bin, label, feats`` of every line with a label; shorter lines are left out."""
    fields = _lines(spark, path).where("length(value) >= 2").select(F.col("bin").cast("string").alias("bin"), F.split("value", "\t").alias("f"))
    feats = F.transform(F.filter(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda f: f != ""), lambda f: F.struct(F.split_part(f, F.lit(":"), F.lit(1)).cast("int").alias("id"), F.split_part(f, F.lit(":"), F.lit(2)).cast("double").alias("value")))
    return fields.select("bin", F.col("f")[0].alias("label"), feats.alias("feats"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``bin, addr``: all lines but the binary's name."""
    held = _lines(spark, path).select(F.col("bin").cast("string").alias("bin"), "value")
    return held.where("value <> bin").select("bin", F.conv("value", 16, 10).cast("long").alias("addr"))


# -- selections: "id text scale" a line


def write_selected(rows: DataFrame, path: str) -> None:
    """``id feat scale`` by rank, the scale with three decimals; a selection is as small as its parameter says."""
    rows.orderBy("rank").coalesce(1).select(F.concat_ws(" ", F.col("feat_id").cast("string"), "feat", three_places(F.col("scale"))).alias("value")).write.text(path)


def read_selected(spark: SparkSession, path: str) -> DataFrame:
    """``feat_id, feat, scale``."""
    p = F.split("value", " ")
    return _lines(spark, path).select(p[0].cast("long").alias("feat_id"), p[1].alias("feat"), p[2].cast("double").alias("scale"))
