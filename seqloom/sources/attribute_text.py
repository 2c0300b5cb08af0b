"""Sequences as text: one item a line, ``label<TAB>attribute[:value]...``, and an empty line after a sequence.

A colon or backslash in a name is written with a backslash before it; a value that is not written is 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.dictionary import dense_ids
from seqloom.sources.staging import staged


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([:\\])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([:\\])", "$1")


def write(rows: DataFrame, path: str) -> None:
    """Write (seq, pos, label, feats) as text; feats is an array of (attr, value). Items stand in order of pos."""
    shown = F.transform("feats", lambda f: F.concat(escape(f["attr"]), F.when(F.coalesce(f["value"], F.lit(1.0)) == 1.0, "").otherwise(F.concat(F.lit(":"), f["value"].cast("string")))))
    lines = rows.select("seq", "pos", F.concat_ws("\t", escape("label"), F.array_join(shown, "\t")).alias("line"))
    blocks = lines.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"))
    blocks.select(F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("value")).write.option("lineSep", "\n\n").text(path)


def read(spark: SparkSession, path: str, line_end: str = "\n") -> DataFrame:
    """``grp, block, pos, label, feats``: grp is the file, block numbers its sequences (not in order).

    Items without a label and sequences without items are left out; a value that is no number is null.
    Blocks are numbered once, in the shared folder. ``line_end`` is that of the files.
    """
    blocks = spark.read.option("lineSep", 2 * line_end).text(path).select(F.input_file_name().alias("grp"), F.monotonically_increasing_id().alias("block"), F.rtrim(F.replace(F.col("value"), F.lit(line_end), F.lit("\n")), F.lit("\n")).alias("value"))
    blocks = staged(blocks, "blocks")
    lines = blocks.select("grp", "block", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line")).where("line <> ''")
    fields = lines.select("grp", "block", "pos", F.split("line", "\t", -1).alias("f"))
    # the first colon without a backslash parts name and value
    name, value = r"^((?:[^:\\]|\\.)*)", r"^(?:[^:\\]|\\.)*:(.*)$"

    def parsed(f: Column) -> Column:
        told = F.regexp_extract(f, value, 1)
        number = F.when(told.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), told.cast("double"))
        return F.struct(unescape(F.regexp_extract(f, name, 1)).alias("attr"), F.when(f.rlike(value), number).otherwise(1.0).alias("value"))

    attrs = F.filter(F.slice("f", 2, F.greatest(F.size("f") - 1, F.lit(0))), lambda f: f != "")
    return fields.select("grp", "block", "pos", unescape(F.col("f")[0]).alias("label"), F.transform(attrs, parsed).alias("feats")).where("label <> ''")


def file_groups(rows: DataFrame) -> DataFrame:
    """``seq, group``: the number of each sequence's file (grp), from 0 in the order of names."""
    names = dense_ids(rows.select("grp").distinct(), ["grp"], "group", start=0)
    return rows.select("seq", "grp").distinct().join(names, "grp").select("seq", F.col("group").cast("int").alias("group"))


def read_columns(spark: SparkSession, path: str, names: list[str], sep: str = " ") -> DataFrame:
    """Column text: a token a line, fields by ``sep``, an empty line after a sequence. Lines with too few fields raise an error."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).select(F.monotonically_increasing_id().alias("seq"), F.rtrim(F.col("value"), F.lit("\n")).alias("value"))
    lines = blocks.select("seq", F.posexplode(F.split("value", "\n", -1)).alias("pos", "line")).where("line <> ''")
    fields = lines.select("seq", "pos", F.split("line", sep, -1).alias("f"))
    checked = F.when(F.size("f") >= len(names), F.col("f")).otherwise(F.raise_error(F.lit("too few fields")).cast("array<string>"))
    return fields.select("seq", "pos", checked.alias("f")).select("seq", "pos", *(F.col("f")[k].alias(n) for k, n in enumerate(names)))


def toolchain_key(path: Column, known: list[str]) -> Column:
    """Struct (project, compiler, version, opt) around the first known part of a path; null without one."""
    parts = F.split(path, "/", -1)
    at = F.array_position(F.transform(parts, lambda p: p.isin(*known)), True).cast("int")
    return F.when(at > 1, F.struct(F.element_at(parts, at - 1).alias("project"), F.element_at(parts, at).alias("compiler"), F.try_element_at(parts, at + 1).alias("version"), F.try_element_at(parts, at + 2).alias("opt")))
