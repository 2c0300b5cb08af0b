"""Texts around tagging: weighted lines, template files, tagged output and the report of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.semirings import let
from seqloom.functions.tokens import escape_attribute


def weighted(field: Column) -> Column:
    """Struct (attr, value) of ``name[:weight]``, parted at the last colon; a weight that is not written is 1."""
    cut = field.rlike(":[^:]*$")
    return F.struct(
        F.when(cut, F.regexp_extract(field, "^(.*):[^:]*$", 1)).otherwise(field).alias("attr"),
        F.when(cut, F.regexp_extract(field, ":([^:]*)$", 1).cast("double")).otherwise(1.0).alias("value"),
    )


def parse_line(line: Column) -> Column:
    """Struct (label, feats) of ``label<TAB>name[:weight]...``; null for an empty line, which ends a sequence."""
    fields = F.split(line, "\t", -1)
    feats = F.transform(F.slice(fields, 2, F.greatest(F.size(fields) - 1, F.lit(0))), weighted)
    return F.when(line != "", F.struct(fields[0].alias("label"), feats.alias("feats")))


def write_columns(rows: DataFrame, path: str) -> None:
    """Write (seq, pos, label, feats) in the form of column features: ``label<TAB>name[:value]...``, an empty line after a sequence.

    Colons of names are written as text (escape_attribute()); a null value is left out, others have six decimals.
    """
    shown = F.transform("feats", lambda f: F.concat(escape_attribute(f["attr"]), F.when(f["value"].isNull(), "").otherwise(F.format_string(":%f", f["value"]))))
    lines = rows.select("seq", "pos", F.array_join(F.concat(F.array("label"), F.coalesce(shown, F.array().cast("array<string>"))), "\t").alias("line"))
    blocks = lines.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("b"))
    blocks.select(F.array_join(F.transform("b", lambda x: x["line"]), "\n").alias("value")).write.option("lineSep", "\n\n").text(path)


def read_templates(lines: list[str]) -> list[str]:
    """The ``U`` lines of a template file, ``:`` written as ``=``; ``#`` lines and a bare ``B`` are passed over, other ``B`` lines are an error."""
    out = []
    for line in map(str.strip, lines):
        if line.startswith("U"):
            out.append(line.replace(":", "="))
        elif line.startswith("B") and line != "B":
            raise ValueError(f"templates over two labels are not supported: {line}")
    return out


def tagged_lines(tagged: DataFrame, probability: bool = False, marginal: bool = False, reference: bool = False) -> DataFrame:
    """``seq, value``: one text per sequence of (seq, pos, label, pred, marginal, probability): a line per item and an empty one.

    ``probability`` puts the sequence's in front, ``marginal`` the item's behind the label, ``reference`` the given label before it.
    """
    line = F.col("pred")
    if marginal:
        line = F.concat(line, F.format_string(":%f", "marginal"))
    if reference:
        line = F.concat(F.coalesce("label", F.lit("")), F.lit("\t"), line)
    rows = tagged.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("b"), F.first("probability").alias("p"))
    body = F.concat(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit("\n"))
    return rows.select("seq", (F.concat(F.format_string("@probability\t%f\n", "p"), body) if probability else body).alias("value"))


def write_tagged(lines: DataFrame, path: str) -> None:
    """tagged_lines() as text; sequences are parted by empty lines."""
    lines.select("value").write.option("lineSep", "\n").text(path)


def instance_lines(rows: DataFrame) -> DataFrame:
    """``seq, value``: items as they were read (label, then name:value fields), as a check of input."""
    shown = F.transform("feats", lambda f: F.concat(f["attr"], F.format_string(":%f", f["value"])))
    lines = rows.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws("\t", "label", F.array_join(shown, "\t")).alias("line")))).alias("b"))
    return lines.select("seq", F.concat(F.array_join(F.transform("b", lambda x: x["line"]), "\n"), F.lit("\n")).alias("value"))


def report_lines(report: DataFrame, labels: list[str]) -> DataFrame:
    """``seq, value``: the report of segments (seq, start, end and a column per label) as text, starts and ends in hex, with the
    columns of the labels that occur."""
    cells = F.array(*(F.col(x).cast("string") for x in labels))
    there = F.array(*(F.when(F.max(F.col(x) > 0), k) for k, x in enumerate(labels)))
    held = report.groupBy("seq").agg(there.alias("there"), F.collect_list(F.struct("start", "end", cells.alias("cells"))).alias("rows"))

    def line(row: Column, at: Column) -> Column:
        text = F.concat(F.lit("[0x"), F.lower(F.hex(row["start"])), F.lit(" - 0x"), F.lower(F.hex(row["end"])), F.lit("), "), F.array_join(F.transform(at, lambda k: F.get(row["cells"], k)), ", "))
        return F.struct(row["start"].alias("start"), text.alias("line"))

    def whole(at: Column) -> Column:
        head = F.concat(F.lit("Address range, "), F.array_join(F.transform(at, lambda k: F.get(F.array(*map(F.lit, labels)), k)), ", "))
        return F.concat_ws("\n", head, F.array_join(F.transform(F.array_sort(F.transform("rows", lambda row: line(row, at))), lambda x: x["line"]), "\n"))

    return held.select("seq", let(F.array_compact("there"), whole).alias("value"))
