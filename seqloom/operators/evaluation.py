"""Counts and measures of predicted against reference labels.

A sequence is read up to its first unknown (null) reference label: what stands before counts for
items and labels, the sequence itself does not. Macro averages divide by all labels, seen or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.staging import staged


def known_part(rows: DataFrame) -> DataFrame:
    """``rows`` (seq, pos, pred, ref) with ``known`` false from the first unknown reference on; rows at one place are read together."""
    w = Window.partitionBy("seq").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("known", F.sum(F.col("ref").isNull().cast("int")).over(w) == 0)


def by_label(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``label, n_match, n_model, n_ref, precision, recall, f1`` for every label of ``labels`` (label)."""
    return _rated(known_part(rows).where("known").select("pred", "ref", F.lit(1).alias("n")), labels)


def _rated(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """by_label() of pairs (pred, ref) that occur ``n`` times each."""

    def vote(label: str, r: Column, m: Column, h: Column) -> Column:
        return F.struct(F.col(label).alias("label"), r.alias("r"), m.alias("m"), h.alias("h"))

    none, n = F.lit(0).cast("long"), F.col("n").cast("long")
    hit = F.when(F.col("pred").eqNullSafe(F.col("ref")), n).otherwise(none)
    votes = pairs.select(F.explode(F.array(vote("ref", n, none, hit), vote("pred", none, n, none))).alias("v")).select("v.*")
    sums = votes.groupBy("label").agg(F.sum("h").alias("n_match"), F.sum("m").alias("n_model"), F.sum("r").alias("n_ref"))
    full = labels.join(sums, "label", "left").fillna(0, ["n_match", "n_model", "n_ref"])
    # labels without a reference have no measures
    share = lambda n: F.when(F.col("n_ref") == 0, 0.0).otherwise(F.coalesce(F.col("n_match") / F.nullif(F.col(n), F.lit(0)), F.lit(0.0)))
    rated = full.withColumns({"precision": share("n_model"), "recall": share("n_ref")})
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return rated.withColumn("f1", f1)


def overall(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: item and instance accuracy with their counts, and macro averages over all labels."""
    held = known_part(rows)
    per_seq = held.groupBy("seq").agg(F.count_if("known").alias("items"), F.count_if(F.col("known") & (F.col("pred") == F.col("ref"))).alias("hits"), F.bool_and("known").alias("whole"))
    counts = per_seq.agg(
        F.sum("items").alias("items"), F.sum("hits").alias("item_hits"), F.count_if("whole").alias("instances"), F.count_if(F.col("whole") & (F.col("items") == F.col("hits"))).alias("instance_hits")
    )
    return _measures(counts, by_label(rows, labels))


def overall_of_sequences(seqs: DataFrame, labels: DataFrame) -> DataFrame:
    """As overall(), of one row per sequence with its items in order, arrays ``pred`` and ``ref``; read in one pass, of which pairs of labels and their counts are kept."""
    unknown = F.array_position(F.transform("ref", lambda r: r.isNull()), True).cast("int")
    many = F.when(unknown > 0, unknown - 1).otherwise(F.size("ref"))
    held = seqs.select((unknown == 0).alias("whole"), F.slice(F.arrays_zip("pred", "ref"), F.lit(1), many).alias("known"))
    hits = F.size(F.filter("known", lambda x: x["pred"] == x["ref"]))
    own = held.select("whole", "known", hits.alias("hits"))

    def cell(pred: Column, ref: Column, n: Column, instances: Column, right: Column) -> Column:
        return F.struct(pred.alias("pred"), ref.alias("ref"), n.cast("long").alias("n"), instances.cast("long").alias("instances"), right.cast("long").alias("right"))

    none, no = F.lit(None).cast("string"), F.lit(0)
    whole = cell(none, none, no, F.col("whole"), F.col("whole") & (F.col("hits") == F.size("known")))
    cells = own.select(F.explode(F.concat(F.array(whole), F.transform("known", lambda x: cell(x["pred"], x["ref"], F.lit(1), no, no)))).alias("c")).select("c.*")
    cells = staged(cells.groupBy("pred", "ref").agg(*(F.sum(c).alias(c) for c in ("n", "instances", "right"))), "cells")
    same = F.when(F.col("pred") == F.col("ref"), F.col("n")).otherwise(0)
    counts = cells.agg(F.sum("n").alias("items"), F.sum(same).alias("item_hits"), F.sum("instances").alias("instances"), F.sum("right").alias("instance_hits"))
    return _measures(counts, _rated(cells.where("n > 0").select("pred", "ref", "n"), labels))


def _measures(counts: DataFrame, rated: DataFrame) -> DataFrame:
    macro = rated.agg(*(F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")))
    return counts.crossJoin(macro).withColumns({"item_accuracy": F.col("item_hits") / F.col("items"), "instance_accuracy": F.col("instance_hits") / F.nullif(F.col("instances"), F.lit(0))})


def mismatches(rows: DataFrame) -> DataFrame:
    """``seq, distance``: places at which prediction and reference differ."""
    return rows.groupBy("seq").agg(F.count_if(~F.col("pred").eqNullSafe(F.col("ref"))).alias("distance"))
