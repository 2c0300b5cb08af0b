"""Dictionaries, presence counts, mutual information and scaled instances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.ngrams import text_words
from seqloom.sources.adapters import by_row, tokens
from seqloom.sources.staging import staged

#: Joint probabilities below this count as none.
LEAST = 1e-7


def dense_ids(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """Number rows by ``order``, which must tell all rows apart, without sorting all of them in one task.

    Rows are sorted in sampled ranges and written, so that places in a range and the sizes of the
    ranges before come from one and the same run.
    """
    mark, place = (n + "_" * sum(c.startswith(n) for c in df.columns) for n in ("range", "place"))
    held = df.orderBy(*order).withColumns({mark: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    held = staged(held, "ranged")
    sizes = held.groupBy(mark).agg(F.count(F.lit(1)).alias("n"))
    # one row per range
    before = sizes.select(F.col(mark).alias("b"), F.coalesce(F.sum("n").over(Window.orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    out = held.join(F.broadcast(before), held[mark] == before["b"])
    return out.withColumn(name, (F.col(place) + F.col("before") + start).cast("long")).drop(mark, place, "b", "before")


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``df`` with running sums (name and what is summed) within ``group``, up to each row in ``order``, which must tell a
    group's rows apart.

    Groups are cut into sampled ranges, so that one of any size is dealt over tasks; the sums of a group's
    ranges before are added.
    """
    mark = "range" + "_" * sum(c.startswith("range") for c in [*df.columns, *sums])
    held = staged(df.withColumns(sums).repartitionByRange(*group, *order).withColumn(mark, F.spark_partition_id()), "summed")
    whole = held.groupBy(mark, *group).agg(*(F.sum(n).alias(n) for n in sums))
    earlier = Window.partitionBy(*group).orderBy(mark).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    keys = [f"{mark}{k}" for k in range(len(group) + 1)]
    before = whole.select(F.col(mark).alias(keys[0]), *(F.col(g).alias(k) for g, k in zip(group, keys[1:])), *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{mark}{n}") for n in sums))
    on = [F.col(mark) == F.col(keys[0]), *(F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys[1:]))]
    here = Window.partitionBy(mark, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = held.join(before, on).withColumns({n: F.sum(n).over(here) + F.col(f"{mark}{n}") for n in sums})
    return added.drop(mark, *keys, *(f"{mark}{n}" for n in sums))


def first_places(documents: DataFrame) -> DataFrame:
    """``doc_id, at, tok``: each token of a document, and a number that grows with its first place in it."""
    alone, others = by_row(documents.select("doc_id", "text"))
    firsts = alone.repartition("doc_id").select("doc_id", F.posexplode(F.array_distinct(text_words("text"))).alias("at", "tok")).select("doc_id", F.col("at").cast("long").alias("at"), "tok")
    at = F.col("line").cast("long") * (1 << 32) + F.col("ord")
    return firsts.unionByName(tokens(others).groupBy("doc_id", "tok").agg(F.min(at).alias("at")))


def first_seen_vocab(documents: DataFrame) -> DataFrame:
    """``tok, feat_id``: ids from 1 by first appearance (document, line, place, token).

    First places are found in a document's own row, then by token in sums of plain longs; the second is
    the only shuffle.
    """
    first = first_places(documents).groupBy("tok").agg(F.coalesce(F.min_by("at", "doc_id"), F.min("at")).alias("at"), F.min("doc_id").alias("doc_id"))
    return dense_ids(first, ["doc_id", "at", "tok"], "feat_id").select("tok", "feat_id")


def presence(document_words: DataFrame, label: str) -> DataFrame:
    """``tok, label, n``: documents per token and label. A document counts once for a token."""
    once = document_words.select(F.col(label).alias("label"), F.explode(F.array_distinct("words")).alias("tok"))
    return once.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("n"))


def presence_counts(document_words: DataFrame, label: str) -> DataFrame:
    """``tok, label, n`` for (token), (token, label), (label) and all documents; null stands for all."""
    joint = presence(document_words, label)
    sets = joint.groupingSets([["tok"], ["tok", "label"]], "tok", "label").agg(F.sum("n").alias("n"))
    docs = document_words.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    docs = docs.groupingSets([["label"], []], "label").agg(F.sum("n").alias("n"))
    return sets.select("tok", "label", "n").unionByName(docs.select(F.lit(None).cast("string").alias("tok"), "label", "n"))


def mutual_information(document_words: DataFrame, label: str) -> DataFrame:
    """``tok, mi``: mutual information (natural log) of a token's presence and the label.

    Labels without the token share one closed form, so no grid of tokens and labels is made.
    """
    totals = document_words.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("docs"))
    all_docs = document_words.agg(F.count(F.lit(1)).alias("all_docs"))
    chances = totals.crossJoin(all_docs).select("label", "all_docs", (F.col("docs") / F.col("all_docs")).alias("pl"))
    joint = presence(document_words, label)
    per_token = joint.groupBy("tok").agg(F.sum("n").alias("docs_f"))
    rows = joint.join(per_token, "tok").join(chances, "label").select("tok", "pl", (F.col("n") / F.col("all_docs")).alias("pj"), (F.col("docs_f") / F.col("all_docs")).alias("pf"))

    def term(xy: Column, y: Column) -> Column:
        return F.when(F.abs(xy) < LEAST, 0.0).otherwise(xy * F.ln(xy / F.col("pl") / y))

    sums = rows.groupBy("tok").agg(
        F.sum(term(F.col("pj"), F.col("pf")) + term(F.col("pl") - F.col("pj"), 1 - F.col("pf"))).alias("seen"),
        F.sum("pl").alias("share"),
        F.max("pf").alias("pf"),
    )
    unseen = F.when(1 - F.col("share") < LEAST, 0.0).otherwise((1 - F.col("share")) * F.ln(1 / (1 - F.col("pf"))))
    return sums.select("tok", (F.col("seen") + unseen).alias("mi"))


def top_features(ranked: DataFrame, keep: int) -> DataFrame:
    """The first ``keep`` by mutual information, ties to the greater text; rounded, so that sums in any order rank alike."""
    return ranked.select("tok", F.round("mi", 6).alias("mi")).orderBy(F.desc("mi"), F.desc("tok")).limit(keep)


def scales(counts: DataFrame) -> DataFrame:
    """``feat, scale``: the greatest count of a feature."""
    return counts.groupBy("feat").agg(F.max("cnt").alias("scale"))


def scaled(counts: DataFrame, selected: DataFrame) -> DataFrame:
    """``doc_id, feat, value``: counts of the selected features (feat, scale) over their scale; near-zero counts go."""
    return counts.join(selected, "feat").where("abs(cnt) >= 1e-5").select("doc_id", "feat", (F.col("cnt") / F.col("scale")).alias("value"))


def instances(scaled_counts: DataFrame, ids: DataFrame) -> DataFrame:
    """``doc_id, feats``: sparse instances as sorted arrays of (feat_id, value)."""
    rows = scaled_counts.join(ids, "feat")
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("feat_id", "value"))).alias("feats"))
