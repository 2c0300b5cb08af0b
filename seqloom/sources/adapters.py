"""Sequences, blocks and graphs read from plain tables.

A document stands for a function, its lines for basic blocks and its words for instructions; a user's
events in time stand for a program's addresses, the event type for a label.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts of more bytes are not worked on in one row.
LONGEST = 1 << 22
#: Up to so many ids are broadcast.
BROADCAST_IDS = 1 << 20


def by_row(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that may be worked on row by row, and the others: those that share their doc_id, and those with very long texts."""
    shared = documents.groupBy(F.col("doc_id").alias("id_")).agg(F.count(F.lit(1)).alias("n_")).where("n_ > 1").withColumn("shared_", F.lit(True)).drop("n_")
    many, long = shared.count(), F.coalesce(F.octet_length("text") > LONGEST, F.lit(False))
    if not many:
        return documents.where(~long), documents.where(long)
    told = documents.join(F.broadcast(shared) if many <= BROADCAST_IDS else shared, F.col("doc_id").eqNullSafe(F.col("id_")), "left")
    other = F.col("shared_").isNotNull() | long
    return told.where(~other).select(*documents.columns), told.where(other).select(*documents.columns)


def token_lines(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, line, words`` (and further columns): words are parted by single spaces, empty ones left out.

    Null texts have no lines. Lines stay arrays, so that n-grams need no shuffle.
    """
    lines = documents.select("doc_id", *more, F.posexplode(F.split("text", "\n", -1)).alias("line", "body"))
    return lines.select("doc_id", *more, "line", F.filter(F.split("body", " ", -1), lambda w: w != "").alias("words"))


def tokens(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, line, ord, tok``: one row per word."""
    return token_lines(documents, *more).select("doc_id", *more, "line", F.posexplode("words").alias("ord", "tok"))


def document_tokens(documents: DataFrame, *more: str) -> DataFrame:
    """``doc_id, words``: all words of a document in one array."""
    words = F.filter(F.split(F.translate("text", "\n", " "), " ", -1), lambda w: w != "")
    return documents.select("doc_id", *more, words.alias("words"))


def event_sequences(events: DataFrame) -> DataFrame:
    """``seq, pos, label, value, ts, event_id``: each user's events in time, numbered from 0."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(F.col("user_id").alias("seq"), (F.row_number().over(order) - 1).alias("pos"), F.col("event_type").alias("label"), "value", "ts", "event_id")


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """``seq, pos, label, text``: the turns of conversations in order, numbered from 0."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return conversations.select(F.col("conv_id").alias("seq"), (F.row_number().over(order) - 1).alias("pos"), F.col("role").alias("label"), "text")


def event_edges(sequences: DataFrame) -> DataFrame:
    """``g, src, dst, type``: distinct steps between successive labels of a sequence; type 1 where the value rises, else 2."""
    order = Window.partitionBy("seq").orderBy("pos")
    steps = sequences.select(F.col("seq").alias("g"), F.lag("label").over(order).alias("src"), F.col("label").alias("dst"), F.when(F.col("value") > F.lag("value").over(order), 1).otherwise(2).alias("type"))
    return steps.where("src is not null").distinct()


def event_nodes(sequences: DataFrame) -> DataFrame:
    """``g, n, color``: labels of a sequence; the color has a bit for every quarter of the day with such an event."""
    bit = F.expr("shiftleft(1, cast(floor(hour(ts) / 6) as int))")
    return sequences.groupBy(F.col("seq").alias("g"), F.col("label").alias("n")).agg(F.bit_or(bit).alias("color"))
