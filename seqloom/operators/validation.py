"""Folds, hold-out evaluation while training, and cross validation of sequence models."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.operators import evaluation
from seqloom.operators.crf import LinearChainCRF, LinearChainCRFModel
from seqloom.operators.crf_layout import pack, sequences_of
from seqloom.operators.dictionary import dense_ids
from seqloom.sources.staging import staged


def round_robin(sequences: DataFrame, folds: int, key: str = "seq", seed: int = 0) -> DataFrame:
    """``key, fold``: sequences in the order of a seeded hash, dealt to the folds in turn, so that folds are of one size."""
    ids = sequences.select(key).distinct().withColumn("h", F.xxhash64(key, F.lit(seed)))
    return dense_ids(ids, ["h", key], "nth", start=0).select(key, (F.col("nth") % folds).cast("int").alias("fold"))


def split_by_group(rows: DataFrame, group: str, held: int) -> tuple[DataFrame, DataFrame]:
    """Rows to learn from and rows held out: those of other groups, and those of the group."""
    return rows.where(F.col(group) != held), rows.where(F.col(group) == held)


def evaluate(model: LinearChainCRFModel, rows: DataFrame) -> DataFrame:
    """One row of evaluation.overall() of the model's tags of (seq, pos, label, feats)."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in model.labels], "label string")
    return evaluation.overall_of_sequences(model.beside(rows), labels)


def with_holdout(trainer: LinearChainCRF, rows: DataFrame, held: DataFrame) -> tuple[LinearChainCRFModel, DataFrame]:
    """The model of ``rows``, and its evaluation on ``held`` after every iteration: ``iteration, loss`` and the measures."""
    found: list[tuple] = []
    packed: list[DataFrame] = []

    def listen(iteration: int, loss: float, model: LinearChainCRFModel) -> None:
        if not packed:  # names and labels are those of all iterations
            packed.append(staged(pack(held, model.attrs, model.labels, places=True), "held"))
        measures = evaluate(model, packed[0])
        found.append((iteration, float(loss), *measures.first()))
        columns[:] = [f"{f.name} {f.dataType.simpleString()}" for f in measures.schema]

    columns: list[str] = []
    trainer.observer = listen
    try:
        model = trainer.fit(rows)
    finally:
        trainer.observer = None
    return model, rows.sparkSession.createDataFrame(found, ", ".join(["iteration int", "loss double", *columns]))


def cross_validate(trainer: LinearChainCRF, rows: DataFrame, folds: DataFrame, count: int) -> DataFrame:
    """``fold`` and the measures of each fold's rows under the model of the others; folds is (seq, fold)."""
    held = staged(sequences_of(rows).join(folds, "seq"), "folds")
    out = None
    for k in range(count):
        learn, test = split_by_group(held, "fold", k)
        row = evaluate(trainer.fit(learn.drop("fold")), test.drop("fold")).select(F.lit(k).alias("fold"), "*")
        out = row if out is None else out.unionByName(row)
    return out
