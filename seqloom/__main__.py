"""``python -m seqloom learn|tag|dump``: sequence models over attribute text."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqloom.operators import validation
from seqloom.operators.crf import ALGORITHMS, LinearChainCRF, LinearChainCRFModel
from seqloom.sources import attribute_text, tag_text


def _settings(pairs: list[str]) -> dict:
    """``name=value`` parameters of the trainer, with the types that it wants."""
    out = {}
    for name, _, value in (p.partition("=") for p in pairs):
        kind = type(LinearChainCRF().getOrDefault(name))
        out[name] = value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    top = argparse.ArgumentParser(prog="seqloom")
    sub = top.add_subparsers(dest="command", required=True)
    learn = sub.add_parser("learn", help="train a model")
    learn.add_argument("data"), learn.add_argument("-m", "--model", default="")
    learn.add_argument("-a", "--algorithm", choices=ALGORITHMS, default="lbfgs")
    learn.add_argument("-p", "--set", action="append", default=[], metavar="NAME=VALUE")
    learn.add_argument("-e", "--holdout", type=int, help="evaluate on this group (a file's number, or a fold's with --split)")
    learn.add_argument("-g", "--split", type=int, default=0), learn.add_argument("-x", "--cross-validate", action="store_true")
    tag = sub.add_parser("tag", help="tag sequences")
    tag.add_argument("data"), tag.add_argument("-m", "--model", required=True), tag.add_argument("-o", "--output")
    tag.add_argument("-t", "--test", action="store_true"), tag.add_argument("-r", "--reference", action="store_true")
    tag.add_argument("-p", "--probability", action="store_true"), tag.add_argument("-i", "--marginal", action="store_true")
    tag.add_argument("--rank", type=int, default=0)
    dump = sub.add_parser("dump", help="show a model's features")
    dump.add_argument("model")
    args = top.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    if args.command == "dump":
        LinearChainCRFModel.load(args.model).dump(spark).orderBy("type", "src", "dst").show(1 << 20, truncate=False)
        return
    rows = attribute_text.read(spark, args.data).withColumn("seq", F.concat_ws("#", "grp", F.col("block").cast("string")))
    if args.command == "tag":
        model = LinearChainCRFModel.load(args.model)
        if args.test:
            validation.evaluate(model, rows.select("seq", "pos", "label", "feats")).show(truncate=False)
        if args.output:
            if args.rank:
                model.ranked(rows, args.rank).write.csv(args.output, sep="\t")
            else:
                tag_text.write_tagged(tag_text.tagged_lines(model.transform(rows), args.probability, args.marginal, args.reference), args.output)
        return
    trainer = LinearChainCRF(algorithm=args.algorithm, **_settings(args.set))
    groups = validation.round_robin(rows, args.split).withColumnRenamed("fold", "group") if args.split else attribute_text.file_groups(rows)
    body = rows.select("seq", "pos", "label", "feats")
    if args.cross_validate:
        count = args.split or groups.agg(F.max("group")).first()[0] + 1
        validation.cross_validate(trainer, body, groups.withColumnRenamed("group", "fold"), count).show(truncate=False)
        return
    if args.holdout is None:
        model = trainer.fit(body)
    else:
        learn_rows, held = validation.split_by_group(body.join(groups, "seq"), "group", args.holdout)
        model, report = validation.with_holdout(trainer, learn_rows.drop("group"), held.drop("group"))
        report.orderBy("iteration").show(1 << 20, truncate=False)
    if args.model:
        model.save(args.model)


if __name__ == "__main__":
    main()
