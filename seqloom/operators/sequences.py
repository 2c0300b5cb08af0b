"""Operators over ordered rows: runs, chains, transitions, templates, folds and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.operators.dictionary import dense_ids
from seqloom.sources.staging import staged


def segments(rows: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label", at: str = "ts", ranges: DataFrame | None = None) -> DataFrame:
    """Runs of equal labels: ``seq, label, start, end, seg_len, cum_count``.

    end is the start of the next run. That of the last run is where the range ends that holds its last place,
    by a table ``ranges`` (seq, begin, end), of ranges that overlap the one which begins last; without a range or a
    table it is its own last place. cum_count counts the rows up to the run's end from the sequence's start,
    seg_len those of the run.
    """
    w = Window.partitionBy(seq).orderBy(pos)
    flagged = rows.withColumn("__new", F.when(F.lag(label).over(w).eqNullSafe(F.col(label)) & (F.row_number().over(w) > 1), 0).otherwise(1))
    numbered = flagged.withColumn("__run", F.sum("__new").over(w))
    runs = numbered.groupBy(seq, "__run").agg(F.first(label).alias("label"), F.min(at).alias("start"), F.max(at).alias("__last"), F.count(F.lit(1)).alias("seg_len"))
    if ranges is not None:
        last = runs.groupBy(F.col(seq).alias("__s")).agg(F.max_by("__last", "__run").alias("__at"))  # a row per sequence
        held = last.join(ranges.select(F.col("seq").alias("__q"), "begin", F.col("end").alias("__stop")), (F.col("__s") == F.col("__q")) & (F.col("begin") <= F.col("__at")) & (F.col("__stop") > F.col("__at")))
        stops = held.groupBy("__s").agg(F.max_by("__stop", "begin").alias("__stop"))
        runs = runs.join(stops, F.col(seq) == F.col("__s"), "left").withColumn("__last", F.coalesce("__stop", "__last")).drop("__s", "__stop")
    r = Window.partitionBy(seq).orderBy("__run")
    return runs.select(F.col(seq).alias("seq"), "label", "start", F.coalesce(F.lead("start").over(r), "__last").alias("end"), "seg_len", F.sum("seg_len").over(r).alias("cum_count"))


def segment_report(runs: DataFrame, labels: list[str]) -> DataFrame:
    """One row per run, a column per label with the run's cumulative count, 0 elsewhere."""
    counts = (F.max(F.when(F.col("label") == x, F.col("cum_count")).otherwise(0)).alias(x) for x in labels)
    return runs.groupBy("seq", "start", "end").agg(*counts)


def chains(ids: DataFrame, key: str) -> DataFrame:
    """``first, last, n``: maximal runs of successive keys. Starts and ends of runs are numbered over sampled ranges."""
    here = ids.select(F.col(key).alias("k")).where("k is not null").distinct()
    before = here.select((F.col("k") + 1).alias("k")).withColumn("linked", F.lit(True))
    after = here.select((F.col("k") - 1).alias("k")).withColumn("goes_on", F.lit(True))
    ends = staged(here.join(before, "k", "left").join(after, "k", "left").where("linked is null or goes_on is null"), "chain_ends")
    # runs do not overlap, so the n-th start belongs to the n-th end
    starts = dense_ids(ends.where("linked is null").select(F.col("k").alias("first")), ["first"], "chain")
    stops = dense_ids(ends.where("goes_on is null").select(F.col("k").alias("last")), ["last"], "chain")
    return starts.join(stops, "chain").select("first", "last", (F.col("last") - F.col("first") + 1).alias("n"))


def transitions(rows: DataFrame, seq: str = "seq", pos: str = "pos", label: str = "label") -> DataFrame:
    """``prev, cur, n``: counts of successive labels; the first row of a sequence has no transition."""
    w = Window.partitionBy(seq).orderBy(pos)
    pairs = rows.select(F.lag(label).over(w).alias("prev"), F.col(label).alias("cur"))
    return pairs.where("prev is not null").groupBy("prev", "cur").agg(F.count(F.lit(1)).alias("n"))


def all_transitions(rows: DataFrame, seen: DataFrame, label: str = "label") -> DataFrame:
    """transitions() with a 0 for pairs of labels that never follow each other; labels are few."""
    labels = rows.select(F.col(label).alias("cur")).distinct()
    grid = labels.select(F.col("cur").alias("prev")).crossJoin(labels)
    return grid.join(seen, ["prev", "cur"], "left").select("prev", "cur", F.coalesce("n", F.lit(0)).alias("n"))


Template = tuple[tuple[str, int], ...]


def template_texts(rows: DataFrame, templates: list[Template], name: str, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``rows`` with an array of the templates' features: ``field[offset]`` names and values joined by bars; none where a part lies outside the sequence."""
    w = Window.partitionBy(seq).orderBy(pos)

    def value(field: str, offset: int) -> Column:
        return F.col(field) if offset == 0 else F.lag(field, -offset).over(w) if offset < 0 else F.lead(field, offset).over(w)

    places = sorted({part for t in templates for part in t})
    named = {part: f"__p{k}" for k, part in enumerate(places)}
    wide = rows.select("*", *(value(*part).alias(named[part]) for part in places))

    def feature(t: Template) -> Column:
        name = "|".join(f"{f}[{o}]" for f, o in t)
        there = [F.col(named[part]).isNotNull() for part in t]
        ok = there[0]
        for c in there[1:]:
            ok = ok & c
        return F.when(ok, F.concat(F.lit(f"{name}="), F.concat_ws("|", *(F.col(named[part]) for part in t))))

    return wide.withColumn(name, F.array_compact(F.array(*(feature(t) for t in templates)).cast("array<string>"))).drop(*named.values())


def template_features(rows: DataFrame, templates: list[Template], seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``seq, pos, feat``: the features of template_texts() in rows of their own."""
    fields = sorted({field for t in templates for field, _ in t} - {seq, pos})
    held = template_texts(rows.select(seq, pos, *fields), templates, "__feats", seq, pos)
    return held.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), F.explode("__feats").alias("feat"))


def macro_features(rows: DataFrame, macro: str, columns: list[str], seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``seq, pos, feat``: a text with ``%x[row,column]`` places filled in; places outside the sequence are empty."""
    import re

    w = Window.partitionBy(seq).orderBy(pos)
    parts, at = [], 0
    for m in re.finditer(r"%x\[(-?\d+),(\d+)\]", macro):
        parts.append(F.lit(macro[at : m.start()]))
        offset, field = int(m[1]), columns[int(m[2])]
        found = F.col(field) if offset == 0 else F.lag(field, -offset).over(w) if offset < 0 else F.lead(field, offset).over(w)
        parts.append(F.coalesce(found, F.lit("")))
        at = m.end()
    return rows.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), F.concat(*parts, F.lit(macro[at:])).alias("feat"))


def disjunctive(rows: DataFrame, low: int, high: int, field: str = "label", seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``seq, pos, feat``: one feature per row of the frame [low, high], named by the frame alone."""
    w = Window.partitionBy(seq).orderBy(pos).rowsBetween(low, high)
    held = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), F.collect_list(field).over(w).alias("near"))
    return held.select("seq", "pos", F.explode("near").alias("v")).select("seq", "pos", F.concat(F.lit(f"{field}[{low}..{high}]="), "v").alias("feat"))


def boundary_marks(rows: DataFrame, seq: str = "seq", pos: str = "pos") -> DataFrame:
    """``seq, pos, mark``: __BOS__ on the first row of a sequence and __EOS__ on the last; a single row has both."""
    w = Window.partitionBy(seq).orderBy(pos)
    marks = F.array_compact(F.array(F.when(F.lag(pos).over(w).isNull(), "__BOS__"), F.when(F.lead(pos).over(w).isNull(), "__EOS__")))
    held = rows.select(F.col(seq).alias("seq"), F.col(pos).alias("pos"), marks.alias("marks"))
    return held.select("seq", "pos", F.explode("marks").alias("mark"))


def state_features(document_words: DataFrame, label: str, minfreq: int) -> DataFrame:
    """``tok, label, freq``: sums of token counts by label, those of minfreq and more."""
    rows = document_words.select(F.col(label).alias("label"), F.explode("words").alias("tok"))
    return rows.groupBy("tok", "label").agg(F.count(F.lit(1)).alias("freq")).where(F.col("freq") >= minfreq)


def fold(key: Column, folds: int) -> Column:
    """A fold from a multiplicative hash of an integer key: repeatable, and spread over all folds."""
    return F.pmod(F.shiftright(F.pmod(key * F.lit(2654435761), F.lit(1 << 32)), 16), F.lit(folds))


def rank_shares(rows: DataFrame, k: int, seq: str = "seq", label: str = "label") -> DataFrame:
    """``seq, rank, label, share``: the k most frequent labels of a sequence, ties to the smaller label."""
    counts = rows.groupBy(seq, label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(seq))
    rank = F.row_number().over(Window.partitionBy(seq).orderBy(F.desc("n"), label))
    ranked = counts.select(F.col(seq).alias("seq"), rank.alias("rank"), F.col(label).alias("label"), (F.col("n") / total).alias("share"))
    return ranked.where(F.col("rank") <= k)


def path_features(rows: DataFrame) -> DataFrame:
    """``seq, type, src, dst, value``: the features on the path of a sequence's own labels: sums of values by attribute and label
    (type 0), counts of label pairs (type 1). rows are (seq, pos, label, feats); a null label has none."""
    known = rows.where("label is not null")
    states = known.select("seq", F.explode("feats").alias("f"), "label").select("seq", F.lit(0).alias("type"), F.col("f.attr").alias("src"), F.col("label").alias("dst"), F.coalesce("f.value", F.lit(1.0)).alias("value"))
    before = F.lag("label").over(Window.partitionBy("seq").orderBy("pos"))
    moves = rows.select("seq", F.lit(1).alias("type"), before.alias("src"), F.col("label").alias("dst"), F.lit(1.0).alias("value")).where("src is not null and dst is not null")
    return states.unionByName(moves).groupBy("seq", "type", "src", "dst").agg(F.sum("value").alias("value"))
