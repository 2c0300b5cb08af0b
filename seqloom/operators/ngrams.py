"""Wildcard n-grams of ordered terms, and their packed and written forms."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqloom.sources.adapters import by_row, token_lines

WILDCARD = "*"


def masked(terms: list[Column], wildcard: str) -> Column:
    """All forms of one n-gram: each term but the last kept or replaced."""
    kept = [(t, F.lit(wildcard)) for t in terms[:-1]]
    joint = F.lit("_")

    def written(parts: list[Column]) -> Column:
        return F.concat(*(x for part in parts for x in (part, joint)), terms[-1]) if parts else terms[-1]

    return F.array(*(written([pair[m] for pair, m in zip(kept, mask)]) for mask in product((0, 1), repeat=len(kept))))


def array_ngrams(words: str | Column, size: int, wildcard: str = WILDCARD) -> Column:
    """Array of the wildcard n-grams of an array of terms; empty where it is shorter. No shuffle is needed."""
    def at(i: Column) -> Column:
        return masked([F.element_at(words, i + k) for k in range(size)], wildcard)

    count = F.size(words) - (size - 1)
    return F.when(count >= 1, F.flatten(F.transform(F.sequence(F.lit(1), count), at))).otherwise(F.array().cast("array<string>"))


def ngrams(terms: DataFrame, size: int, block: list[str], order: str, term: str = "tok", wildcard: str = WILDCARD) -> DataFrame:
    """``feat`` rows of the wildcard n-grams within blocks, from one row per term; other columns stay.

    A null term (one that could not be read) may end no n-gram and be inside none.
    """
    w = Window.partitionBy(*block).orderBy(order)
    ahead = [F.col(term)] + [F.lead(term, k).over(w) for k in range(1, size)]
    named = terms.select("*", *(c.alias(f"__t{k}") for k, c in enumerate(ahead)))
    full = " and ".join(f"__t{k} is not null" for k in range(size))
    return named.where(full).select(*terms.columns, F.explode(masked([F.col(f"__t{k}") for k in range(size)], wildcard)).alias("feat"))


def line_ngram_counts(lines: DataFrame, size: int) -> DataFrame:
    """``doc_id, feat, cnt`` over lines of words."""
    feats = lines.select("doc_id", F.explode(array_ngrams("words", size)).alias("feat"))
    return feats.groupBy("doc_id", "feat").agg(F.count(F.lit(1)).alias("cnt"))


def text_words(text: str | Column) -> Column:
    """All words of a text in order, as the lines of token_lines() have them."""
    return F.filter(F.split(F.translate(text, "\n", " "), " ", -1), lambda w: w != "")


def row_ngram_counts(documents: DataFrame, size: int, *more: str) -> DataFrame:
    """``doc_id, feat, cnt`` (and further columns before ``feat``) over the lines of documents (doc_id, text), each counted in its own row.

    Equal n-grams stand side by side in a sorted array, so no table of several documents' n-grams is kept and nothing is shuffled.
    """
    held = documents.where("text is not null")
    if size == 1:
        held = held.select("doc_id", *more, text_words("text").alias("grams"))
    else:
        lines = F.transform(F.split("text", "\n", -1), lambda line: F.filter(F.split(line, " ", -1), lambda w: w != ""))
        held = held.select("doc_id", *more, lines.alias("lines"))
        held = held.select("doc_id", *more, F.flatten(F.transform("lines", lambda words: array_ngrams(words, size))).alias("grams"))
    held = held.select("doc_id", *more, F.sort_array("grams").alias("grams"))
    # places at which a run begins, and the place behind the last one
    ends = F.filter(F.sequence(F.lit(0), F.size("grams")), lambda i: ~F.get("grams", i).eqNullSafe(F.get("grams", i - 1)))
    held = held.select("doc_id", *more, "grams", ends.alias("ends"))
    runs = F.transform(F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))), lambda i, k: F.struct(F.get("grams", i).alias("feat"), (F.get("ends", k + 1) - i).cast("long").alias("cnt")))
    return held.select("doc_id", *more, F.inline(runs))


def document_ngram_counts(documents: DataFrame, size: int, *more: str) -> DataFrame:
    """As row_ngram_counts(), for documents of any size, of which some may have the same doc_id."""
    alone, others = by_row(documents.select("doc_id", "text", *more))
    alone = alone.repartition("doc_id")  # one file may be few tasks
    lines = token_lines(others, *more).select("doc_id", *more, F.explode(array_ngrams("words", size)).alias("feat"))
    return row_ngram_counts(alone, size, *more).unionByName(lines.groupBy("doc_id", *more, "feat").agg(F.count(F.lit(1)).alias("cnt")))


def gram_totals(texts: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``doc_id, n_feats, total``: distinct wildcard n-grams of each size, and all of them, over the lines of documents (doc_id, texts).

    Both are found in a document's own row, so texts are all that is shuffled. Documents without n-grams are left out.
    """
    lines = F.flatten(F.transform("texts", lambda t: F.split(t, "\n", -1)))
    held = texts.select("doc_id", F.transform(lines, lambda line: F.filter(F.split(line, " ", -1), lambda w: w != "")).alias("lines"))

    def counts(size: int) -> Column:
        grams = F.flatten(F.transform("lines", lambda words: array_ngrams(words, size)))
        return F.struct(F.size(F.array_distinct(grams)).alias("n"), F.size(grams).alias("m"))

    found = held.select("doc_id", *(counts(n).alias(f"g{k}") for k, n in enumerate(sizes)))
    n_feats, total = (sum((F.col(f"g{k}.{c}").cast("long") for k in range(1, len(sizes))), F.col(f"g0.{c}").cast("long")) for c in ("n", "m"))
    return found.select("doc_id", n_feats.alias("n_feats"), total.alias("total")).where("total > 0")


def cross_block_bigrams(lines: DataFrame) -> DataFrame:
    """``doc_id, feat, cnt``: the last word of a line with the first of the next line, by document."""
    w = Window.partitionBy("doc_id").orderBy("line")
    ends = lines.select("doc_id", F.try_element_at("words", F.lit(-1)).alias("a"), F.lead(F.try_element_at("words", F.lit(1))).over(w).alias("b"))
    return ends.where("a is not null and b is not null").groupBy("doc_id", F.concat_ws("_", "a", "b").alias("feat")).agg(F.count(F.lit(1)).alias("cnt"))


def distance_bigrams(lines: DataFrame, distance: int) -> DataFrame:
    """``feat, cnt``: pairs of words with so many words between them, written ``a_*n_b``."""
    step = distance + 1
    pairs = F.when(F.size("words") > step, F.transform(F.sequence(F.lit(1), F.size("words") - step), lambda i: F.concat(F.element_at("words", i), F.lit(f"_*{distance}_"), F.element_at("words", i + step)))).otherwise(F.array().cast("array<string>"))
    return lines.select(F.explode(pairs).alias("feat")).groupBy("feat").agg(F.count(F.lit(1)).alias("cnt"))


def pack(entry: Column, arg1: Column, arg2: Column) -> Column:
    """One long of an opcode and two 16-bit arguments."""
    return F.shiftleft(entry.cast("long"), 32) + F.shiftleft(arg1.cast("long"), 16) + arg2.cast("long")


#: The 16-bit argument that says there is none.
NO_ARGUMENT = 0xFFFF


def pack_text(value: Column) -> Column:
    """``I`` and the hex of a packed term, without up to two arguments at the end that say there is none."""
    once = F.when(value.bitwiseAND(NO_ARGUMENT) == NO_ARGUMENT, F.shiftright(value, 16)).otherwise(value)
    twice = F.when((once.bitwiseAND(NO_ARGUMENT) == NO_ARGUMENT) & (value.bitwiseAND(NO_ARGUMENT) == NO_ARGUMENT), F.shiftright(once, 16)).otherwise(once)
    return F.concat(F.lit("I"), F.lower(F.hex(twice)))


def unpack_text(text: Column, entry_bits: int = 16) -> tuple[Column, Column, Column]:
    """Opcode and arguments of pack_text(); opcodes are below 2 ** entry_bits, so the length tells what was left out."""
    digits = F.substring(text, 2, 64)
    value = F.conv(digits, 16, 10).cast("long")
    short, mid = F.length(digits) <= entry_bits // 4, F.length(digits) <= entry_bits // 4 + 4
    entry = F.when(short, value).when(mid, F.shiftright(value, 16)).otherwise(F.shiftright(value, 32))
    arg1 = F.when(short, NO_ARGUMENT).when(mid, value.bitwiseAND(0xFFFF)).otherwise(F.shiftright(value, 16).bitwiseAND(0xFFFF))
    arg2 = F.when(mid, NO_ARGUMENT).otherwise(value.bitwiseAND(0xFFFF))
    return entry, arg1.cast("long"), arg2.cast("long")
