"""Terms of instructions and graphs of blocks: operand classes, term texts, classes of opcodes, edges, n-grams over edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.sources.staging import dropped, staged

from seqloom.operators.ngrams import NO_ARGUMENT, WILDCARD, masked

# fixed values: 16-bit arguments that stand for classes of operands, and the letter that a term's text shows for them
NONE, MEMORY, IMMEDIATE, MANY_REGISTERS, CALLEE_SAVED, ARGUMENT, OTHER = 0xFFFF, 0xFFFE, 0xFFFD, 0xFFFC, 0xFFFB, 0xFFFA, 0xFFF9
LETTERS = [(MEMORY, "A"), (IMMEDIATE, "B"), (MANY_REGISTERS, "C"), (CALLEE_SAVED, "D"), (ARGUMENT, "E"), (OTHER, "F")]
# fixed values: mnemonics of the branches, in the order of their classes from 0
BRANCHES = "jb jb_jnaej_j jbe jcxz_jec jl jle jmp jnb jmpe jnb_jae_j jnbe jnl jnle jno jnp jns jnz jo jp js jz loop loope loopn".split()
#: Classes of opcodes from this number on count as none.
NO_CLASS = 15


def operand_class(operand: Column) -> Column:
    """The argument of an operand (reads_memory, writes_memory, registers): memory before registers, several of them, one by its
    id, else an immediate; none for null."""
    registers = F.array_distinct(F.coalesce(operand["registers"], F.array().cast("array<int>")))
    held = F.when(operand["reads_memory"] | operand["writes_memory"], MEMORY).when(F.size(registers) > 1, MANY_REGISTERS).when(F.size(registers) == 1, registers[0]).otherwise(IMMEDIATE)
    return F.when(operand.isNull(), NONE).otherwise(held)


def arguments(operands: Column, is_nop: Column) -> tuple[Column, Column]:
    """The classes of the first two operands; an instruction that does nothing has none."""
    return tuple(F.when(is_nop, NONE).otherwise(operand_class(F.get(operands, F.lit(k)))) for k in (0, 1))


def term_text(entry: Column, arg1: Column, arg2: Column) -> Column:
    """``entry:arg:arg`` in hex, with letters for classes; missing arguments are left out. A null entry is the wildcard."""

    def shown(arg: Column) -> Column:
        out = F.when(arg == NO_ARGUMENT, "")
        for value, letter in LETTERS:
            out = out.when(arg == value, f":{letter}")
        return out.otherwise(F.concat(F.lit(":"), F.lower(F.hex(arg.cast("long")))))

    return F.when(entry.isNull(), WILDCARD).otherwise(F.concat(F.lower(F.hex(entry.cast("long"))), shown(arg1), shown(arg2)))


def classed(rows: DataFrame, classes: DataFrame, entry: str = "entry", none: int = NO_CLASS) -> DataFrame:
    """``rows`` with the ``class`` of their opcode by a table (entry, class); opcodes that it lacks have the class ``none``."""
    return rows.join(classes.withColumnRenamed("entry", "__e"), F.col(entry) == F.col("__e"), "left").drop("__e").withColumn("class", F.coalesce("class", F.lit(none)))


def branch_class(mnemonic: Column) -> Column:
    """The class of a branch; that of no branch is behind the last one."""
    at = F.array_position(F.array(*map(F.lit, BRANCHES)), mnemonic)
    return F.when(at > 0, at - 1).otherwise(len(BRANCHES)).cast("int")


def block_colors(rows: DataFrame) -> DataFrame:
    """``g, n, color, branch``: of classed rows (g, n, ord, class) the bits of the classes below NO_CLASS, and the class of the last row."""
    bit = F.when(F.col("class") < NO_CLASS, F.expr("shiftleft(1, cast(class as int))")).otherwise(0)
    return rows.groupBy("g", "n").agg(F.bit_or(bit).alias("color"), F.max_by("class", "ord").alias("branch"))


def inner_edges(edges: DataFrame) -> DataFrame:
    """Edges that stay within a graph and lead somewhere: neither between procedures nor into a sink."""
    return edges.where("not interproc and not sink")


def successor_ngrams(terms: DataFrame, edges: DataFrame, size: int, wildcard: str = WILDCARD) -> DataFrame:
    """``g, feat, cnt``: wildcard n-grams that go on, at a block's end, into every successor.

    terms are (g, n, ord, tok) with ord from 0, edges (g, src, dst) those of inner_edges(). The last term is
    never a wildcard; one that could not be read (null) ends an n-gram as such and is not gone beyond.
    """
    last = terms.groupBy("g", "n").agg(F.max("ord").alias("last"))
    here = terms.join(last, ["g", "n"]).select("g", "n", "ord", "tok", (F.col("ord") == F.col("last")).alias("ends"))
    within = here.where("not ends").select("g", "n", "ord", F.col("n").alias("n2"), (F.col("ord") + 1).alias("ord2"))
    over = here.where("ends").join(edges.select("g", F.col("src").alias("n"), F.col("dst").alias("n2")), ["g", "n"]).select("g", "n", "ord", "n2", F.lit(0).alias("ord2"))
    steps = within.unionByName(over)
    words = here.select("g", F.col("n").alias("n2"), F.col("ord").alias("ord2"), F.col("tok").alias("tok2"))
    links = steps.join(words, ["g", "n2", "ord2"]).where("tok2 is not null").select("g", "n", "ord", "n2", "ord2", "tok2")  # the same in every round, so shuffled once
    paths = here.where("tok is not null").select("g", "n", "ord", F.array("tok").alias("toks"))
    for _ in range(size - 1):
        paths = paths.join(links, ["g", "n", "ord"]).select("g", F.col("n2").alias("n"), F.col("ord2").alias("ord"), F.array_append("toks", F.col("tok2")).alias("toks"))
    # n-grams of one last term arise in one place, so that their terms are shuffled and not all their forms
    dealt = paths.withColumn("last", F.col("toks")[size - 1]).repartition("g", "last")
    feats = dealt.select("g", "last", F.explode(masked([F.col("toks")[k] for k in range(size)], wildcard)).alias("feat"))
    return feats.groupBy("g", "last", "feat").agg(F.count(F.lit(1)).alias("cnt")).drop("last")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``g, value``: each graph (nodes g, n, color; edges g, src, dst) in the DOT language, nodes and edges in order."""
    ns = nodes.select("g", F.lit(0).alias("k"), F.col("n").cast("string").alias("a"), F.lit("").alias("b"), F.concat(F.lit("n"), "n", F.lit(' [label="'), F.col("color").cast("string"), F.lit('"] ;')).alias("line"))
    es = edges.select("g", F.lit(1).alias("k"), F.col("src").cast("string").alias("a"), F.col("dst").cast("string").alias("b"), F.concat(F.lit(" n"), "src", F.lit(" -> n"), "dst", F.lit(" ;")).alias("line"))
    rows = ns.unionByName(es).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "a", "b", "line"))).alias("l"))
    return rows.select("g", F.concat(F.lit("digraph {\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n}")).alias("value"))


def coarsened(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (g, n, color) and edges (g, src, dst, type) after merging the pairs (g, a, b) of nodes, each into its a.

    Colours are united; edges of others keep their types; edges within a pair vanish, but a cycle of
    both or a loop leaves one loop of type 0. Pairs share no node.
    """
    to = pairs.select("g", F.col("b").alias("n"), F.col("a").alias("to"))
    colors = nodes.join(to, ["g", "n"], "left").groupBy("g", F.coalesce("to", "n").alias("n")).agg(F.bit_or("color").alias("color"))
    both = edges.join(to.withColumnsRenamed({"n": "src", "to": "s"}), ["g", "src"], "left").join(to.withColumnsRenamed({"n": "dst", "to": "d"}), ["g", "dst"], "left")
    both = both.select("g", F.coalesce("s", "src").alias("a"), F.coalesce("d", "dst").alias("b"), "src", "dst", "type")
    merged = pairs.select("g", F.col("a").alias("m"))
    marked = both.join(merged, (both["g"] == merged["g"]) & (both["a"] == merged["m"]) & (both["a"] == both["b"]), "left").select(both["g"], "a", "b", "src", "dst", "type", F.col("m").isNotNull().alias("inside"))
    outer = marked.where("not inside").select("g", F.col("a").alias("src"), F.col("b").alias("dst"), "type")
    loops = marked.where("inside").groupBy("g", "a").agg(F.max(F.col("src") == F.col("dst")).alias("self"), F.count_distinct(F.when(F.col("src") != F.col("dst"), F.col("src"))).alias("ways"))
    loops = loops.where("self or ways = 2").select("g", F.col("a").alias("src"), F.col("a").alias("dst"), F.lit(0).alias("type"))
    return colors, outer.unionByName(loops)


def matching(edges: DataFrame, seed: int = 0) -> DataFrame:
    """``g, a, b``: pairs of neighbours, a before b, in which no node stands twice and to which no pair of neighbours can be added.

    Pairs have a random order that the seed tells. In each round those go together that are first at both
    of their nodes; pairs that have lost a node go. Some log(n) rounds leave none, and the outcome is that of
    taking pairs one by one in their order. Directions, kinds and repeats of edges play no part.
    """
    name = [F.col(c).cast("string") for c in ("g", "a", "b")]
    left = edges.where("src <> dst").select("g", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    left = staged(left.withColumn("h", F.md5(F.concat_ws("|", F.lit(str(seed)), *name))), "pairs")
    found = None
    while not left.isEmpty():
        mark = F.struct("h", "a", "b")
        ends = left.select("g", F.explode(F.array("a", "b")).alias("n"), mark.alias("m"))
        least = ends.groupBy("g", "n").agg(F.min("m").alias("m"))
        # a pair that is first at both of its nodes is named twice
        chosen = staged(least.groupBy("g", "m").agg(F.count(F.lit(1)).alias("k")).where("k = 2").select("g", F.col("m.a").alias("a"), F.col("m.b").alias("b")), "chosen")
        found = chosen if found is None else found.union(chosen)
        gone = chosen.select("g", F.explode(F.array("a", "b")).alias("n"))
        rest = left.join(gone.withColumnRenamed("n", "a"), ["g", "a"], "left_anti").join(gone.withColumnRenamed("n", "b"), ["g", "b"], "left_anti")
        older, left = left, staged(rest.select("g", "a", "b", "h"), "pairs")
        dropped(older)
    return found if found is not None else left.select("g", "a", "b")


def coarser(nodes: DataFrame, edges: DataFrame, levels: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """coarsened() by drawn pairs, level upon level; each level is written."""
    for k in range(levels):
        nodes, edges = (staged(t, "coarser") for t in coarsened(nodes, edges, matching(edges, seed + k)))
    return nodes, edges
