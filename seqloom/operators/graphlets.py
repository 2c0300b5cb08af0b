"""Small subgraphs of coloured directed multigraphs and their canonical texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Graphs of more edges are described by joins, others in their sets' own rows.
NET_EDGES = 256
#: Graphs with more nodes have no graphlets of more than three nodes.
MOST_NODES = 5000


def runs_text(types: Column) -> Column:
    """A sorted array of edge types as ``type`` or ``typexN``, joined by commas."""
    def one(t: Column) -> Column:
        n = F.size(F.filter(types, lambda u: u == t))
        return F.concat(t.cast("string"), F.when(n > 1, F.concat(F.lit("x"), n.cast("string"))).otherwise(""))

    return F.array_join(F.transform(F.array_distinct(types), one), ",")


def describe(sets: DataFrame, edges: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """``g, feat, cnt``: canonical texts of node sets (g, id, nodes), counted by graph.

    A node reads ``ins/outs/self`` (and ``/color``), of the edges within the set; node texts are joined
    by ``_`` in the order of their nodes: by color's text, then by ins, outs and self, of which smaller
    sets come first and equal sizes are compared type by type.
    """
    if colors is None:
        small, sets = _with_nets(sets, edges)
        feats = _row_texts(small).unionByName(_joined_texts(sets, edges))
    else:
        feats = _joined_texts(sets, edges, colors)
    return feats.groupBy("g", "feat").agg(F.count(F.lit(1)).alias("cnt"))


def _with_nets(sets: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sets of graphs with few edges, with all of these in an array ``net``; and the other sets."""
    counted = edges.select("g", "src", "dst", "type", F.count(F.lit(1)).over(Window.partitionBy("g")).alias("m"))
    edge = F.when(F.col("m") <= NET_EDGES, F.struct("src", "dst", "type"))
    nets = counted.groupBy("g").agg(F.collect_list(edge).alias("net"), (F.max("m") > NET_EDGES).alias("big"))
    held = sets.join(nets, "g", "left")
    big = F.coalesce("big", F.lit(False))
    return held.where(~big).select("g", "nodes", "net"), held.where(big).select("g", "id", "nodes")


def _row_texts(sets: DataFrame) -> DataFrame:
    """``g, feat``: texts of sets (g, nodes, net), each from its own row; a net that is null has no edges."""
    inside = F.filter("net", lambda e: F.array_contains("nodes", e["src"]) & F.array_contains("nodes", e["dst"]) & e["type"].isNotNull())
    held = sets.select("g", "nodes", F.coalesce(inside, F.array().cast(sets.schema["net"].dataType)).alias("net"))

    def types(kept) -> Column:
        return F.array_sort(F.transform(F.filter("net", kept), lambda e: e["type"].cast("int")))

    ends = F.transform("nodes", lambda n: F.struct(
        types(lambda e: (e["dst"] == n) & (e["src"] != n)).alias("r0"), types(lambda e: (e["src"] == n) & (e["dst"] != n)).alias("r1"), types(lambda e: (e["src"] == n) & (e["dst"] == n)).alias("r2")))
    held = held.select("g", ends.alias("ends"))
    ranked = F.transform("ends", lambda e: F.struct(*(c.alias(f"k{j}") for j, c in enumerate(x for k in range(3) for x in (F.size(e[f"r{k}"]), e[f"r{k}"]))), F.concat_ws("/", *(runs_text(e[f"r{k}"]) for k in range(3))).alias("t")))
    return held.select("g", F.array_join(F.transform(F.array_sort(ranked), lambda s: s["t"]), "_").alias("feat"))


def _joined_texts(sets: DataFrame, edges: DataFrame, colors: DataFrame | None = None) -> DataFrame:
    """``g, feat``: texts of sets (g, id, nodes) by joins with edges and colours."""
    both = sets.select("g", "id", F.explode("nodes").alias("x"), "nodes").select("g", "id", "x", F.explode("nodes").alias("y"))
    held = both.join(edges.select("g", F.col("src").alias("x"), F.col("dst").alias("y"), "type"), ["g", "x", "y"])
    ends = held.select("g", "id", F.explode(F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("n"), F.lit(2).alias("role")))).otherwise(F.array(F.struct(F.col("x").alias("n"), F.lit(1).alias("role")), F.struct(F.col("y").alias("n"), F.lit(0).alias("role"))))).alias("e"), "type")
    every = sets.select("g", "id", F.explode("nodes").alias("n"))
    by_role = ends.groupBy("g", "id", F.col("e.n").alias("n")).agg(*(F.array_sort(F.collect_list(F.when(F.col("e.role") == r, F.col("type")))).alias(f"r{r}") for r in (0, 1, 2)))
    nodes = every.join(by_role, ["g", "id", "n"], "left")
    text = F.concat_ws("/", *(runs_text(F.coalesce(f"r{r}", F.array().cast("array<int>"))) for r in (0, 1, 2)))
    if colors is not None:
        nodes = nodes.join(colors.select("g", "n", "color"), ["g", "n"], "left")
        shade = F.coalesce(F.col("color").cast("string"), F.lit(""))
        text = F.concat_ws("/", text, shade)
    else:
        shade = F.lit("")
    roles = [F.coalesce(f"r{r}", F.array().cast("array<int>")) for r in (0, 1, 2)]
    rank = [c.alias(f"k{j}") for j, c in enumerate([shade, *(x for r in roles for x in (F.size(r), r))])]
    return nodes.select("g", "id", F.struct(*rank, text.alias("t")).alias("s")).groupBy("g", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["t"]), "_").alias("feat")).drop("id")


def colored(sets: DataFrame, edges: DataFrame, colorings: dict[str, DataFrame]) -> DataFrame:
    """describe() under several colourings (g, n, color), each text behind its colouring's prefix."""
    out = None
    for prefix, colors in colorings.items():
        found = describe(sets, edges, colors).withColumn("feat", F.concat(F.lit(prefix), "feat"))
        out = found if out is None else out.unionByName(found)
    return out


def singles(nodes: DataFrame) -> DataFrame:
    return nodes.select("g", F.col("n").alias("id"), F.array("n").alias("nodes"))


def pairs(edges: DataFrame) -> DataFrame:
    """A set per distinct source and target; a cycle of two gives two."""
    steps = edges.where("src <> dst").select("g", "src", "dst").distinct()
    return steps.select("g", F.concat_ws(">", "src", "dst").alias("id"), F.array("src", "dst").alias("nodes"))


def triples(edges: DataFrame) -> DataFrame:
    """Per centre: pairs of its sources, pairs of its targets, and a source with another target.

    A triangle is found at every centre, and a node that is both source and target stands in several
    lists; multiplicities stay.
    """
    steps = edges.where("src <> dst").select("g", "src", "dst").distinct()
    sources = steps.select("g", F.col("dst").alias("c"), F.col("src").alias("a"))
    targets = steps.select("g", F.col("src").alias("c"), F.col("dst").alias("b"))
    ss = sources.join(sources.withColumnRenamed("a", "b"), ["g", "c"]).where("a < b").withColumn("kind", F.lit("ss"))
    tt = targets.withColumnRenamed("b", "a").join(targets, ["g", "c"]).where("a < b").withColumn("kind", F.lit("tt"))
    st = sources.join(targets, ["g", "c"]).where("a <> b").withColumn("kind", F.lit("st"))
    every = ss.unionByName(tt).unionByName(st)
    return every.select("g", F.concat_ws(">", "kind", "c", "a", "b").alias("id"), F.array("c", "a", "b").alias("nodes"))


def connected_sets(nodes: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Every connected set of ``size`` nodes, made once; large graphs are left out.

    A set begins at its least node and grows by nodes from its list of candidates, each of which the
    branches after it do without. A node joins the candidates with the first neighbour of its that is
    taken, if it is no neighbour of the nodes before. So every set comes about in one way alone, no sets are
    compared, and a round shuffles each set of its size once.
    """
    small = nodes.groupBy("g").agg(F.count(F.lit(1)).alias("many")).where(F.col("many") <= MOST_NODES).select("g")
    steps = edges.where("src <> dst").select("g", "src", "dst")
    pairs_ = steps.union(steps.select("g", "dst", "src")).groupBy("g", F.col("src").alias("x")).agg(F.collect_set("dst").alias("near"))  # at most as many as a graph has nodes
    near = pairs_.join(small, "g", "left_semi")
    sets = nodes.join(small, "g", "left_semi").select("g", F.array("n").alias("nodes"))
    if size > 1:
        begun = nodes.select("g", F.col("n").alias("x")).join(near, ["g", "x"])
        sets = begun.select("g", F.array("x").alias("nodes"), F.filter("near", lambda u: u > F.col("x")).alias("left"), F.array_append("near", F.col("x")).alias("seen"))
    for k in range(1, size):
        taken = sets.select("g", "nodes", "left", "seen", F.posexplode("left").alias("i", "x"))
        grown = F.array_append("nodes", F.col("x")).alias("nodes")
        if k == size - 1:
            sets = taken.select("g", grown)
            break
        met = taken.join(near, ["g", "x"])
        new = F.filter(F.array_except("near", "seen"), lambda u: u > F.col("nodes")[0])
        left = F.concat(F.slice("left", F.col("i") + 2, F.size("left")), new).alias("left")
        sets = met.select("g", grown, left, F.array_union("seen", "near").alias("seen"))
    sets = sets.select("g", F.array_sort("nodes").alias("nodes"))
    return sets.select("g", F.array_join(F.transform("nodes", lambda n: n.cast("string")), ">").alias("id"), "nodes")
