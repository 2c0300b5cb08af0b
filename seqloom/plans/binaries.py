"""Queries of the files and graphs around binaries: feature files, terms of instructions, blocks, tagged texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import blocks, dictionary, graphlets, ngrams, sequences, validation
from seqloom.plans import labelling, mining
from seqloom.plans.mining import COUNT_TEXTS, DESCRIBE, EVENTS, GRAPH, KEEP, KNOWN_LANGS, LINES, MI_SQL
from seqloom.sources import attribute_text, feature_files, tag_text
from seqloom.sources.adapters import event_edges, event_nodes, event_sequences, table
from seqloom.sources.staging import kept_at, new_path

# -- files: a document stands for a function, its language for the binary


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bin, addr, feat, cnt``: words by document."""
    counts = ngrams.document_ngram_counts(table(spark, sf_dir, "documents"), 1, "lang")
    return counts.select(F.col("lang").alias("bin"), F.col("doc_id").alias("addr"), "feat", "cnt")


def instances_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after writing and reading feature lists and instances of every binary; they are counted once for both files."""
    counts = kept_at(spark, new_path(spark, "counts"), lambda: _counts(spark, sf_dir))
    lists, lines = new_path(spark, "featlist"), new_path(spark, "instances")
    feature_files.write_features(feature_files.local_features(counts), lists)
    features = feature_files.read_features(spark, lists)
    feature_files.write_instances(counts, features, lines)
    return feature_files.read_instances(spark, lines, features).select("bin", "addr", "feat", "cnt")


def feature_list_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "feat_list")
    feature_files.write_numbered(mining.global_vocab(spark, sf_dir), path, "feat_id", "tok")
    return feature_files.read_numbered(spark, path, "feat_id", "tok")


def toolchain_index_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "toolchain_index")
    feature_files.write_numbered(mining.label_index(spark, sf_dir), path, "label_id", "lang")
    return feature_files.read_numbered(spark, path, "label_id", "lang")


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("bin"), F.col("doc_id").alias("addr"), "n_chars")
    told = docs.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("addr"), F.col("toxic").alias("label")), "addr")
    feats = F.array(F.struct(F.lit(1).alias("id"), F.lit(1.0).alias("value")), F.struct(F.lit(2).alias("id"), (F.col("n_chars") / 4).alias("value")))
    return feature_files.chain_lines(docs.select("bin", "addr"), told.select("bin", "addr", "label", feats.alias("feats")))


def linear_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with an instance, in chains that end where one has none."""
    return _chains(spark, sf_dir).select("bin", "chain", "pos", "addr", "label")


def data_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and sums by binary and label, and addresses of its map, after writing and reading both files."""
    data, maps = new_path(spark, "data"), new_path(spark, "map")
    feature_files.write_data(_chains(spark, sf_dir), data, maps)
    lines = feature_files.read_data(spark, data).select("bin", "label", F.aggregate("feats", F.lit(0.0), lambda a, f: a + f["value"]).alias("v"))
    sums = lines.groupBy("bin", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    addresses = feature_files.read_map(spark, maps).groupBy("bin").agg(F.count(F.lit(1)).alias("addresses"), F.sum("addr").alias("addr_sum"))
    return sums.join(addresses, "bin")


def selected_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selected words with their greatest counts, after writing and reading the selection."""
    top = mining.mi_topk_tokens(spark, sf_dir)
    counts = _counts(spark, sf_dir).join(F.broadcast(top.select(F.col("tok").alias("feat"))), "feat", "left_semi")
    held = dictionary.scales(counts).join(top.withColumnRenamed("tok", "feat"), "feat")
    ranked = dictionary.dense_ids(held.withColumn("least", -F.col("mi")).withColumn("order", F.reverse("feat")), ["least", "feat"], "rank")
    path = new_path(spark, "selected")
    feature_files.write_selected(ranked.select("rank", F.col("rank").alias("feat_id"), "feat", "scale"), path)
    return feature_files.read_selected(spark, path)


def file_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths read from a list, with their base names and the names that data files have."""
    path = new_path(spark, "files")
    table(spark, sf_dir, "pages").where("url is not null").select(F.col("url").alias("value")).write.text(path)
    held = feature_files.read_file_list(spark, path)
    key = attribute_text.toolchain_key(F.col("path"), list(KNOWN_LANGS))
    return held.select("path", feature_files.base_name(F.col("path")).alias("base"), F.when(key.isNotNull(), feature_files.prefixed_name(key, F.col("path"))).alias("name"))


# -- terms


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    size, key = F.col("p_size"), F.col("p_partkey")
    first = F.struct((size % 4 == 0).alias("reads_memory"), F.lit(False).alias("writes_memory"), F.when(size % 3 == 1, F.array(size)).when(size % 3 == 2, F.array(size, size + 1)).otherwise(F.array().cast("array<int>")).cast("array<int>").alias("registers"))
    second = F.struct(F.lit(False).alias("reads_memory"), (key % 5 == 0).alias("writes_memory"), F.array((size % 7).cast("int")).alias("registers"))
    operands = F.when(size % 2 == 0, F.array(first, second)).otherwise(F.array(first))
    arg1, arg2 = blocks.arguments(operands, key % 11 == 0)
    return part.select("p_partkey", (key % 400 + 1).alias("entry"), arg1.cast("int").alias("arg1"), arg2.cast("int").alias("arg2"))


def operand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of operands and the texts of their terms; every seventh is a wildcard."""
    rows = _terms(spark, sf_dir)
    entry = F.when(F.col("p_partkey") % 7 != 0, F.col("entry"))
    return rows.select("p_partkey", "arg1", "arg2", blocks.term_text(entry, F.col("arg1"), F.col("arg2")).alias("txt"))


def term_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct terms numbered in their order: opcode, then arguments."""
    return dictionary.dense_ids(_terms(spark, sf_dir).select("entry", "arg1", "arg2").distinct(), ["entry", "arg1", "arg2"], "nth")


def block_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as instructions, in blocks by supplier: the classes of opcodes by a table, as bits and of the last one."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("g"), (F.col("l_suppkey") % 3).alias("n"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ord"), (F.col("l_partkey") % 30).alias("entry"))
    classes = spark.range(25).select(F.col("id").alias("entry"), (F.col("id") % 17).cast("int").alias("class"))
    return blocks.block_colors(blocks.classed(rows, classes)).select("g", "n", "color", "branch")


def part_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours of orders as blocks of their parts, whose classes are a table that is written and joined."""
    classes = kept_at(spark, new_path(spark, "classes"), lambda: table(spark, sf_dir, "part").select(F.col("p_partkey").alias("entry"), (F.col("p_size") % 17).cast("int").alias("class")))
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_suppkey").alias("g"), F.col("l_orderkey").alias("n"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("entry"))
    return blocks.block_colors(blocks.classed(rows, classes)).select("g", "n", "color", "branch")


#: Mnemonics that parts stand for, by size: all branches and others.
MNEMONICS = [*blocks.BRANCHES, "mov", "call", ""]


def branch_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of parts' mnemonics, some of which are none of a branch."""
    name = F.element_at(F.array(*map(F.lit, MNEMONICS)), (F.col("p_size") % len(MNEMONICS) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", name.alias("mnemonic"), blocks.branch_class(name).alias("class"))


# -- blocks: the turns of a conversation, with edges to the next turns


def _blocks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("g"), F.col("turn").alias("n"), F.filter(F.split(F.translate("text", "\n", " "), " ", -1), lambda w: w != "").alias("w"))
    terms = turns.select("g", "n", F.posexplode("w").alias("ord", "tok"))
    steps = turns.select("g", F.col("n").alias("src"), F.explode(F.array(F.col("n") + 1, F.col("n") + 2)).alias("dst"))
    return terms, steps.withColumns({"interproc": F.col("src") % 4 == 3, "sink": F.col("dst") % 5 == 4})


def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.inner_edges(_blocks(spark, sf_dir)[1]).select("g", "src", "dst")


def successor_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wildcard 3-grams of words that go on into every next turn."""
    terms, edges = _blocks(spark, sf_dir)
    return blocks.successor_ngrams(terms, blocks.inner_edges(edges), 3)


# -- graphs


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = event_sequences(table(spark, sf_dir, "events"))
    return rows, event_nodes(rows), event_edges(rows)


def graphlet_colorings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graphlets of one node under two colourings: the quarters of the day, and the class of the last event's value."""
    rows, nodes, edges = _graph(spark, sf_dir)
    branch = rows.groupBy(F.col("seq").alias("g"), F.col("label").alias("n")).agg(F.floor(F.max_by("value", "pos") / 100).cast("int").alias("color"))
    sets = graphlets.singles(nodes)
    return graphlets.colored(sets, edges, {"G_": nodes, "B_": branch})


def dot_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, edges = _graph(spark, sf_dir)
    return blocks.dot_lines(nodes, edges)


def _coarse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    _, nodes, edges = _graph(spark, sf_dir)
    there = nodes.where("n in ('click', 'view')").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where("c = 2")
    return blocks.coarsened(nodes, edges, there.select("g", F.lit("click").alias("a"), F.lit("view").alias("b")))


def coarsened_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir)[0]


def coarsened_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coarse(spark, sf_dir)[1].groupBy("g", "src", "dst", "type").agg(F.count(F.lit(1)).alias("n"))


def matched_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of neighbouring event types that are drawn to be merged."""
    return blocks.matching(_graph(spark, sf_dir)[2])


def coarse_drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours after two levels of drawn pairs."""
    _, nodes, edges = _graph(spark, sf_dir)
    return blocks.coarser(nodes, edges, 2)[0].select("g", "n", "color")


# -- texts around tagging


def prediction_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that occur in each order's prediction."""
    rows = labelling._judged(spark, sf_dir)
    return rows.groupBy("seq").agg(F.array_join(F.array_sort(F.collect_set("pred")), ",").alias("labels"))


def tagged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' predictions as text with probability, marginals and references."""
    line = table(spark, sf_dir, "lineitem")
    rows = line.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("label"), F.col("l_returnflag").alias("pred"), F.col("l_discount").cast("double").alias("marginal"), F.lit(0.5).alias("probability"))
    return tag_text.tagged_lines(rows, True, True, True)


def instance_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    feats = F.array(F.struct(F.concat(F.lit("q"), F.col("l_linenumber").cast("string")).alias("attr"), F.col("l_quantity").cast("double").alias("value")))
    return tag_text.instance_lines(line.select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("label"), feats.alias("feats")))


def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of events by place, as the report's text."""
    runs = sequences.segments(event_sequences(table(spark, sf_dir, "events")), at="pos")
    return tag_text.report_lines(sequences.segment_report(runs, labelling.LABELS), labelling.LABELS)


def report_text_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report with ends of ranges: events' places stand in ranges of eight, and sequences end where their last one does."""
    rows = event_sequences(table(spark, sf_dir, "events"))
    eighth = F.floor(F.col("pos") / 8) * 8
    ranges = rows.select("seq", eighth.alias("begin"), (eighth + 8).alias("end")).distinct()
    runs = sequences.segments(rows, at="pos", ranges=ranges)
    return tag_text.report_lines(sequences.segment_report(runs, labelling.LABELS), labelling.LABELS)


def weighted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with weights behind the last colon."""
    line = F.concat_ws("\t", "lang", F.concat(F.col("source"), F.lit(":"), F.col("n_chars").cast("string")), F.lit("plain"), F.lit("a:b:2.5"))
    held = table(spark, sf_dir, "documents").select("doc_id", tag_text.parse_line(line).alias("p"))
    return held.select("doc_id", "p.label", F.posexplode("p.feats").alias("nth", "f")).select("doc_id", "label", "nth", "f.attr", "f.value")


TEMPLATE_FILE = ["# templates", "U00:%x[-1,0]", "B", "U05:%x[0,1]/%x[1,0]", ""]


def template_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of a template file's lines."""
    rows = event_sequences(table(spark, sf_dir, "events")).withColumn("hour", F.hour("ts").cast("string"))
    made = [sequences.macro_features(rows, t, ["label", "hour"]) for t in tag_text.read_templates(TEMPLATE_FILE)]
    return made[0].unionByName(made[1])


def round_robin_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences per fold when they are dealt out in turn."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"))
    return validation.round_robin(rows, 7).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def group_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to learn from and rows held out, by group; groups are files, numbered in order of their names."""
    path = new_path(spark, "groups")
    docs = table(spark, sf_dir, "documents")
    docs.select("lang", F.concat_ws("\t", "lang", "source").alias("value")).repartition("lang").write.partitionBy("lang").option("lineSep", "\n\n").text(path)
    rows = attribute_text.read(spark, path).withColumn("grp", F.regexp_extract("grp", "lang=([^/]*)", 1)).withColumn("seq", F.col("block"))
    learn, held = validation.split_by_group(rows.join(attribute_text.file_groups(rows), "seq"), "group", 1)
    return learn.withColumn("side", F.lit("learn")).unionByName(held.withColumn("side", F.lit("held"))).groupBy("side", "group", "label").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        instances_text, feature_list_text, toolchain_index_text, linear_chains, data_text, selected_text, file_list, operand_terms, term_order, block_colors, part_colors, branch_classes,
        edge_filter, successor_ngrams, graphlet_colorings, dot_text, coarsened_nodes, coarsened_edges, matched_pairs, coarse_drawn, prediction_labels, tagged_text, instance_text, report_text, report_text_end,
        weighted_lines, template_file, round_robin_sizes, group_holdout,
    )
}

CHAINS = """
c AS (
  SELECT lang AS bin, d.doc_id AS addr, n_chars, toxic AS label, l.doc_id IS NULL AS gap FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
), ch AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY bin ORDER BY addr) AS chain FROM c
), chains AS (SELECT bin, chain, row_number() OVER (PARTITION BY bin ORDER BY addr) - 1 AS pos, addr, label, n_chars FROM ch WHERE NOT gap)"""
_SHOWN = " ".join(f"WHEN {v} THEN ':{c}'" for v, c in blocks.LETTERS)
TERMS = f"""
t AS (
  SELECT p_partkey, p_partkey % 400 + 1 AS entry,
    CASE WHEN p_partkey % 11 = 0 THEN 65535 WHEN p_size % 4 = 0 THEN {blocks.MEMORY} WHEN p_size % 3 = 2 THEN {blocks.MANY_REGISTERS} WHEN p_size % 3 = 1 THEN p_size ELSE {blocks.IMMEDIATE} END AS arg1,
    CASE WHEN p_partkey % 11 = 0 OR p_size % 2 = 1 THEN 65535 WHEN p_partkey % 5 = 0 THEN {blocks.MEMORY} ELSE p_size % 7 END AS arg2 FROM part
)"""
BLOCKS = r"""
w AS (SELECT conv_id AS g, turn AS n, list_filter(string_split(translate(text, chr(10), ' '), ' '), lambda x: x <> '') AS w FROM conversations
), term AS (SELECT g, n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS ord, len(w) AS size FROM w
), edge AS (SELECT g, n AS src, n + k AS dst FROM w, (SELECT unnest([1, 2]) AS k) WHERE n % 4 <> 3 AND (n + k) % 5 <> 4)"""
COARSE = (
    GRAPH
    + """,
two AS (SELECT g FROM nodes WHERE n IN ('click', 'view') GROUP BY g HAVING count(*) = 2
), moved AS (
  SELECT e.g, src, dst, type, t.g IS NOT NULL AS two, CASE WHEN t.g IS NOT NULL AND src = 'view' THEN 'click' ELSE src END AS a, CASE WHEN t.g IS NOT NULL AND dst = 'view' THEN 'click' ELSE dst END AS b
  FROM edges e LEFT JOIN two t ON t.g = e.g
), marked AS (SELECT *, two AND a = 'click' AND b = 'click' AS inside FROM moved)"""
)
ONE_NODE = f"sets AS (SELECT g, n AS id, [n] AS nodes FROM nodes), {DESCRIBE}"
_POS_SEGMENTS = f"""
WITH {EVENTS}, f AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos)
), r AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY pos) AS run FROM f
), g AS (SELECT seq, run, min(label) AS label, min(pos) AS start, max(pos) AS last, count(*) AS n FROM r GROUP BY ALL
), seg AS (SELECT seq, label, start, coalesce(lead(start) OVER w, last) AS stop, sum(n) OVER w AS total FROM g WINDOW w AS (PARTITION BY seq ORDER BY run)
), rep AS (SELECT seq, start, stop, {", ".join(f"max(CASE WHEN label = '{x}' THEN total ELSE 0 END) AS {x}" for x in labelling.LABELS)} FROM seg GROUP BY ALL
), seen AS (SELECT seq, list_filter([{", ".join(f"CASE WHEN max({x}) > 0 THEN '{x}' END" for x in labelling.LABELS)}], lambda x: x IS NOT NULL) AS seen FROM rep GROUP BY seq)"""



def _matching_sql(edges: str, name: str, seed: int) -> str:
    """Pairs taken one by one in the order of their digests; graphs of up to five nodes have two at most."""
    return f"""
{name}_all AS (SELECT DISTINCT g, least(src, dst) AS a, greatest(src, dst) AS b FROM {edges} WHERE src <> dst
), {name}_h AS (SELECT *, md5(concat_ws('|', '{seed}', CAST(g AS VARCHAR), a, b)) AS h FROM {name}_all
), {name}_one AS (SELECT g, a, b FROM {name}_h QUALIFY row_number() OVER (PARTITION BY g ORDER BY h, a, b) = 1
), {name}_two AS (
  SELECT h.g, h.a, h.b FROM {name}_h h JOIN {name}_one o ON o.g = h.g AND h.a NOT IN (o.a, o.b) AND h.b NOT IN (o.a, o.b) QUALIFY row_number() OVER (PARTITION BY h.g ORDER BY h.h, h.a, h.b) = 1
), {name} AS (SELECT * FROM {name}_one UNION ALL SELECT * FROM {name}_two)"""


REPORT = f""", cells AS (
  SELECT rep.seq, start, seen, '[0x' || printf('%x', CAST(start AS BIGINT)) || ' - 0x' || printf('%x', CAST(stop AS BIGINT)) || '), ' || array_to_string(list_transform(seen, lambda x: CASE x {" ".join(f"WHEN '{x}' THEN CAST({x} AS VARCHAR)" for x in labelling.LABELS)} END), ', ') AS line
  FROM rep JOIN seen USING (seq))
SELECT seq, 'Address range, ' || array_to_string(any_value(seen), ', ') || chr(10) || string_agg(line, chr(10) ORDER BY start, line) AS value FROM cells GROUP BY seq"""

SQL = {
    "instances_text": f"WITH {LINES} SELECT lang AS bin, doc_id AS addr, tok AS feat, CAST(count(*) AS DOUBLE) AS cnt FROM tok GROUP BY ALL",
    "feature_list_text": mining.SQL["global_vocab"],
    "toolchain_index_text": mining.SQL["label_index"],
    "linear_chains": f"WITH {CHAINS} SELECT bin, chain, pos, addr, label FROM chains",
    "data_text": f"""
WITH {CHAINS}, s AS (SELECT bin, CAST(label AS VARCHAR) AS label, count(*) AS n, sum(1.0 + n_chars / 4) AS total FROM chains GROUP BY ALL), a AS (SELECT bin, count(*) AS addresses, CAST(sum(addr) AS BIGINT) AS addr_sum FROM chains GROUP BY bin)
SELECT bin, label, n, CAST(total AS DOUBLE) AS total, addresses, addr_sum FROM s JOIN a USING (bin)""",
    "selected_text": MI_SQL.rstrip()
    + """, c AS (SELECT doc_id, tok, count(*) AS cnt FROM tok GROUP BY ALL), s AS (SELECT tok, max(cnt) AS scale FROM c GROUP BY tok)
SELECT row_number() OVER (ORDER BY mi DESC, top.tok) AS feat_id, top.tok AS feat, CAST(scale AS DOUBLE) AS scale FROM top JOIN s USING (tok)""",
    "file_list": """
WITH p AS (SELECT url AS path, string_split(url, '/') AS parts FROM pages WHERE url IS NOT NULL AND rtrim(url) <> ''), k AS (SELECT *, list_position(list_transform(parts, lambda p: p IN ('en', 'de', 'fr', 'es')), true) AS k FROM p)
SELECT path, parts[-1] AS base, CASE WHEN k > 1 THEN concat_ws('_', parts[k - 1], parts[k], parts[k + 1], parts[k + 2], parts[-1]) END AS name FROM k""",
    "operand_terms": f"""
WITH {TERMS} SELECT p_partkey, CAST(arg1 AS INT) AS arg1, CAST(arg2 AS INT) AS arg2, CASE WHEN p_partkey % 7 = 0 THEN '*' ELSE printf('%x', CAST(entry AS BIGINT)) ||
  CASE arg1 WHEN 65535 THEN '' {_SHOWN} ELSE ':' || printf('%x', CAST(arg1 AS BIGINT)) END || CASE arg2 WHEN 65535 THEN '' {_SHOWN} ELSE ':' || printf('%x', CAST(arg2 AS BIGINT)) END END AS txt FROM t""",
    "term_order": f"WITH {TERMS}, d AS (SELECT DISTINCT entry, arg1, arg2 FROM t) SELECT entry, arg1, arg2, row_number() OVER (ORDER BY entry, arg1, arg2) AS nth FROM d",
    "block_colors": f"""
WITH i AS (SELECT l_orderkey AS g, l_suppkey % 3 AS n, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS ord, CASE WHEN l_partkey % 30 < 25 THEN (l_partkey % 30) % 17 ELSE {blocks.NO_CLASS} END AS class FROM lineitem)
SELECT g, n, CAST(bit_or(CAST(CASE WHEN class < {blocks.NO_CLASS} THEN 1 << CAST(class AS INT) ELSE 0 END AS INT)) AS INT) AS color, CAST(arg_max(class, ord) AS INT) AS branch FROM i GROUP BY ALL""",
    "part_colors": """
WITH r AS (SELECT l_suppkey AS g, l_orderkey AS n, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey AS ord, coalesce(p_size % 17, 15) AS class FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)
SELECT g, n, CAST(bit_or(CASE WHEN class < 15 THEN CAST(1 << CAST(class AS INT) AS INT) ELSE 0 END) AS INT) AS color, CAST(arg_max(class, ord) AS INT) AS branch FROM r GROUP BY g, n""",
    "branch_classes": f"""
WITH m AS (SELECT string_split('{",".join(MNEMONICS)}', ',') AS m)
SELECT p_partkey, m[p_size % len(m) + 1] AS mnemonic, CAST(least(p_size % len(m), 24) AS INT) AS class FROM part, m""",
    "edge_filter": f"WITH {BLOCKS} SELECT g, src, dst FROM edge",
    "successor_ngrams": f"""
WITH {BLOCKS}, step AS (
  SELECT g, n, ord, tok, n AS n2, ord + 1 AS ord2 FROM term WHERE ord + 1 < size UNION ALL SELECT t.g, n, ord, tok, dst, 0 FROM term t JOIN edge e ON e.g = t.g AND e.src = t.n WHERE ord + 1 = size
), tri AS (SELECT a.g, a.tok AS x, b.tok AS y, c.tok AS z FROM step a JOIN step b ON b.g = a.g AND b.n = a.n2 AND b.ord = a.ord2 JOIN term c ON c.g = b.g AND c.n = b.n2 AND c.ord = b.ord2
), f AS (SELECT g, unnest([x || '_' || y || '_' || z, '*_' || y || '_' || z, x || '_*_' || z, '*_*_' || z]) AS feat FROM tri)
SELECT g, feat, count(*) AS cnt FROM f GROUP BY ALL""",
    "graphlet_colorings": f"""
WITH {GRAPH}, {ONE_NODE}, branch AS (SELECT seq AS g, label AS n, CAST(floor(arg_max(value, pos) / 100) AS INT) AS color FROM ev GROUP BY ALL),
every_ AS (SELECT t.g, 'G_' || t.t || '/' || c.color AS feat FROM texts t JOIN nodes c ON c.g = t.g AND c.n = t.n UNION ALL SELECT t.g, 'B_' || t.t || '/' || c.color FROM texts t JOIN branch c ON c.g = t.g AND c.n = t.n)
SELECT g, feat, count(*) AS cnt FROM every_ GROUP BY ALL""",
    "dot_text": f"""
WITH {GRAPH}, l AS (SELECT g, 0 AS k, n AS a, '' AS b, 'n' || n || ' [label="' || color || '"] ;' AS line FROM nodes UNION ALL SELECT g, 1, src, dst, ' n' || src || ' -> n' || dst || ' ;' FROM edges)
SELECT g, 'digraph {{' || chr(10) || string_agg(line, chr(10) ORDER BY k, a, b, line) || chr(10) || '}}' AS value FROM l GROUP BY g""",
    "coarsened_nodes": f"WITH {COARSE} SELECT x.g, CASE WHEN t.g IS NOT NULL AND n = 'view' THEN 'click' ELSE n END AS n, bit_or(color) AS color FROM nodes x LEFT JOIN two t ON t.g = x.g GROUP BY ALL",
    "coarsened_edges": f"""
WITH {COARSE}, e AS (SELECT g, a AS src, b AS dst, type FROM marked WHERE NOT inside UNION ALL
  SELECT g, 'click', 'click', 0 FROM marked WHERE inside GROUP BY g HAVING bool_or(src = dst) OR count(DISTINCT src) FILTER (src <> dst) = 2)
SELECT g, src, dst, type, count(*) AS n FROM e GROUP BY ALL""",
    "prediction_labels": f"WITH {labelling.JUDGED} SELECT seq, array_to_string(list_sort(list(DISTINCT pred)), ',') AS labels FROM judged GROUP BY seq",
    "tagged_text": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus || chr(9) || l_returnflag || ':' || printf('%f', CAST(l_discount AS DOUBLE)) AS line FROM lineitem)
SELECT l_orderkey AS seq, '@probability' || chr(9) || '0.500000' || chr(10) || string_agg(line, chr(10) ORDER BY l_linenumber, line) || chr(10) AS value FROM l GROUP BY l_orderkey""",
    "instance_text": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_linestatus || chr(9) || 'q' || l_linenumber || ':' || printf('%f', CAST(l_quantity AS DOUBLE)) AS line FROM lineitem)
SELECT l_orderkey AS seq, string_agg(line, chr(10) ORDER BY l_linenumber, line) || chr(10) AS value FROM l GROUP BY l_orderkey""",
    "report_text": _POS_SEGMENTS + REPORT,
    "report_text_end": _POS_SEGMENTS.replace("coalesce(lead(start) OVER w, last)", "coalesce(lead(start) OVER w, last // 8 * 8 + 8)") + REPORT,
    "matched_pairs": f"WITH {GRAPH}, {_matching_sql('edges', 'm', 0)} SELECT g, a, b FROM m",
    "coarse_drawn": f"""
WITH {GRAPH}, {_matching_sql("edges", "m", 0)}, to1 AS (SELECT n.g, n.n, coalesce(m.a, n.n) AS t, color FROM nodes n LEFT JOIN m ON m.g = n.g AND m.b = n.n
), edges1 AS (SELECT e.g, s.t AS src, d.t AS dst FROM edges e JOIN to1 s ON s.g = e.g AND s.n = e.src JOIN to1 d ON d.g = e.g AND d.n = e.dst
), {_matching_sql("edges1", "k", 1)}
SELECT o.g, coalesce(k.a, o.t) AS n, bit_or(color) AS color FROM to1 o LEFT JOIN k ON k.g = o.g AND k.b = o.t GROUP BY ALL""",
    "weighted_lines": "SELECT doc_id, lang AS label, unnest([0, 1, 2]) AS nth, unnest([source, 'plain', 'a:b']) AS attr, unnest([CAST(n_chars AS DOUBLE), 1.0, 2.5]) AS value FROM documents",
    "template_file": f"""
WITH {EVENTS}, w AS (SELECT seq, pos, coalesce(lag(label) OVER w, '') AS a, CAST(hour(ts) AS VARCHAR) AS h, coalesce(lead(label) OVER w, '') AS c FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos))
SELECT seq, pos, 'U00=' || a AS feat FROM w UNION ALL SELECT seq, pos, 'U05=' || h || '/' || c FROM w""",
    "round_robin_sizes": "SELECT CAST(k AS INT) AS fold, n // 7 + CASE WHEN k < n % 7 THEN 1 ELSE 0 END AS n FROM (SELECT count(DISTINCT o_orderkey) AS n FROM orders), (SELECT unnest(range(7)) AS k)",
    "group_holdout": """
WITH g AS (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS "group" FROM (SELECT DISTINCT lang FROM documents))
SELECT CASE WHEN "group" = 1 THEN 'held' ELSE 'learn' END AS side, CAST("group" AS INT) AS "group", lang AS label, count(*) AS n FROM documents JOIN g USING (lang) GROUP BY ALL""",
}
