"""Queries of feature mining: n-grams, dictionaries, selection, graphlets, token observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import tokens as T
from seqloom.operators import dictionary, families, graphlets, ngrams
from seqloom.sources.adapters import document_tokens, event_edges, event_nodes, event_sequences, table, token_lines
from seqloom.sources.staging import staged

#: Features kept by selection.
KEEP = 50

# -- shared SQL of the adapters

LINES = r"""
lines AS (
  SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents
), words AS (
  SELECT doc_id, lang, line, list_filter(string_split(body, ' '), lambda w: w <> '') AS w FROM lines
), tok AS (
  SELECT doc_id, lang, line, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS ord FROM words
)"""
EVENTS = """
ev AS (
  SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, event_type AS label, value, ts, event_id FROM events
)"""
GRAPH = (
    EVENTS
    + """,
steps AS (
  SELECT seq AS g, lag(label) OVER w AS src, label AS dst, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 2 END AS type FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos)
), edges AS (SELECT DISTINCT * FROM steps WHERE src IS NOT NULL
), nodes AS (
  SELECT seq AS g, label AS n, bit_or(CAST(1 << CAST(floor(hour(ts) / 6) AS INT) AS INT)) AS color FROM ev GROUP BY ALL
)"""
)
#: Turns ``sets`` (g, id, nodes) into described and counted texts.
DESCRIBE = """
every AS (SELECT g, id, unnest(nodes) AS n, nodes FROM sets
), ends AS (
  SELECT e.g, e.id, e.n, CASE WHEN x.src = x.dst THEN 2 WHEN x.src = e.n THEN 1 ELSE 0 END AS role, x.type
  FROM every e JOIN edges x ON x.g = e.g AND (x.src = e.n OR x.dst = e.n) AND list_contains(e.nodes, x.src) AND list_contains(e.nodes, x.dst)
), runs AS (
  SELECT g, id, n, role, string_agg(type || CASE WHEN c > 1 THEN 'x' || c ELSE '' END, ',' ORDER BY type) AS t
  FROM (SELECT g, id, n, role, type, count(*) AS c FROM ends GROUP BY ALL) GROUP BY ALL
), types AS (SELECT g, id, n, role, list(type ORDER BY type) AS l FROM ends GROUP BY ALL
), texts AS (
  SELECT e.g, e.id, e.n, coalesce(max(t) FILTER (r.role = 0), '') || '/' || coalesce(max(t) FILTER (r.role = 1), '') || '/' || coalesce(max(t) FILTER (r.role = 2), '') AS t, '' AS c,
         coalesce(any_value(l) FILTER (r.role = 0), []) AS i, coalesce(any_value(l) FILTER (r.role = 1), []) AS o, coalesce(any_value(l) FILTER (r.role = 2), []) AS s
  FROM every e LEFT JOIN runs r ON r.g = e.g AND r.id = e.id AND r.n = e.n LEFT JOIN types p ON p.g = r.g AND p.id = r.id AND p.n = r.n AND p.role = r.role GROUP BY ALL
)"""
COUNT_TEXTS = """
SELECT g, feat, count(*) AS cnt FROM (SELECT g, id, string_agg(t, '_' ORDER BY c, len(i), i, len(o), o, len(s), s, t) AS feat FROM texts GROUP BY ALL) GROUP BY ALL"""

# -- n-grams


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents dealt out by id: their words and n-grams then are counted where they arise, and texts travel instead of several times their n-grams."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def idiom_size1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.document_ngram_counts(table(spark, sf_dir, "documents"), 1)


def idiom_size2_wild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.document_ngram_counts(table(spark, sf_dir, "documents"), 2)


def idiom_size2_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As idiom_size2_wild, by a table function that SQL calls. Lines are parted by null, which no n-gram holds."""
    families.register(spark, "wildcard_ngrams", families.WildcardNgrams)
    parts = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" \n ")), " ", -1), lambda w: w != "")
    held = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.transform(parts, lambda w: F.nullif(w, F.lit("\n"))).alias("words"))
    return families.count_features(held, "wildcard_ngrams", "doc_id", "words", size=2)


def idiom_size3_wild(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.document_ngram_counts(table(spark, sf_dir, "documents"), 3)


def cross_block_bigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.cross_block_bigrams(token_lines(_dealt(spark, sf_dir)))


def operand_bigram_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.distance_bigrams(token_lines(table(spark, sf_dir, "documents")), 1)


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opcodes and arguments out of the part table; some arguments are missing."""
    part = table(spark, sf_dir, "part")
    none = F.lit(ngrams.NO_ARGUMENT)
    return part.select(
        "p_partkey",
        (F.col("p_partkey") % 40000 + 1).alias("entry"),
        F.when(F.col("p_size") % 5 == 0, none).otherwise(F.col("p_size")).alias("arg1"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size") + 7).otherwise(none).alias("arg2"),
    )


def idiom_pack_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = _parts(spark, sf_dir).withColumn("packed", ngrams.pack(F.col("entry"), F.col("arg1"), F.col("arg2")))
    return packed.select("p_partkey", "packed", ngrams.pack_text(F.col("packed")).alias("txt"))


def idiom_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = idiom_pack_format(spark, sf_dir)
    entry, arg1, arg2 = ngrams.unpack_text(F.col("txt"))
    return held.select("p_partkey", entry.alias("entry"), arg1.alias("arg1"), arg2.alias("arg2"))


PACKED = """
p AS (
  SELECT p_partkey, p_partkey % 40000 + 1 AS entry, CAST(CASE WHEN p_size % 5 = 0 THEN 65535 ELSE p_size END AS BIGINT) AS arg1, CAST(CASE WHEN p_size % 3 = 0 THEN p_size + 7 ELSE 65535 END AS BIGINT) AS arg2 FROM part
), k AS (
  SELECT *, entry * 4294967296 + arg1 * 65536 + arg2 AS packed FROM p
)"""

def token_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as terms: the number of a word for an opcode, its length where it has a capital, one more where it ends a sentence."""
    n, none = F.length("tok"), F.lit(ngrams.NO_ARGUMENT)
    entry, arg1, arg2 = F.col("feat_id") % 40000 + 1, F.when(F.col("tok").rlike("[A-Z]"), n).otherwise(none), F.when(F.col("tok").rlike("[.!?]$"), n + 1).otherwise(none)
    packed = global_vocab(spark, sf_dir).select("feat_id", ngrams.pack(entry, arg1, arg2).alias("packed"))
    back = ngrams.unpack_text(ngrams.pack_text(F.col("packed")))
    return packed.select("feat_id", "packed", ngrams.pack_text(F.col("packed")).alias("txt"), *(c.alias(name) for c, name in zip(back, ("entry", "arg1", "arg2"))))


# -- dictionaries and selection


def global_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.first_seen_vocab(table(spark, sf_dir, "documents"))


def label_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "documents").groupBy("lang").agg(F.min("doc_id").alias("f"))
    return dictionary.dense_ids(first, ["f", "lang"], "label_id").select("lang", "label_id")


def presence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.presence_counts(document_tokens(table(spark, sf_dir, "documents"), "lang"), "lang")


def mi_topk_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = document_tokens(table(spark, sf_dir, "documents"), "lang")
    return dictionary.top_features(dictionary.mutual_information(held, "lang"), KEEP)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idiom_size1(spark, sf_dir)


def feature_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary.scales(_counts(spark, sf_dir))


def scaled_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the selected tokens over their greatest; tokens are counted once, for the selection and the instances."""
    return _scaled(table(spark, sf_dir, "documents"), mi_topk_tokens(spark, sf_dir))


def _scaled(docs: DataFrame, top: DataFrame) -> DataFrame:
    top = top.select(F.col("tok").alias("feat"))  # KEEP rows, so they are broadcast before counting
    lines = token_lines(docs.select("doc_id", "text").repartition("doc_id"))
    words = lines.select("doc_id", F.explode("words").alias("feat")).join(F.broadcast(top), "feat", "left_semi")
    counts = words.groupBy("doc_id", "feat").agg(F.count(F.lit(1)).alias("cnt"))
    return dictionary.scaled(counts, F.broadcast(dictionary.scales(counts))).withColumn("value", F.round("value", 6))


def sparse_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with selected words as sparse arrays in the order of the words' numbers."""
    top = staged(mi_topk_tokens(spark, sf_dir), "top")
    held = _scaled(table(spark, sf_dir, "documents"), top)
    ids = dictionary.dense_ids(top.select(F.col("tok").alias("feat")), ["feat"], "feat_id")
    found = dictionary.instances(held, F.broadcast(ids))  # KEEP rows
    numbers = F.array_join(F.transform("feats", lambda f: f["feat_id"].cast("string")), " ")
    return found.select("doc_id", numbers.alias("ids"), F.aggregate("feats", F.lit(0).cast("long"), lambda a, f: a + F.round(f["value"] * 1_000_000).cast("long")).alias("millionths"))


def instance_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of sizes 1 and 2 in one instance per document: number of features and their total."""
    texts = table(spark, sf_dir, "documents").where("text is not null").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return ngrams.gram_totals(texts, (1, 2))


def unknown_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct tokens of every document that the labelled documents lack, counted by document."""
    docs = table(spark, sf_dir, "documents")
    rows = document_tokens(docs).select("doc_id", F.explode(F.array_distinct("words")).alias("tok"))
    known = rows.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_semi").select("tok").distinct()
    found = rows.join(known, "tok", "left_anti").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_unknown"))


def linkage_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti")


#: Path parts that hold the place of known compilers in a toolchain path.
KNOWN_LANGS = ("en", "de", "fr", "es")


def path_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part before and after the first known part of each url's path, and their joined label."""
    parts = F.split("url", "/", -1)
    at = F.array_position(F.transform(parts, lambda p: p.isin(*KNOWN_LANGS)), True)
    held = table(spark, sf_dir, "pages").select("page_id", parts.alias("parts"), at.cast("int").alias("k")).where("k > 1")
    return held.select(
        "page_id",
        F.element_at("parts", F.col("k") - 1).alias("project"),
        F.element_at("parts", F.col("k")).alias("lang"),
        F.try_element_at("parts", F.col("k") + 1).alias("leaf"),
        F.concat_ws("-", F.element_at("parts", F.col("k")), F.try_element_at("parts", F.col("k") + 1)).alias("label"),
    )


# -- token observations


def _token_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = document_tokens(table(spark, sf_dir, "documents"))
    return words.select(F.explode(F.array_distinct("words")).alias("tok")).distinct()


def token_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_types(spark, sf_dir).withColumn("shape", T.shape(F.col("tok"))).withColumn("shaped", T.degenerate(F.col("shape")))


def token_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_types(spark, sf_dir).withColumn("type", T.token_type(F.col("tok")))


def token_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _token_types(spark, sf_dir).select("tok", *(T.flag(F.col("tok"), name).alias(name) for name in T.FLAGS))


def affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    tok = F.col("tok")
    found = [T.prefix(tok, n).alias(f"p{n}") for n in (1, 2, 3, 4)] + [T.suffix(tok, n).alias(f"s{n}") for n in (1, 2, 3, 4)]
    return _token_types(spark, sf_dir).select("tok", *found, T.escape_attribute(tok).alias("escaped"))


TOKEN_TYPES = f"WITH {LINES}, types AS (SELECT DISTINCT tok FROM tok) "

# -- graphs


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_sequences(table(spark, sf_dir, "events"))
    return event_nodes(rows), event_edges(rows)


def node_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user and event type: the bits of the day's quarters, and the value of the last event."""
    rows = event_sequences(table(spark, sf_dir, "events"))
    last = rows.groupBy(F.col("seq").alias("g"), F.col("label").alias("n")).agg(F.max_by("value", "pos").alias("last_value"))
    return event_nodes(rows).join(last, ["g", "n"])


def graphlet1(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graphlets.describe(graphlets.singles(nodes), edges, nodes)


def graphlet2(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _graph(spark, sf_dir)
    return graphlets.describe(graphlets.pairs(edges), edges)


def graphlet3(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _graph(spark, sf_dir)
    return graphlets.describe(graphlets.triples(edges), edges)


def graphlet4(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graphlets.describe(graphlets.connected_sets(nodes, edges, 4), edges)


def graphlet5(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return graphlets.describe(graphlets.connected_sets(nodes, edges, 5), edges)


QUERIES = {
    f.__name__: f
    for f in (
        mi_topk_tokens, presence_counts, idiom_size1, idiom_size2_wild, idiom_size2_family, idiom_size3_wild, cross_block_bigram, operand_bigram_dist, idiom_pack_format, idiom_decode, token_terms,
        global_vocab, label_index, feature_scale, scaled_instances, sparse_instances, instance_union, unknown_filter, linkage_anti, path_label,
        token_shape, token_type, token_flags, affixes, node_colors, graphlet1, graphlet2, graphlet3, graphlet4, graphlet5,
    )
}

MI_SQL = f"""
WITH {LINES}, dt AS (SELECT DISTINCT doc_id, lang, tok FROM tok
), n AS (SELECT count(*) AS n FROM documents
), pl AS (SELECT lang, count(*) / (SELECT n FROM n) AS pl FROM documents GROUP BY lang
), pf AS (SELECT tok, count(*) / (SELECT n FROM n) AS pf FROM dt GROUP BY tok
), j AS (SELECT tok, lang, count(*) / (SELECT n FROM n) AS pj FROM dt GROUP BY ALL
), grid AS (SELECT pf.tok, pl.pl, pf.pf, coalesce(j.pj, 0.0) AS pj FROM pf CROSS JOIN pl LEFT JOIN j ON j.tok = pf.tok AND j.lang = pl.lang
), mi AS (
  SELECT tok, round(sum(CASE WHEN abs(pj) < 1e-7 THEN 0 ELSE pj * ln(pj / pl / pf) END + CASE WHEN abs(pl - pj) < 1e-7 THEN 0 ELSE (pl - pj) * ln((pl - pj) / pl / (1 - pf)) END), 6) AS mi FROM grid GROUP BY tok
), top AS (SELECT tok, mi FROM mi ORDER BY mi DESC, tok DESC LIMIT {KEEP})
"""


def _ngram_sql(size: int) -> str:
    terms = [f"lead(tok, {k}) OVER (PARTITION BY doc_id, line ORDER BY ord) AS t{k}" for k in range(1, size)]
    masks = [[]]
    for k in range(size - 1):
        masks = [m + [x] for m in masks for x in (f"t{k}", "'*'")]
    feats = ", ".join(" || '_' || ".join([*m, f"t{size - 1}"]) for m in masks)
    return f"""
WITH {LINES}, g AS (SELECT doc_id, {", ".join(["tok AS t0", *terms])} FROM tok),
f AS (SELECT doc_id, unnest([{feats}]) AS feat FROM g WHERE t{size - 1} IS NOT NULL)
SELECT doc_id, feat, count(*) AS cnt FROM f GROUP BY ALL"""


def _type_sql() -> str:
    return " ".join(f"WHEN regexp_matches(tok, '{p}') THEN '{n}'" for n, p in T.TYPES)


SQL = {
    "mi_topk_tokens": MI_SQL + "SELECT tok, mi FROM top",
    "presence_counts": f"""
WITH {LINES}, dt AS (SELECT DISTINCT doc_id, lang, tok FROM tok)
SELECT tok, lang AS label, count(*) AS n FROM dt GROUP BY GROUPING SETS ((tok), (tok, lang))
UNION ALL SELECT NULL, lang, count(*) FROM documents GROUP BY GROUPING SETS ((lang), ())""",
    "idiom_size1": _ngram_sql(1),
    "idiom_size2_wild": _ngram_sql(2),
    "idiom_size2_family": _ngram_sql(2),
    "idiom_size3_wild": _ngram_sql(3),
    "cross_block_bigram": f"""
WITH {LINES}, e AS (SELECT doc_id, w[-1] AS a, lead(w[1]) OVER (PARTITION BY doc_id ORDER BY line) AS b FROM words)
SELECT doc_id, a || '_' || b AS feat, count(*) AS cnt FROM e WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL""",
    "operand_bigram_dist": f"""
WITH {LINES}, e AS (SELECT tok AS a, lead(tok, 2) OVER (PARTITION BY doc_id, line ORDER BY ord) AS b FROM tok)
SELECT a || '_*1_' || b AS feat, count(*) AS cnt FROM e WHERE b IS NOT NULL GROUP BY ALL""",
    "idiom_pack_format": f"""
WITH {PACKED}, s AS (SELECT *, CASE WHEN arg2 = 65535 THEN CASE WHEN arg1 = 65535 THEN entry ELSE entry * 65536 + arg1 END ELSE packed END AS v FROM k)
SELECT p_partkey, CAST(packed AS BIGINT) AS packed, 'I' || printf('%x', CAST(v AS BIGINT)) AS txt FROM s""",
    # an opcode of less than four hex digits with one argument reads the same as a longer opcode without
    "idiom_decode": f"""
WITH {PACKED}, s AS (SELECT *, printf('%x', CAST(CASE WHEN arg2 = 65535 THEN CASE WHEN arg1 = 65535 THEN entry ELSE entry * 65536 + arg1 END ELSE packed END AS BIGINT)) AS h FROM k),
v AS (SELECT p_partkey, length(h) AS n, CAST(CASE WHEN arg2 = 65535 THEN CASE WHEN arg1 = 65535 THEN entry ELSE entry * 65536 + arg1 END ELSE packed END AS BIGINT) AS x FROM s)
SELECT p_partkey, CASE WHEN n <= 4 THEN x WHEN n <= 8 THEN x >> 16 ELSE x >> 32 END AS entry,
       CASE WHEN n <= 4 THEN 65535 WHEN n <= 8 THEN x & 65535 ELSE (x >> 16) & 65535 END AS arg1, CASE WHEN n <= 8 THEN 65535 ELSE x & 65535 END AS arg2 FROM v""",
    "global_vocab": f"""
WITH {LINES}, f AS (SELECT tok, min(ROW(doc_id, line, ord)) AS k FROM tok GROUP BY tok)
SELECT tok, row_number() OVER (ORDER BY k, tok) AS feat_id FROM f""",
    "label_index": "SELECT lang, row_number() OVER (ORDER BY min(doc_id), lang) AS label_id FROM documents GROUP BY lang",
    "feature_scale": f"WITH {LINES}, c AS (SELECT doc_id, tok, count(*) AS cnt FROM tok GROUP BY ALL) SELECT tok AS feat, max(cnt) AS scale FROM c GROUP BY tok",
    "scaled_instances": MI_SQL.rstrip()
    + """, c AS (SELECT doc_id, tok, count(*) AS cnt FROM tok GROUP BY ALL), s AS (SELECT tok, max(cnt) AS scale FROM c GROUP BY tok)
SELECT doc_id, c.tok AS feat, round(cnt / scale, 6) AS value FROM c JOIN top USING (tok) JOIN s USING (tok)""",
    "sparse_instances": MI_SQL.rstrip()
    + """, c AS (SELECT doc_id, tok, count(*) AS cnt FROM tok GROUP BY ALL), s AS (SELECT tok, max(cnt) AS scale FROM c GROUP BY tok
), i AS (SELECT tok, row_number() OVER (ORDER BY tok) AS id FROM top), v AS (SELECT doc_id, id, round(cnt / scale, 6) AS value FROM c JOIN i USING (tok) JOIN s USING (tok))
SELECT doc_id, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY id) AS ids, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS millionths FROM v GROUP BY doc_id""",
    "token_terms": f"""
WITH {LINES}, f AS (SELECT tok, min(ROW(doc_id, line, ord)) AS k FROM tok GROUP BY tok), v AS (SELECT tok, row_number() OVER (ORDER BY k, tok) AS feat_id FROM f),
p AS (SELECT feat_id, feat_id % 40000 + 1 AS e, CASE WHEN regexp_matches(tok, '[A-Z]') THEN length(tok) ELSE 65535 END AS a, CASE WHEN regexp_matches(tok, '[.!?]$') THEN length(tok) + 1 ELSE 65535 END AS b FROM v),
s AS (SELECT *, e * 4294967296 + a * 65536 + b AS packed FROM p), x AS (SELECT *, printf('%x', CAST(CASE WHEN b = 65535 THEN CASE WHEN a = 65535 THEN e ELSE e * 65536 + a END ELSE packed END AS BIGINT)) AS h FROM s)
SELECT feat_id, CAST(packed AS BIGINT) AS packed, 'I' || h AS txt, CASE WHEN length(h) <= 4 THEN CAST('0x' || h AS BIGINT) WHEN length(h) <= 8 THEN CAST('0x' || h AS BIGINT) >> 16 ELSE e END AS entry,
       CASE WHEN length(h) <= 4 THEN 65535 WHEN length(h) <= 8 THEN CAST('0x' || h AS BIGINT) & 65535 ELSE a END AS arg1, CASE WHEN length(h) <= 8 THEN 65535 ELSE b END AS arg2 FROM x""",
    "instance_union": f"""
WITH a AS ({_ngram_sql(1)}), b AS ({_ngram_sql(2)})
SELECT doc_id, count(*) AS n_feats, CAST(sum(cnt) AS BIGINT) AS total FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id""",
    "unknown_filter": f"""
WITH {LINES}, d AS (SELECT DISTINCT doc_id, tok FROM tok)
SELECT a.doc_id, coalesce(n, 0) AS n_unknown FROM documents a LEFT JOIN (
  SELECT doc_id, count(*) AS n FROM d WHERE tok NOT IN (SELECT tok FROM d WHERE doc_id IN (SELECT doc_id FROM labels)) GROUP BY doc_id) b ON a.doc_id = b.doc_id""",
    "linkage_anti": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "path_label": """
WITH p AS (SELECT page_id, string_split(url, '/') AS parts FROM pages), k AS (SELECT *, list_position(list_transform(parts, lambda p: p IN ('en', 'de', 'fr', 'es')), true) AS k FROM p)
SELECT page_id, parts[k - 1] AS project, parts[k] AS lang, parts[k + 1] AS leaf, concat_ws('-', parts[k], parts[k + 1]) AS label FROM k WHERE k > 1""",
    "token_shape": TOKEN_TYPES
    + f""", s AS (SELECT tok, translate(tok, '{T.SHAPE_FROM}', '{T.SHAPE_TO}') AS shape FROM types)
SELECT tok, shape, array_to_string(list_transform(list_filter(list_zip(string_split(shape, ''), list_concat([''], string_split(shape, '')[:-2])), lambda z: z[1] <> z[2]), lambda z: z[1]), '') AS shaped FROM s""",
    "token_type": TOKEN_TYPES + f"SELECT tok, CASE WHEN tok = '' THEN 'EMPTY' {_type_sql()} ELSE 'NO' END AS type FROM types",
    "token_flags": TOKEN_TYPES + "SELECT tok, " + ", ".join(f"CASE WHEN regexp_matches(tok, '{p}', 's') THEN 'yes' ELSE 'no' END AS {n}" for n, p in T.FLAGS.items()) + " FROM types",
    "affixes": TOKEN_TYPES
    + "SELECT tok, "
    + ", ".join([f"CASE WHEN length(tok) >= {n} THEN left(tok, {n}) ELSE '' END AS p{n}, CASE WHEN length(tok) >= {n} THEN right(tok, {n}) ELSE '' END AS s{n}" for n in (1, 2, 3, 4)])
    + ", replace(tok, ':', '__COLON__') AS escaped FROM types",
    "node_colors": f"WITH {GRAPH}, l AS (SELECT seq AS g, label AS n, arg_max(value, pos) AS last_value FROM ev GROUP BY ALL) SELECT g, n, color, last_value FROM nodes JOIN l USING (g, n)",
    "graphlet1": f"WITH {GRAPH}, sets AS (SELECT g, n AS id, [n] AS nodes FROM nodes), {DESCRIBE}, colored AS (SELECT t.g, t.id, t.t || '/' || c.color AS t, CAST(c.color AS VARCHAR) AS c, i, o, s FROM texts t JOIN nodes c ON c.g = t.g AND c.n = t.n)"
    + COUNT_TEXTS.replace("FROM texts", "FROM colored"),
    "graphlet2": f"WITH {GRAPH}, sets AS (SELECT DISTINCT g, src || '>' || dst AS id, [src, dst] AS nodes FROM edges WHERE src <> dst), {DESCRIBE}" + COUNT_TEXTS,
    "graphlet3": f"""WITH {GRAPH}, d AS (SELECT DISTINCT g, src, dst FROM edges WHERE src <> dst), trip AS (
  SELECT a.g, 'ss' AS kind, a.dst AS c, a.src AS a, b.src AS b FROM d a JOIN d b ON a.g = b.g AND a.dst = b.dst AND a.src < b.src
  UNION ALL SELECT a.g, 'tt', a.src, a.dst, b.dst FROM d a JOIN d b ON a.g = b.g AND a.src = b.src AND a.dst < b.dst
  UNION ALL SELECT a.g, 'st', a.dst, a.src, b.dst FROM d a JOIN d b ON a.g = b.g AND a.dst = b.src AND a.src <> b.dst
), sets AS (SELECT g, concat_ws('>', kind, c, a, b) AS id, [c, a, b] AS nodes FROM trip), {DESCRIBE}"""
    + COUNT_TEXTS,
    "graphlet4": f"""WITH {GRAPH}, u AS (SELECT DISTINCT g, src AS x, dst AS y FROM edges WHERE src <> dst UNION SELECT DISTINCT g, dst, src FROM edges WHERE src <> dst),
four AS (SELECT a.g, a.n AS a, b.n AS b, c.n AS c, d.n AS d FROM nodes a JOIN nodes b ON a.g = b.g AND a.n < b.n JOIN nodes c ON c.g = b.g AND b.n < c.n JOIN nodes d ON d.g = c.g AND c.n < d.n),
inner_ AS (SELECT f.g, f.a, f.b, f.c, f.d, u.x, u.y FROM four f JOIN u ON u.g = f.g AND u.x IN (f.a, f.b, f.c, f.d) AND u.y IN (f.a, f.b, f.c, f.d) AND u.x < u.y),
-- four nodes hang together with 4 edges and more of which none is alone, or with 3 that are no triangle
deg AS (SELECT g, a, b, c, d, count(*) AS m, list_distinct(list_concat(list(x), list(y))) AS seen FROM inner_ GROUP BY ALL),
sets AS (SELECT g, concat_ws('>', a, b, c, d) AS id, [a, b, c, d] AS nodes FROM deg WHERE m >= 3 AND len(seen) = 4), {DESCRIBE}"""
    + COUNT_TEXTS,
    "graphlet5": f"""WITH RECURSIVE {GRAPH}, u AS (SELECT DISTINCT g, src AS x, dst AS y FROM edges WHERE src <> dst UNION SELECT DISTINCT g, dst, src FROM edges WHERE src <> dst),
five AS (SELECT a.g, [a.n, b.n, c.n, d.n, e.n] AS nodes FROM nodes a JOIN nodes b ON a.g = b.g AND a.n < b.n JOIN nodes c ON c.g = b.g AND b.n < c.n JOIN nodes d ON d.g = c.g AND c.n < d.n JOIN nodes e ON e.g = d.g AND d.n < e.n),
reach AS (SELECT g, nodes, nodes[1] AS n FROM five UNION SELECT r.g, r.nodes, u.y FROM reach r JOIN u ON u.g = r.g AND u.x = r.n AND list_contains(r.nodes, u.y)),
sets AS (SELECT g, array_to_string(nodes, '>') AS id, nodes FROM reach GROUP BY g, nodes HAVING count(*) = 5), {DESCRIBE}"""
    + COUNT_TEXTS,
}
