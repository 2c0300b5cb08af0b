"""Queries over labelled sequences: runs, chains, transitions, templates, evaluation, lattices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import lattice, semirings
from seqloom.operators import dictionary, evaluation, sequences
from seqloom.plans.mining import EVENTS, LINES
from seqloom.sources.adapters import document_tokens, event_sequences, table, turn_sequences

#: Event types, in the order of their label ids.
LABELS = ["click", "error", "purchase", "signup", "view"]
MINFREQ = 3

TURNS = """
turns AS (
  SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS label, text FROM conversations
)"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_sequences(table(spark, sf_dir, "events"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_sequences(table(spark, sf_dir, "conversations"))


def chain_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.chains(table(spark, sf_dir, "labels"), "doc_id")


def rle_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.segments(_events(spark, sf_dir))


def segment_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.segment_report(rle_segments(spark, sf_dir), LABELS)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.transitions(_events(spark, sf_dir))


def all_pairs_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between the roles of conversations, with those that never happen."""
    rows = _turns(spark, sf_dir)
    return sequences.all_transitions(rows, sequences.transitions(rows))


def state_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.state_features(document_tokens(table(spark, sf_dir, "documents"), "lang"), "lang", MINFREQ)


def all_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 most frequent tokens with every language, 0 where they do not meet."""
    docs = document_tokens(table(spark, sf_dir, "documents"), "lang")
    freq = sequences.state_features(docs, "lang", 1)
    top = freq.groupBy("tok").agg(F.sum("freq").alias("all_freq")).orderBy(F.desc("all_freq"), "tok").limit(50).select("tok")
    grid = top.crossJoin(docs.select(F.col("lang").alias("label")).distinct())
    return grid.join(freq, ["tok", "label"], "left").select("tok", "label", F.coalesce("freq", F.lit(0)).alias("freq"))


def feature_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from 0 by (type, src, dst): state features of event values with labels (0), then transitions (1)."""
    rows = _events(spark, sf_dir).withColumn("attr", F.concat(F.lit("v"), F.floor(F.col("value") / 50).cast("string")))
    states = rows.groupBy(F.lit(0).alias("type"), F.col("attr").alias("src"), F.col("label").alias("dst")).agg(F.count(F.lit(1)).alias("freq"))
    moves = sequences.transitions(rows).select(F.lit(1).alias("type"), F.col("prev").alias("src"), F.col("cur").alias("dst"), F.col("n").alias("freq"))
    return dictionary.dense_ids(states.unionByName(moves), ["type", "src", "dst"], "fid", start=0)


TEMPLATES = [(("label", -2),), (("label", -1),), (("label", 1),), (("label", -1), ("hour", 0)), (("label", -2), ("label", -1))]


def template_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("hour", F.hour("ts").cast("string"))
    return sequences.template_features(rows, TEMPLATES)


def template_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir).withColumn("hour", F.hour("ts").cast("string"))
    return sequences.macro_features(rows, "U05:%x[-1,0]/%x[0,1]/%x[1,0]", ["label", "hour"])


def disjunctive_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    return sequences.disjunctive(rows, -4, -1).unionByName(sequences.disjunctive(rows, 1, 4))


def bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.boundary_marks(_turns(spark, sf_dir))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    per_seq = rows.groupBy("seq").agg(F.count(F.lit(1)).alias("items"))
    sizes = per_seq.agg(F.count(F.lit(1)).alias("instances"), F.sum("items").alias("items"), F.max("items").alias("max_length"))
    return sizes.crossJoin(rows.agg(F.countDistinct("label").alias("labels"), F.countDistinct(F.floor(F.col("value") / 50)).alias("attributes")))


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as items: the status is the reference (unknown at the greatest quantity), a guess from the flag the prediction."""
    guess = F.when(F.col("l_returnflag") == "R", "F").when(F.col("l_returnflag") == "A", "O").otherwise(F.col("l_linestatus"))
    known = F.when(F.col("l_quantity") < 49, F.col("l_linestatus"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_linenumber").alias("pos"), guess.alias("pred"), known.alias("ref"))


def _statuses(spark: SparkSession) -> DataFrame:
    # one that is never seen counts in the averages
    return spark.createDataFrame([("F",), ("O",), ("P",)], "label string")


def eval_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.by_label(_judged(spark, sf_dir), _statuses(spark))
    return found.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


def eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluation.overall(_judged(spark, sf_dir), _statuses(spark))
    return found.withColumns({c: F.round(c, 9) for c in ("macro_precision", "macro_recall", "macro_f1", "item_accuracy", "instance_accuracy")})


def hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.mismatches(_judged(spark, sf_dir))


def kfold_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", sequences.fold(F.col("o_orderkey"), 5).alias("fold"))


def rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences.rank_shares(_events(spark, sf_dir), 3).withColumn("share", F.round("share", 9))


# -- lattices: whole-number scores, so that sums are exact in any engine

TRANS = [[float((i * 5 + j * 3) % 7) for j in range(5)] for i in range(5)]


def state_score(value: Column, j: int) -> Column:
    return F.pmod(F.floor(value).cast("long") * 7 + j * 3, F.lit(10)).cast("double")


def _lattices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, states``: one row of label scores per event."""
    rows = _events(spark, sf_dir).groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("items"))
    return rows.select("seq", F.transform("items", lambda x: F.array(*(state_score(x["value"], j) for j in range(5)))).alias("states"))


def path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of the events' own labels: state and transition scores."""
    w = Window.partitionBy("seq").orderBy("pos")
    rows = _events(spark, sf_dir).withColumn("y", F.array_position(F.array(*map(F.lit, LABELS)), F.col("label")) - 1)
    prev = F.lag("y").over(w)
    state = F.pmod(F.floor("value").cast("long") * 7 + F.col("y") * 3, F.lit(10))
    step = F.coalesce(F.pmod(prev * 5 + F.col("y") * 3, F.lit(7)), F.lit(0))
    return rows.select("seq", (state + step).alias("s")).groupBy("seq").agg(F.sum("s").cast("double").alias("score"))


def viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lattices(spark, sf_dir).select("seq", lattice.viterbi(F.col("states"), TRANS).alias("v")).select("seq", "v.score", "v.path")


def forward_lognorm(spark: SparkSession, sf_dir: str) -> DataFrame:
    tenth = F.transform("states", lambda r: F.transform(r, lambda x: x / 10))
    soft = [[x / 10 for x in row] for row in TRANS]
    return _lattices(spark, sf_dir).select("seq", F.round(lattice.log_norm(tenth, soft), 6).alias("log_norm"))


def _walked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``seq, states, ahead, behind``: lattices of a tenth of the scores, with sums of the ways to and from every label."""
    tenth = _lattices(spark, sf_dir).select("seq", F.transform("states", lambda r: F.transform(r, lambda x: x / 10)).alias("states"))
    ring = semirings.LogSum()
    return tenth.select("seq", "states", semirings.forward(F.col("states"), SOFT, ring).alias("ahead"), semirings.backward(F.col("states"), SOFT, ring).alias("behind"))


SOFT = [[x / 10 for x in row] for row in TRANS]


def lattice_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each label of each item."""
    rows = _walked(spark, sf_dir).select("seq", F.posexplode(semirings.node_marginals(F.col("ahead"), F.col("behind"))).alias("pos", "p"))
    return rows.select("seq", "pos", F.posexplode("p").alias("y", "p")).withColumn("p", F.round("p", 6))


def lattice_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each pair of labels of successive items."""
    rows = _walked(spark, sf_dir).select("seq", F.posexplode(semirings.edge_marginals(F.col("states"), SOFT, F.col("ahead"), F.col("behind"))).alias("pos", "p"))
    rows = rows.select("seq", "pos", F.posexplode("p").alias("y", "p"))
    return rows.select("seq", "pos", "y", F.posexplode("p").alias("z", "p")).withColumn("p", F.round("p", 6))


def lattice_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that the three items from the second on have the labels 0, 2 and 1; null in sequences without them."""
    path = F.array(F.lit(0), F.lit(2), F.lit(1))
    found = semirings.span_marginal(F.col("states"), SOFT, F.col("ahead"), F.col("behind"), F.lit(1), path)
    return _walked(spark, sf_dir).select("seq", F.round(found, 6).alias("p"))


def lattice_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best paths."""
    ring = semirings.KBest(3)
    best = semirings.total(semirings.forward(F.col("states"), TRANS, ring), ring)
    rows = _lattices(spark, sf_dir).select("seq", F.posexplode(best).alias("k", "b"))
    path = F.array_join(F.transform(F.reverse("b.path"), lambda y: y.cast("string")), ",")
    return rows.select("seq", (F.col("k") + 1).alias("rank"), (-F.col("b.cost")).alias("score"), path.alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        chain_gaps, rle_segments, segment_report, transitions, all_pairs_transitions, state_features, all_states, feature_ids, template_features, template_macro,
        disjunctive_window, bos_eos, dataset_stats, eval_by_label, eval_overall, hamming, kfold_assign, rank_topk, path_score, viterbi, forward_lognorm, lattice_nodes, lattice_edges, lattice_spans, lattice_best,
    )
}

SEGMENTS = f"""
WITH {EVENTS}, f AS (SELECT *, CASE WHEN label IS NOT DISTINCT FROM lag(label) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos)
), r AS (SELECT *, sum(new) OVER (PARTITION BY seq ORDER BY pos) AS run FROM f
), g AS (SELECT seq, run, min(label) AS label, min(ts) AS start, max(ts) AS last, count(*) AS seg_len FROM r GROUP BY ALL
), seg AS (
  SELECT seq, label, start, coalesce(lead(start) OVER w, last) AS "end", seg_len, CAST(sum(seg_len) OVER w AS BIGINT) AS cum_count FROM g WINDOW w AS (PARTITION BY seq ORDER BY run)
)"""
JUDGED = """
judged AS (
  SELECT l_orderkey AS seq, l_linenumber AS pos, CASE l_returnflag WHEN 'R' THEN 'F' WHEN 'A' THEN 'O' ELSE l_linestatus END AS pred, CASE WHEN l_quantity < 49 THEN l_linestatus END AS ref FROM lineitem
), known AS (
  SELECT *, count(*) FILTER (ref IS NULL) OVER (PARTITION BY seq ORDER BY pos) = 0 AS known FROM judged
), lab AS (SELECT unnest(['F', 'O', 'P']) AS label
), c AS (
  SELECT label, count(*) FILTER (known AND pred = label AND ref = label) AS n_match, count(*) FILTER (known AND pred = label) AS n_model, count(*) FILTER (known AND ref = label) AS n_ref FROM lab CROSS JOIN known GROUP BY label
), pr AS (
  SELECT *, CASE WHEN n_ref = 0 OR n_model = 0 THEN 0.0 ELSE n_match / n_model END AS p, CASE WHEN n_ref = 0 THEN 0.0 ELSE n_match / n_ref END AS r FROM c
), rated AS (SELECT *, CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END AS f FROM pr)"""
#: The lattice walked item by item.
WALK = f"""
WITH RECURSIVE {EVENTS}, st AS (SELECT seq, pos, [CAST((CAST(floor(value) AS BIGINT) * 7 + j * 3) % 10 AS DOUBLE) for j in [0, 1, 2, 3, 4]] AS s FROM ev)"""
#: Rows of the forward and backward recursions over a tenth of the scores, each with a sum of 1.
BOTH = (
    WALK
    + """, fw AS (
  SELECT seq, pos, [exp(x / 10) / list_sum([exp(y / 10) for y in s]) for x in s] AS a FROM st WHERE pos = 0
  UNION ALL
  SELECT seq, pos, [x / list_sum(b) for x in b] FROM (
    SELECT n.seq, n.pos, [list_sum([w.a[i + 1] * exp(((i * 5 + j * 3) % 7) / 10) for i in [0, 1, 2, 3, 4]]) * exp(n.s[j + 1] / 10) for j in [0, 1, 2, 3, 4]] AS b
    FROM fw w JOIN st n ON n.seq = w.seq AND n.pos = w.pos + 1)
), last AS (SELECT seq, max(pos) AS n FROM st GROUP BY seq), bw AS (
  SELECT seq, pos, s, [CAST(1 AS DOUBLE) for k in [0, 1, 2, 3, 4]] AS b FROM st JOIN last USING (seq) WHERE pos = n
  UNION ALL
  SELECT seq, pos, s, [x / list_sum(r) for x in r] FROM (
    SELECT n.seq, n.pos, n.s, [list_sum([exp(((i * 5 + j * 3) % 7) / 10) * exp(w.s[j + 1] / 10) * w.b[j + 1] for j in [0, 1, 2, 3, 4]]) for i in [0, 1, 2, 3, 4]] AS r
    FROM bw w JOIN st n ON n.seq = w.seq AND n.pos = w.pos - 1)
), nodes AS (SELECT f.seq, f.pos, [f.a[j] * w.b[j] for j in [1, 2, 3, 4, 5]] AS g FROM fw f JOIN bw w ON w.seq = f.seq AND w.pos = f.pos
), edges AS (
  SELECT f.seq, f.pos, [f.a[k // 5 + 1] * exp(((k // 5 * 5 + k % 5 * 3) % 7) / 10) * exp(w.s[k % 5 + 1] / 10) * w.b[k % 5 + 1] for k in range(25)] AS g FROM fw f JOIN bw w ON w.seq = f.seq AND w.pos = f.pos + 1)
"""
)

SQL = {
    "lattice_nodes": BOTH + "SELECT seq, CAST(pos AS INT) AS pos, CAST(y AS INT) AS y, round(g[y + 1] / list_sum(g), 6) AS p FROM nodes, (SELECT unnest(range(5)) AS y)",
    "lattice_edges": BOTH + "SELECT seq, CAST(pos AS INT) AS pos, CAST(k // 5 AS INT) AS y, CAST(k % 5 AS INT) AS z, round(g[k + 1] / list_sum(g), 6) AS p FROM edges, (SELECT unnest(range(25)) AS k)",
    # a chain's span is its edges' product over that of the nodes between
    "lattice_spans": BOTH + """SELECT l.seq, round((a.g[0 * 5 + 2 + 1] / list_sum(a.g)) * (b.g[2 * 5 + 1 + 1] / list_sum(b.g)) / (n.g[3] / list_sum(n.g)), 6) AS p
FROM last l LEFT JOIN edges a ON a.seq = l.seq AND a.pos = 1 LEFT JOIN edges b ON b.seq = l.seq AND b.pos = 2 LEFT JOIN nodes n ON n.seq = l.seq AND n.pos = 2""",
    "lattice_best": WALK
    + """, walk AS (
  SELECT seq, pos, [[{'cost': -s[j + 1], 'path': [j]}] for j in range(5)] AS b FROM st WHERE pos = 0
  UNION ALL
  SELECT n.seq, n.pos, [list_sort(flatten([[{'cost': x.cost - (i * 5 + j * 3) % 7 - n.s[j + 1], 'path': list_concat([j], x.path)} for x in w.b[i + 1]] for i in range(5)]))[1:3] for j in range(5)]
  FROM walk w JOIN st n ON n.seq = w.seq AND n.pos = w.pos + 1
), last AS (SELECT seq, max(pos) AS pos FROM st GROUP BY seq), best AS (SELECT seq, list_sort(flatten(b))[1:3] AS b FROM walk JOIN last USING (seq, pos)
), each AS (SELECT seq, unnest(b) AS x, generate_subscripts(b, 1) AS rank FROM best)
SELECT seq, CAST(rank AS INT) AS rank, -x.cost AS score, array_to_string(list_reverse(x.path), ',') AS path FROM each""",
    "chain_gaps": """
WITH k AS (SELECT DISTINCT doc_id AS k FROM labels), r AS (SELECT k, k - row_number() OVER (ORDER BY k) AS grp FROM k)
SELECT min(k) AS first, max(k) AS last, count(*) AS n FROM r GROUP BY grp""",
    "rle_segments": SEGMENTS + " SELECT * FROM seg",
    "segment_report": SEGMENTS + ' SELECT seq, start, "end", ' + ", ".join(f"max(CASE WHEN label = '{x}' THEN cum_count ELSE 0 END) AS {x}" for x in LABELS) + " FROM seg GROUP BY ALL",
    "transitions": f"WITH {EVENTS}, p AS (SELECT lag(label) OVER (PARTITION BY seq ORDER BY pos) AS prev, label AS cur FROM ev) SELECT prev, cur, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL",
    "all_pairs_transitions": f"""
WITH {TURNS}, p AS (SELECT lag(label) OVER (PARTITION BY seq ORDER BY pos) AS prev, label AS cur FROM turns), t AS (SELECT prev, cur, count(*) AS n FROM p WHERE prev IS NOT NULL GROUP BY ALL),
l AS (SELECT DISTINCT label FROM turns)
SELECT a.label AS prev, b.label AS cur, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN t ON t.prev = a.label AND t.cur = b.label""",
    "state_features": f"WITH {LINES} SELECT tok, lang AS label, count(*) AS freq FROM tok GROUP BY ALL HAVING count(*) >= {MINFREQ}",
    "all_states": f"""
WITH {LINES}, f AS (SELECT tok, lang, count(*) AS freq FROM tok GROUP BY ALL), top AS (SELECT tok FROM f GROUP BY tok ORDER BY sum(freq) DESC, tok LIMIT 50), l AS (SELECT DISTINCT lang FROM documents)
SELECT top.tok, l.lang AS label, coalesce(freq, 0) AS freq FROM top CROSS JOIN l LEFT JOIN f ON f.tok = top.tok AND f.lang = l.lang""",
    "feature_ids": f"""
WITH {EVENTS}, m AS (SELECT lag(label) OVER (PARTITION BY seq ORDER BY pos) AS prev, label AS cur FROM ev),
a AS (SELECT 0 AS type, 'v' || CAST(floor(value / 50) AS BIGINT) AS src, label AS dst, count(*) AS freq FROM ev GROUP BY ALL UNION ALL SELECT 1, prev, cur, count(*) FROM m WHERE prev IS NOT NULL GROUP BY ALL)
SELECT *, row_number() OVER (ORDER BY type, src, dst) - 1 AS fid FROM a""",
    "template_features": f"""
WITH {EVENTS}, w AS (SELECT seq, pos, lag(label, 2) OVER w AS a, lag(label) OVER w AS b, lead(label) OVER w AS c, CAST(hour(ts) AS VARCHAR) AS h FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos)),
f AS (SELECT seq, pos, unnest(['label[-2]=' || a, 'label[-1]=' || b, 'label[1]=' || c, 'label[-1]|hour[0]=' || b || '|' || h, 'label[-2]|label[-1]=' || a || '|' || b]) AS feat FROM w)
SELECT * FROM f WHERE feat IS NOT NULL""",
    "template_macro": f"""
WITH {EVENTS} SELECT seq, pos, 'U05:' || coalesce(lag(label) OVER w, '') || '/' || CAST(hour(ts) AS VARCHAR) || '/' || coalesce(lead(label) OVER w, '') AS feat FROM ev WINDOW w AS (PARTITION BY seq ORDER BY pos)""",
    "disjunctive_window": f"""
WITH {EVENTS}, w AS (
  SELECT seq, pos, list(label) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS a, list(label) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS b FROM ev)
SELECT seq, pos, 'label[-4..-1]=' || unnest(a) AS feat FROM w UNION ALL SELECT seq, pos, 'label[1..4]=' || unnest(b) FROM w""",
    "bos_eos": f"""
WITH {TURNS}, m AS (SELECT seq, pos, max(pos) OVER (PARTITION BY seq) AS last FROM turns)
SELECT seq, pos, '__BOS__' AS mark FROM m WHERE pos = 0 UNION ALL SELECT seq, pos, '__EOS__' FROM m WHERE pos = last""",
    "dataset_stats": f"""
WITH {EVENTS}, s AS (SELECT seq, count(*) AS n FROM ev GROUP BY seq)
SELECT (SELECT count(*) FROM s) AS instances, (SELECT CAST(sum(n) AS BIGINT) FROM s) AS items, (SELECT max(n) FROM s) AS max_length, count(DISTINCT label) AS labels, count(DISTINCT floor(value / 50)) AS attributes FROM ev""",
    "eval_by_label": f"WITH {JUDGED} SELECT label, n_match, n_model, n_ref, round(p, 9) AS precision, round(r, 9) AS recall, round(f, 9) AS f1 FROM rated",
    "eval_overall": f"""
WITH {JUDGED}, s AS (SELECT seq, count(*) FILTER (known) AS items, count(*) FILTER (known AND pred = ref) AS hits, bool_and(known) AS whole FROM known GROUP BY seq),
t AS (SELECT CAST(sum(items) AS BIGINT) AS items, CAST(sum(hits) AS BIGINT) AS item_hits, count(*) FILTER (whole) AS instances, count(*) FILTER (whole AND items = hits) AS instance_hits FROM s)
SELECT items, item_hits, instances, instance_hits, (SELECT round(avg(p), 9) FROM rated) AS macro_precision, (SELECT round(avg(r), 9) FROM rated) AS macro_recall, (SELECT round(avg(f), 9) FROM rated) AS macro_f1,
       round(item_hits / items, 9) AS item_accuracy, round(instance_hits / nullif(instances, 0), 9) AS instance_accuracy FROM t""",
    "hamming": f"WITH {JUDGED} SELECT seq, count(*) FILTER (pred IS DISTINCT FROM ref) AS distance FROM judged GROUP BY seq",
    "kfold_assign": "SELECT o_orderkey, (((o_orderkey * 2654435761) % 4294967296) >> 16) % 5 AS fold FROM orders",
    "rank_topk": f"""
WITH {EVENTS}, c AS (SELECT seq, label, count(*) AS n FROM ev GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY n DESC, label) AS rank, sum(n) OVER (PARTITION BY seq) AS total FROM c)
SELECT seq, rank, label, round(n / total, 9) AS share FROM r WHERE rank <= 3""",
    "path_score": f"""
WITH {EVENTS}, y AS (SELECT *, list_position({LABELS}, label) - 1 AS y FROM ev), s AS (
  SELECT seq, (CAST(floor(value) AS BIGINT) * 7 + y * 3) % 10 + coalesce((lag(y) OVER (PARTITION BY seq ORDER BY pos) * 5 + y * 3) % 7, 0) AS s FROM y)
SELECT seq, CAST(sum(s) AS DOUBLE) AS score FROM s GROUP BY seq""",
    "viterbi": WALK
    + """, walk AS (
  SELECT seq, pos, s, ['0', '1', '2', '3', '4'] AS p FROM st WHERE pos = 0
  UNION ALL
  SELECT n.seq, n.pos, [list_max([w.s[i + 1] + (i * 5 + j * 3) % 7 for i in [0, 1, 2, 3, 4]]) + n.s[j + 1] for j in [0, 1, 2, 3, 4]],
         [w.p[list_position([w.s[i + 1] + (i * 5 + j * 3) % 7 for i in [0, 1, 2, 3, 4]], list_max([w.s[i + 1] + (i * 5 + j * 3) % 7 for i in [0, 1, 2, 3, 4]]))] || ',' || j for j in [0, 1, 2, 3, 4]]
  FROM walk w JOIN st n ON n.seq = w.seq AND n.pos = w.pos + 1
), last AS (SELECT seq, max(pos) AS pos FROM st GROUP BY seq)
SELECT seq, list_max(s) AS score, p[list_position(s, list_max(s))] AS path FROM walk JOIN last USING (seq, pos)""",
    "forward_lognorm": WALK
    + """, walk AS (
  SELECT seq, pos, [exp(x / 10) / list_sum([exp(y / 10) for y in s]) for x in s] AS a, ln(list_sum([exp(y / 10) for y in s])) AS z FROM st WHERE pos = 0
  UNION ALL
  SELECT seq, pos, [x / list_sum(b) for x in b], z + ln(list_sum(b)) FROM (
    SELECT n.seq, n.pos, w.z, [list_sum([w.a[i + 1] * exp(((i * 5 + j * 3) % 7) / 10) for i in [0, 1, 2, 3, 4]]) * exp(n.s[j + 1] / 10) for j in [0, 1, 2, 3, 4]] AS b
    FROM walk w JOIN st n ON n.seq = w.seq AND n.pos = w.pos + 1)
), last AS (SELECT seq, max(pos) AS pos FROM st GROUP BY seq)
SELECT seq, round(z, 6) AS log_norm FROM walk JOIN last USING (seq, pos)""",
}
