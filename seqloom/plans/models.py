"""Queries that train and apply sequence models, and round trips through files."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.functions import semirings
from seqloom.operators import sequences, validation
from seqloom.operators.crf import BlockCRFModel, LinearChainCRF, generate_features
from seqloom.operators.crf_layout import sequences_of
from seqloom.operators.stages import InformationSelector, SequenceTemplates, WildcardTerms
from seqloom.plans.mining import EVENTS
from seqloom.sources import attribute_source, tag_text
from seqloom.sources.adapters import event_sequences, table, turn_sequences
from seqloom.sources.staging import new_path, staged
from seqloom.streaming.tagging import OUT, run_available, tag_stream


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with attributes: the class of the value, the quarter of the day, and both."""
    rows = event_sequences(table(spark, sf_dir, "events"))
    v = F.concat(F.lit("v:"), F.floor(F.log2(F.col("value") + 1)).cast("string"))
    q = F.concat(F.lit("q:"), F.floor(F.hour("ts") / 6).cast("string"))
    feats = F.array(*(F.struct(a.alias("attr"), w.alias("value")) for a, w in ((v, F.lit(1.0)), (q, F.lit(0.5)), (F.concat_ws("&", v, q), F.lit(1.0)))))
    return rows.select("seq", "pos", "label", feats.alias("feats"))


#: Partitions of training. Online trainers mix as many models, so the number is part of the result.
PARTITIONS = 4


def _tagged(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    rows = items(spark, sf_dir)
    model = LinearChainCRF(partitions=PARTITIONS, **settings).fit(rows)
    return model.transform(rows).select("seq", "pos", "label", "pred", "marginal", "probability")


def crf_train_tag_lbfgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, algorithm="lbfgs", c2=1.0)


def crf_train_l2sgd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, algorithm="l2sgd")


def crf_train_ap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, algorithm="ap")


def crf_train_pa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, algorithm="pa")


def crf_train_arow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tagged(spark, sf_dir, algorithm="arow")


def crf_optimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features, and whether what a trained model expects of them balances what was seen and the norm's pull.

    The batch trainer runs until its gradient is small. What it ends with is judged without the trainer's
    arithmetic: scores by joins with the table of weights, probabilities by the lattice functions.
    """
    rows = staged(sequences_of(items(spark, sf_dir)), "optimum")
    c2 = 1.0
    model = LinearChainCRF(partitions=PARTITIONS, c2=c2, period=0).fit(rows)
    labels = model.labels
    weights = staged(model.dump(spark).select("type", "src", "dst", "weight"), "optimum")
    moves = {(r["src"], r["dst"]): r["weight"] for r in weights.where("type = 1").collect()}  # pairs of labels
    trans = [[moves.get((a, b), 0.0) for b in labels] for a in labels]
    by_attr = weights.where("type = 0").groupBy("src").agg(*(F.sum(F.when(F.col("dst") == y, F.col("weight")).otherwise(0.0)).alias(f"w{k}") for k, y in enumerate(labels)))
    # sequences are dealt out once, so that an item's scores and a sequence's items are put together where they are
    long = rows.repartition("seq").select("seq", F.explode("items").alias("i")).select("seq", "i.pos", F.explode_outer("i.feats").alias("f")).select("seq", "pos", F.col("f.attr").alias("src"), "f.value")
    scores = long.join(by_attr, "src", "left").groupBy("seq", "pos").agg(F.array(*(F.sum(F.coalesce(F.col(f"w{k}") * F.col("value"), F.lit(0.0))) for k in range(len(labels)))).alias("s"))
    chains = scores.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("i")).select("seq", F.transform("i", lambda x: x["s"]).alias("states"))
    ring, states = semirings.FactorSum(), F.col("states")
    chains = chains.select("seq", "states", semirings.forward(states, trans, ring).alias("ahead"), semirings.backward(states, trans, ring).alias("behind"))
    beside = rows.select(F.col("seq").alias("of"), F.transform("items", lambda x: x["feats"]).alias("feats"))
    chains = staged(chains.join(beside, F.col("seq").eqNullSafe(F.col("of"))).select("states", "ahead", "behind", "feats"), "optimum")
    names = F.array(*map(F.lit, labels))
    nodes = chains.select(F.explode(F.arrays_zip("feats", semirings.node_marginals(F.col("ahead"), F.col("behind")).alias("p"))).alias("n")).select(F.explode("n.feats").alias("f"), "n.p")
    states_seen = nodes.groupBy(F.col("f.attr").alias("src")).agg(F.array(*(F.sum(F.col("f.value") * F.col("p")[k]) for k in range(len(labels)))).alias("p"))
    states_seen = states_seen.select(F.lit(0).alias("type"), "src", F.posexplode("p").alias("y", "expected")).select("type", "src", names[F.col("y")].alias("dst"), "expected")
    edges = F.transform(semirings.edge_marginals(states, trans, F.col("ahead"), F.col("behind")), F.flatten)
    sums = F.aggregate(edges, F.array_repeat(F.lit(0.0), len(labels) ** 2), lambda total, e: F.zip_with(total, e, lambda x, y: x + y))  # a sequence's, of pairs of labels
    moves_seen = chains.select(F.posexplode(sums).alias("k", "p")).groupBy("k").agg(F.sum("p").alias("expected"))
    moves_seen = moves_seen.select(F.lit(1).alias("type"), names[F.floor(F.col("k") / len(labels)).cast("int")].alias("src"), names[F.col("k") % len(labels)].alias("dst"), "expected")
    both = generate_features(rows).join(states_seen.unionByName(moves_seen), ["type", "src", "dst"], "left").join(weights, ["type", "src", "dst"], "left")
    slope = F.coalesce("expected", F.lit(0.0)) - F.col("freq") + 2 * c2 * F.coalesce("weight", F.lit(0.0))
    return both.select("type", "src", "dst", F.round("freq", 6).alias("freq"), (F.abs(slope) < 1e-3).alias("balanced"))


#: Weights of the fixed model, by name of attribute and label or of both labels: whole quarters.
WEIGHT = "if(type = 0, (length(src) * 3 + find_in_set(dst, 'click,error,purchase,signup,view') * 5) % 7, (find_in_set(src, 'click,error,purchase,signup,view') * 5 + find_in_set(dst, 'click,error,purchase,signup,view') * 3) % 7) / 4.0D"


def fixed_model(rows: DataFrame):
    return LinearChainCRF().with_weights(rows, F.expr(WEIGHT))


def marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two likeliest labels of every event under the fixed weights."""
    rows = items(spark, sf_dir)
    return fixed_model(rows).ranked(rows, 2).withColumn("marginal", F.round("marginal", 6))


def crf_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marginals of the best path's labels and its probability under the fixed weights."""
    rows = items(spark, sf_dir)
    return fixed_model(rows).transform(rows).select("seq", "pos", "label", "pred", F.round("marginal", 6).alias("marginal"), F.round("probability", 6).alias("probability"))


def crf_tag_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As crf_tag, by a model whose weights stay a table."""
    rows, path = items(spark, sf_dir), new_path(spark, "model")
    fixed_model(rows).save(path)
    found = BlockCRFModel.load(path).transform(rows)
    return found.select("seq", "pos", "label", "pred", F.round("marginal", 6).alias("marginal"), F.round("probability", 6).alias("probability"))


def model_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_model(items(spark, sf_dir)).dump(spark).withColumn("freq", F.round("freq", 6))


def active_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_model(items(spark, sf_dir)).active(spark)


#: Places at which the stream's parts begin; each is written, read and tagged before the next.
PARTS = (0, 4, 12)


def stream_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of the events as a stream of files, each sequence tagged when its last event has come.

    The stream is stopped and started anew between its parts; open sequences stay in its state.
    """
    rows = items(spark, sf_dir)
    model = fixed_model(rows)
    source, sink, marks = (new_path(spark, n) for n in ("stream", "tags", "marks"))
    last = F.col("pos") == F.max("pos").over(Window.partitionBy("seq"))
    events = rows.select(F.col("seq").cast("string").alias("seq"), F.col("pos").cast("long").alias("pos"), "feats", last.alias("last"))
    for begin, end in zip(PARTS, [*PARTS[1:], 1 << 62]):
        events.where((F.col("pos") >= begin) & (F.col("pos") < end)).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        run_available(tag_stream(stream, model).writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks))
    found = spark.read.schema(OUT).parquet(sink)
    return found.select("seq", "pos", "pred", F.round("marginal", 6).alias("marginal"), F.round("probability", 6).alias("probability"))


def path_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, log norm and probability of the events' own labels under the fixed weights."""
    rows = items(spark, sf_dir)
    return fixed_model(rows).path_probability(rows).select("seq", *(F.round(c, 6).alias(c) for c in ("score", "log_norm", "probability")))


def span_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability that the second and third event have the labels that they have, under the fixed weights."""
    rows = items(spark, sf_dir)
    spans = rows.where("pos in (1, 2)").groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("l"))
    spans = spans.where(F.size("l") == 2).select("seq", F.lit(1).cast("long").alias("begin"), F.transform("l", lambda x: x["label"]).alias("labels"))
    found = fixed_model(rows).span_probability(rows, spans)
    return found.select("seq", "begin", F.array_join("labels", ">").alias("labels"), F.round("probability", 6).alias("probability"))


def path_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features on the paths of the events' own labels, and the paths' scores by the fixed weights' table."""
    rows = items(spark, sf_dir)
    weights = fixed_model(rows).dump(spark).select("type", "src", "dst", "weight")
    found = sequences.path_features(rows).join(weights, ["type", "src", "dst"], "left")
    score = F.sum(F.col("value") * F.coalesce("weight", F.lit(0.0)))
    return found.groupBy(F.col("seq").cast("string").alias("seq")).agg(F.count(F.lit(1)).alias("n_features"), F.round(score, 6).alias("score"))


def column_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields by label after writing the items as column features, and lines that part sequences."""
    path = new_path(spark, "columns")
    tag_text.write_columns(items(spark, sf_dir), path)
    lines = spark.read.text(path).select(F.split("value", "\t", -1).alias("f"))
    fields = lines.select(F.col("f")[0].alias("label"), F.explode(F.slice("f", 2, F.size("f"))).alias("field"))
    ends = lines.where("f[0] = ''").agg(F.lit("").alias("label"), F.lit("").alias("field"), F.count(F.lit(1)).alias("n"))
    return fields.groupBy("label", "field").agg(F.count(F.lit(1)).alias("n")).unionByName(ends)


#: Features that the pipeline keeps.
SELECTED = 60


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as items: words, and a class of their number."""
    rows = turn_sequences(table(spark, sf_dir, "conversations"))
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\n", " "), " ", -1), lambda w: w != "")
    return rows.select("seq", "pos", "label", words.alias("words"), F.concat(F.lit("s"), F.length(F.bin(F.size(words).cast("long"))).cast("string")).alias("size"))


def _stages() -> list:
    return [WildcardTerms(sizes=[1, 2]), InformationSelector(keep=SELECTED), SequenceTemplates(templates=["size[0]", "size[-1]|size[0]"])]


def _reloaded(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    path = new_path(spark, "pipeline")
    model.write().save(path)
    return PipelineModel.load(path)


def pipeline_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the turns by a pipeline that was fitted, saved and loaded."""
    rows = turns(spark, sf_dir)
    model = _reloaded(Pipeline(stages=_stages()).fit(rows), spark)
    found = model.transform(rows).select("seq", "pos", F.explode("feats").alias("f"))
    return found.select("seq", "pos", "f.attr", F.round("f.value", 6).alias("value"))


def pipeline_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns by role, and how many of them a pipeline with a chain tags alike before it is saved and after it is loaded."""
    rows = turns(spark, sf_dir)
    model = Pipeline(stages=[*_stages(), LinearChainCRF(partitions=PARTITIONS)]).fit(rows)
    one, two = (m.transform(rows).select("seq", "pos", "label", "pred", F.round("marginal", 9).alias("marginal")) for m in (model, _reloaded(model, spark)))
    both = one.join(two.withColumnsRenamed({"pred": "pred2", "marginal": "marginal2"}).drop("label"), ["seq", "pos"])
    return both.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col("pred") == F.col("pred2")) & (F.col("marginal") == F.col("marginal2"))).alias("n_same"))


def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of three folds of the users, each under a model of the others."""
    rows = items(spark, sf_dir)
    return validation.cross_validate(LinearChainCRF(partitions=PARTITIONS), rows, validation.round_robin(rows, 3), 3)


def holdout_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures on a third of the users after each iteration."""
    rows = items(spark, sf_dir)
    learn, held = validation.split_by_group(rows.join(validation.round_robin(rows, 3), "seq"), "fold", 0)
    return validation.with_holdout(LinearChainCRF(partitions=PARTITIONS), learn.drop("fold"), held.drop("fold"))[1]


def attribute_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes by label after writing and reading the text form."""
    path = new_path(spark, "attributes")
    attribute_source.save(items(spark, sf_dir), path)
    held = attribute_source.scan(spark, path).select("label", F.explode("feats").alias("f"))
    return held.groupBy("label", F.col("f.attr").alias("attr")).agg(F.count(F.lit(1)).alias("n"), F.sum("f.value").alias("total"))


def partition_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents laid out by language and source, of which one language is read back."""
    path = new_path(spark, "layout")
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    docs.repartition("lang", "source").write.partitionBy("lang", "source").parquet(path)
    back = spark.read.parquet(path).where("lang = 'en'")
    return back.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_chars").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (marginals, crf_tag, crf_tag_blocks, path_probability, span_probability, path_features, column_text, pipeline_features, pipeline_tags, active_weights, stream_tags, cross_validation, holdout_rounds, crf_optimum, crf_train_tag_lbfgs, crf_train_l2sgd, crf_train_ap, crf_train_pa, crf_train_arow, model_dump, attribute_text_roundtrip, partition_layout)
}
#: Weights, features and lattices of the fixed model: forward and backward rows with a sum of 1, best paths beside them.
FIXED = f"""
WITH RECURSIVE {EVENTS}, lab AS (SELECT unnest(['click', 'error', 'purchase', 'signup', 'view']) AS y, unnest([1, 2, 3, 4, 5]) AS k
), a AS (SELECT seq, pos, label, 'v:' || CAST(floor(log2(value + 1)) AS BIGINT) AS v, 'q:' || CAST(floor(hour(ts) / 6) AS BIGINT) AS q FROM ev
), f AS (SELECT seq, pos, label, v AS attr, 1.0 AS x FROM a UNION ALL SELECT seq, pos, label, q, 0.5 FROM a UNION ALL SELECT seq, pos, label, v || '&' || q, 1.0 FROM a
), moves AS (SELECT prev, cur, count(*) AS n FROM (SELECT lag(label) OVER (PARTITION BY seq ORDER BY pos) AS prev, label AS cur FROM ev) WHERE prev IS NOT NULL GROUP BY ALL
), feats AS (
  SELECT 0 AS type, attr AS src, label AS dst, sum(x) AS freq, ((length(attr) * 3 + k * 5) % 7) / 4 AS weight FROM f JOIN lab ON y = label GROUP BY attr, label, k
  UNION ALL SELECT 1, prev, cur, n, ((p.k * 5 + c.k * 3) % 7) / 4 FROM moves JOIN lab p ON p.y = prev JOIN lab c ON c.y = cur
), m AS (SELECT list(w ORDER BY i, j) AS m FROM (SELECT p.k AS i, c.k AS j, coalesce(max(weight), 0) AS w FROM lab p CROSS JOIN lab c LEFT JOIN feats ON type = 1 AND src = p.y AND dst = c.y GROUP BY ALL)
), st AS (
  SELECT seq, pos, list(s ORDER BY k) AS s FROM (
    SELECT f.seq, f.pos, lab.k, sum(f.x * coalesce(w.weight, 0)) AS s FROM f CROSS JOIN lab LEFT JOIN feats w ON w.type = 0 AND w.src = f.attr AND w.dst = lab.y GROUP BY ALL) GROUP BY ALL
), ends AS (SELECT seq, max(pos) AS n FROM st GROUP BY seq
), fw AS (
  SELECT seq, pos, [exp(x) / list_sum([exp(y) for y in s]) for x in s] AS a, ln(list_sum([exp(y) for y in s])) AS z, s AS b, ['1', '2', '3', '4', '5'] AS p FROM st WHERE pos = 0
  UNION ALL
  SELECT seq, pos, [x / list_sum(r) for x in r], z + ln(list_sum(r)), b, p FROM (
    SELECT n.seq, n.pos, w.z, [list_sum([w.a[i] * exp(m[(i - 1) * 5 + j]) for i in [1, 2, 3, 4, 5]]) * exp(n.s[j]) for j in [1, 2, 3, 4, 5]] AS r,
           [list_max([w.b[i] + m[(i - 1) * 5 + j] for i in [1, 2, 3, 4, 5]]) + n.s[j] for j in [1, 2, 3, 4, 5]] AS b,
           [w.p[list_position([w.b[i] + m[(i - 1) * 5 + j] for i in [1, 2, 3, 4, 5]], list_max([w.b[i] + m[(i - 1) * 5 + j] for i in [1, 2, 3, 4, 5]]))] || ',' || j for j in [1, 2, 3, 4, 5]] AS p
    FROM fw w JOIN st n ON n.seq = w.seq AND n.pos = w.pos + 1 CROSS JOIN m)
), bw AS (
  SELECT seq, pos, [CAST(1 AS DOUBLE) for k in [1, 2, 3, 4, 5]] AS b, s FROM st JOIN ends USING (seq) WHERE pos = n
  UNION ALL
  SELECT seq, pos, [x / list_sum(r) for x in r], s FROM (
    SELECT n.seq, n.pos, n.s, [list_sum([exp(m[(i - 1) * 5 + j]) * exp(w.s[j]) * w.b[j] for j in [1, 2, 3, 4, 5]]) for i in [1, 2, 3, 4, 5]] AS r
    FROM bw w JOIN st n ON n.seq = w.seq AND n.pos = w.pos - 1 CROSS JOIN m)
), gamma AS (
  SELECT seq, pos, [x / list_sum(g) for x in g] AS g FROM (SELECT f.seq, f.pos, [f.a[j] * w.b[j] for j in [1, 2, 3, 4, 5]] AS g FROM fw f JOIN bw w ON w.seq = f.seq AND w.pos = f.pos)
), best AS (
  SELECT f.seq, string_split(p[list_position(b, list_max(b))], ',') AS path, exp(list_max(b) - z) AS probability FROM fw f JOIN ends e ON e.seq = f.seq AND e.n = f.pos
), tags AS (
  SELECT e.seq, e.pos, e.label, y AS pred, round(g[k], 6) AS marginal, round(probability, 6) AS probability
  FROM ev e JOIN gamma USING (seq, pos) JOIN best USING (seq) JOIN lab ON k = CAST(path[CAST(e.pos AS INT) + 1] AS INT)
)
"""
SQL = {
    "marginals": FIXED + """, r AS (SELECT seq, pos, y AS label, g[k] AS p, row_number() OVER (PARTITION BY seq, pos ORDER BY g[k] DESC, k) AS rank FROM gamma CROSS JOIN lab)
SELECT CAST(seq AS VARCHAR) AS seq, pos, rank, label, round(p, 6) AS marginal FROM r WHERE rank <= 2""",
    "crf_tag": FIXED + "SELECT CAST(seq AS VARCHAR) AS seq, pos, label, pred, marginal, probability FROM tags",
    "crf_tag_blocks": FIXED + "SELECT CAST(seq AS VARCHAR) AS seq, pos, label, pred, marginal, probability FROM tags",
    "path_probability": FIXED + """, y AS (SELECT e.seq, e.pos, k, lag(k) OVER (PARTITION BY e.seq ORDER BY e.pos) AS prev FROM ev e JOIN lab ON y = label
), score AS (SELECT y.seq, sum(st.s[y.k] + CASE WHEN prev IS NULL THEN 0 ELSE m[(prev - 1) * 5 + k] END) AS score FROM y JOIN st ON st.seq = y.seq AND st.pos = y.pos CROSS JOIN m GROUP BY y.seq)
SELECT CAST(c.seq AS VARCHAR) AS seq, round(score, 6) AS score, round(z, 6) AS log_norm, round(exp(score - z), 6) AS probability FROM score c JOIN ends e ON e.seq = c.seq JOIN fw f ON f.seq = c.seq AND f.pos = e.n""",
    "path_features": FIXED + """, y AS (SELECT e.seq, e.pos, k, label, lag(k) OVER (PARTITION BY e.seq ORDER BY e.pos) AS prev FROM ev e JOIN lab ON y = label
), score AS (SELECT y.seq, sum(st.s[y.k] + CASE WHEN prev IS NULL THEN 0 ELSE m[(prev - 1) * 5 + k] END) AS score FROM y JOIN st ON st.seq = y.seq AND st.pos = y.pos CROSS JOIN m GROUP BY y.seq
), own AS (SELECT DISTINCT seq, attr, label FROM f UNION ALL SELECT DISTINCT seq, CAST(prev AS VARCHAR), CAST(k AS VARCHAR) FROM y WHERE prev IS NOT NULL)
SELECT CAST(c.seq AS VARCHAR) AS seq, n AS n_features, round(score, 6) AS score FROM score c JOIN (SELECT seq, count(*) AS n FROM own GROUP BY seq) USING (seq)""",
    "column_text": FIXED + """SELECT label, replace(attr, ':', '__COLON__') || ':' || printf('%f', CAST(x AS DOUBLE)) AS field, count(*) AS n FROM f GROUP BY ALL
UNION ALL SELECT '', '', count(*) FROM (SELECT DISTINCT seq FROM ev)""",
    "span_probability": FIXED + """, y AS (SELECT e.seq, e.pos, e.label, k FROM ev e JOIN lab ON y = label WHERE e.pos IN (1, 2)
), g AS (
  SELECT a.seq, a.label || '>' || b.label AS labels, (a.k - 1) * 5 + b.k AS cell, [f.a[i // 5 + 1] * exp(m[i + 1]) * exp(w.s[i % 5 + 1]) * w.b[i % 5 + 1] for i in range(25)] AS p
  FROM y a JOIN y b ON b.seq = a.seq AND a.pos = 1 AND b.pos = 2 JOIN fw f ON f.seq = a.seq AND f.pos = 1 JOIN bw w ON w.seq = a.seq AND w.pos = 2 CROSS JOIN m)
SELECT CAST(seq AS VARCHAR) AS seq, CAST(1 AS BIGINT) AS begin, labels, round(p[cell] / list_sum(p), 6) AS probability FROM g""",
    "pipeline_features": f"""
WITH t AS (
  SELECT conv_id AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role AS label, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda w: w <> '') AS w FROM conversations
), tok AS (SELECT seq, pos, label, w, unnest(w) AS a, generate_subscripts(w, 1) AS i FROM t
), g AS (SELECT seq, pos, label, a AS feat FROM tok UNION ALL SELECT seq, pos, label, unnest([a || '_' || w[i + 1], '*_' || w[i + 1]]) FROM tok WHERE i < len(w)
), dt AS (SELECT DISTINCT seq, pos, label, feat FROM g
), n AS (SELECT count(*) AS n FROM t), pl AS (SELECT label, count(*) / (SELECT n FROM n) AS pl FROM t GROUP BY label
), pf AS (SELECT feat, count(*) / (SELECT n FROM n) AS pf FROM dt GROUP BY feat), j AS (SELECT feat, label, count(*) / (SELECT n FROM n) AS pj FROM dt GROUP BY ALL
), grid AS (SELECT pf.feat, pl, pf, coalesce(pj, 0.0) AS pj FROM pf CROSS JOIN pl LEFT JOIN j ON j.feat = pf.feat AND j.label = pl.label
), mi AS (
  SELECT feat, round(sum(CASE WHEN abs(pj) < 1e-7 THEN 0 ELSE pj * ln(pj / pl / pf) END + CASE WHEN abs(pl - pj) < 1e-7 THEN 0 ELSE (pl - pj) * ln((pl - pj) / pl / (1 - pf)) END), 6) AS mi FROM grid GROUP BY feat
), top AS (SELECT feat FROM mi ORDER BY mi DESC, feat DESC LIMIT {SELECTED}
), c AS (SELECT seq, pos, feat, count(*) AS cnt FROM g JOIN top USING (feat) GROUP BY ALL), s AS (SELECT feat, max(cnt) AS scale FROM c GROUP BY feat
), z AS (SELECT seq, pos, 's' || length(bin(len(w))) AS size, lag('s' || length(bin(len(w)))) OVER (PARTITION BY seq ORDER BY pos) AS before FROM t)
SELECT seq, pos, feat AS attr, round(cnt / scale, 6) AS value FROM c JOIN s USING (feat) UNION ALL SELECT seq, pos, 'size[0]=' || size, 1.0 FROM z
UNION ALL SELECT seq, pos, 'size[-1]|size[0]=' || before || '|' || size, 1.0 FROM z WHERE before IS NOT NULL""",
    "pipeline_tags": "SELECT role AS label, count(*) AS n, count(*) AS n_same FROM conversations GROUP BY role",
    "stream_tags": FIXED + "SELECT CAST(seq AS VARCHAR) AS seq, pos, pred, marginal, probability FROM tags",
    "crf_optimum": FIXED + "SELECT type, src, dst, round(CAST(freq AS DOUBLE), 6) AS freq, true AS balanced FROM feats",
    "model_dump": FIXED + "SELECT type, src, dst, round(CAST(freq AS DOUBLE), 6) AS freq, weight FROM feats WHERE weight <> 0",
    "active_weights": FIXED + "SELECT type, count(*) AS n_features, count(*) FILTER (weight <> 0) AS n_active FROM feats GROUP BY type",
    "attribute_text_roundtrip": f"""
WITH {EVENTS}, a AS (SELECT label, 'v:' || CAST(floor(log2(value + 1)) AS BIGINT) AS v, 'q:' || CAST(floor(hour(ts) / 6) AS BIGINT) AS q FROM ev),
f AS (SELECT label, v AS attr, 1.0 AS x FROM a UNION ALL SELECT label, q, 0.5 FROM a UNION ALL SELECT label, v || '&' || q, 1.0 FROM a)
SELECT label, attr, count(*) AS n, CAST(sum(x) AS DOUBLE) AS total FROM f GROUP BY ALL""",
    "partition_layout": "SELECT source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'en' GROUP BY source",
}
