"""One query per operator, over whole tables and with production parameters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm import ann, codebooks, decontam, filteraudit, imatch, inorder, linededup, pii, sentencepieces, simhash, tokencount, toxicity, urlfilter, warc
from seqloom.llm.common import new_path, slices, table, write_table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed as parts of repeated chunks, and the digest of the text that is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup(docs).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


#: The rules of the query, by verdict.
URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, [urlfilter.parse_rule(*r) for r in URL_RULES]).drop("url")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives, read back and assembled; sizes and digests are those of the assembled rows' payloads."""
    path = new_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    slim = write_table(warc.read(spark, path, content=False), "warc_records")
    found = warc.captures(slim, warc.read(spark, path))
    page = F.regexp_extract(F.col("metadata")[0]["content"].cast("string"), r"page-id: (-?\d+)", 1)
    stored = F.col("type") == "response"
    digest = F.when(stored, F.sha1("payload")).otherwise(F.col("digest"))
    size = F.when(stored, F.length("payload").cast("long")).otherwise(F.col("payload_bytes"))
    rows = found.select("capture_id", "refers_to", digest.alias("payload_digest"), size.alias("payload_bytes"), F.col("type").alias("record_type"), F.when(page != "", page.cast("long")).alias("page_id"))
    rows = write_table(rows, "warc_captures")
    named = rows.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("first"))
    return rows.join(named, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", F.col("first").alias("refers_to"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found of every hundredth id."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.search(ann.build(vectors), vectors.where("vec_id % 100 = 0"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after three edits of every text: a cut at a quarter, words put in at the half, letters replaced at three quarters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coder = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    trees = write_table(tokencount.build(docs, *coder), "trees")
    n = F.coalesce(F.length("text"), F.lit(0))
    places = [F.floor(n * k / 4).cast("int") for k in (1, 2, 3)]
    edits = F.array(*(F.struct(at.alias("start"), (at + cut).alias("end"), F.lit(new).alias("new")) for at, cut, new in zip(places, (10, 0, 5), ("", " edited words ", "XXXXX"))))
    return tokencount.recount(trees, edits, *coder, updated=False).select("doc_id", "n_pretokens", "n_before", "n_after", "n_recounted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction of every document; labels of the held-out rows are not learnt from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item found in it; clean documents have none."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", F.col("m.item").alias("item_id"), "m.start", "m.end", "m.edits")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of their decoding."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepieces.digests(coded)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and class of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = simhash.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _shown(spans: str) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _how_many(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts (n_*) and base_sha256 are of the patterns' spans; spans holds those and what the model adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    counts = [_how_many("base", k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_shown("base"), 256).alias("base_sha256"), _shown("spans").alias("spans"))


#: The filters of the audit: whether a document fails them, by its ``text`` and ``words``. E fails copies of a smaller doc_id's text.
CONDITIONS = {
    "A": "size(words) < 200",
    "B": "100L * size(array_distinct(words)) < 50L * size(words)",
    "C": "100L * regexp_count(text, '[A-Z]') > 2L * length(text)",
    "D": "text rlike '[#$%&*|]'",
    "E": None,
}


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters keeps and removes of every source, in every order."""
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), {k: F.expr(c) if c else None for k, c in CONDITIONS.items()})


OP12 = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Bytes of packed texts that are compared at a time.
PACKED_BYTES = 1 << 18


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edit (the last quarter replaced by the beginning of the next document), and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = spark.sparkContext.broadcast(imatch.fit(docs))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", PACKED_BYTES):
            texts, after = (inorder.unpacked(part.column(c)) for c in ("text", "next_text"))
            edits = [t[: len(t) - len(t) // 4] + n[: len(t) // 4] for t, n in zip(texts.to_pylist(), after.to_pylist())]
            prints = [imatch.fingerprints(held, lexicon.value) for held in (texts, pa.array(edits, pa.string()), after)]
            near = [pa.array([*map(imatch.likeness, prints[0], other)], pa.float64()) for other in prints[1:]]
            digests = pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits], pa.string())
            sizes = pc.utf8_length(texts).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sizes, digests, *(pa.array(p, pa.string()) for p in prints[:2]), *near], names=[c.split()[0] for c in OP12.split(", ")])

    return inorder.with_next(docs).mapInArrow(work, OP12)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes and errors of every vector, the errors of its label, and the digest of the codebooks."""
    found = codebooks.compress(table(spark, sf_dir, "embeddings"), keep=["label"])
    digest = hashlib.sha256(found.text().encode()).hexdigest()
    rows = codebooks.with_totals(found.rows, "label", "error", "label_error")
    return rows.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


QUERIES = [op1_line_dedup, op2_url_filter, op3_warc, op4_neighbours, op5_token_counts, op6_toxicity, op7_decontamination, op8_sentencepiece, op9_simhash, op10_pii, op11_filter_audit, op12_fingerprints, op13_vector_codes]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


OP2_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM split
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/es/', 'example.org/en/1', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""

OP3_SQL = """
WITH body AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes FROM pages
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS first FROM body
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> first THEN first END AS refers_to
FROM firsts
"""


OP1_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)
), full_ AS (
  SELECT doc_id, i, body, lead(i) OVER w AS j, lead(body) OVER w AS next FROM lines WHERE regexp_matches(body, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), windows AS (
  SELECT doc_id, i, j, row_number() OVER (PARTITION BY body, next ORDER BY doc_id, i) AS nth FROM full_ WHERE j IS NOT NULL
), gone AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, j)) AS i FROM windows WHERE nth > 1
), left_ AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed, string_agg(l.body, chr(10) ORDER BY l.i) FILTER (g.i IS NULL) AS text
  FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id
)
SELECT d.doc_id, n_lines, n_removed, CASE WHEN n_removed > 0 THEN sha256(coalesce(l.text, '')) ELSE sha256(d.text) END AS text_sha256
FROM documents d JOIN left_ l ON l.doc_id = d.doc_id
"""


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS m FROM d
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), h AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY part, m
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS step FROM orders
), s AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, m, n, good, toxic, contains(m, filter_order[step]) AS fails, translate(m, left(filter_order, step - 1), '') <> m AS gone FROM steps, h
), r AS (
  SELECT part, filter_order, step, letter, sum(CASE WHEN NOT gone AND NOT fails THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND fails THEN n ELSE 0 END) AS removed, sum(CASE WHEN gone AND fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN m = letter THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN NOT gone AND fails THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM s GROUP BY part, filter_order, step, letter
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
       CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM r
"""


def _op13_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """All rounds as tables one behind another; of equally near entries the first counts."""
    ctes = [f"""kept AS (
  SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), x AS MATERIALIZED (
  SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, (SELECT unnest(range({parts})) AS p)
), b0 AS MATERIALIZED (
  SELECT p, k, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept QUALIFY k < {entries}) USING (vec_id)
)"""]
    near = "(SELECT x.vec_id, x.label, x.p, x.v, b.k, list_sum([(q[1] - q[2]) * (q[1] - q[2]) FOR q IN list_zip(x.v, b.v)]) AS d FROM x JOIN b{} b ON b.p = x.p)"
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT vec_id, any_value(label) AS label, p, any_value(v) AS v, min(CAST(d AS HUGEINT) * 1000 + k) AS best FROM {near.format(r)} GROUP BY vec_id, p)")
        if r < rounds:
            ctes.append(f"""t{r} AS (
  SELECT p, k, i, sum(y) AS s, count(*) AS n FROM (SELECT p, best % 1000 AS k, unnest(v) AS y, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL
), m{r} AS (SELECT p, k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM t{r} GROUP BY p, k
), b{r + 1} AS MATERIALIZED (SELECT b.p, b.k, coalesce(m.v, b.v) AS v FROM b{r} b LEFT JOIN m{r} m ON m.p = b.p AND m.k = b.k)""")
    return f"""
WITH {", ".join(ctes)}, e AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', CAST(best % 1000 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // 1000) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), c AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e, c
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": OP11_SQL, "op13_vector_codes": _op13_sql(), "op1_line_dedup": OP1_SQL, "op2_url_filter": OP2_SQL, "op3_warc": OP3_SQL}
