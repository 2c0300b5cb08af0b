"""WARC archives: records written as files, read back, and joined to one row per capture.

A capture is a response (or a revisit of one with an equal payload) with the request and metadata
records that name it, or are named by it, as concurrent. Archives are Spark text files whose record
ends are line separators, so any file system that Spark can write holds them (gzipped as one stream per
file); reading goes by the records' own lengths, whatever the payloads hold, and takes plain archives
and gzipped ones of one member or many.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.common import quoted, write_table

END = "\r\n"
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records of one archive file, revisits that are broadcast (some 50 bytes each; more are joined), and bytes of a batch read.
FILE_RECORDS, BROADCAST, BATCH_BYTES = 3000, 1 << 20, 8 << 20
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELDS = "record_id string, type string, concurrent_to string, refers_to string, target_uri string, digest string, http_length long, payload_bytes long, payload_sha1 string, content binary"


def uuid_of(*parts: Column) -> Column:
    """A urn:uuid that the parts determine."""
    h = F.md5(F.concat_ws("\n", *(F.coalesce(p.cast("string"), F.lit("\\N")) for p in parts)))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def _octets(text: Column) -> Column:
    return F.octet_length(text).cast("string")


def _record(kind: str, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its last separator. Headers with null values are left out."""
    lines = [F.concat(F.lit(f"WARC/1.1{END}WARC-Type: {kind}{END}WARC-Record-ID: "), record_id, F.lit(f"{END}WARC-Date: {DATE}{END}"))]
    for name, value in headers:
        lines.append(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit("")))
    return F.concat(*lines, F.lit("Content-Length: "), _octets(block), F.lit(END + END), block)


def payload_plan(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """``key, url, body, sha1, nth, first`` of every row: nth tells rows alike in key and payload apart (one of them is 1),
    first is the key of the response that the row revisits, null for responses.

    Of rows with equal payloads of REVISIT_BYTES and more, those with the largest key are responses.
    Null keys are never the largest; where all keys are null, all rows are responses. Payloads stay
    where they are: only keys and digests are shuffled, unless there are too many revisits to broadcast.
    """
    text = F.coalesce(quoted(body).cast("string"), F.lit(""))
    source = pages.select(quoted(key).alias("key"), quoted(url).cast("string").alias("url"), text.alias("body")).withColumn("sha1", F.sha1("body"))
    source = source.withColumn("row", F.md5(F.concat_ws("\n", F.col("key").isNull().cast("string"), F.col("key").cast("string"), "sha1")))
    slim = source.select("row", "key", "sha1", (F.octet_length("body") >= REVISIT_BYTES).alias("long"))
    ids = write_table(slim.groupBy("row", "key", "sha1", "long").agg(F.count(F.lit(1)).alias("n")), "warc_rows")
    most = ids.where("long").groupBy("sha1").agg(F.max("key").alias("first"), F.min("key").alias("low"), F.count(F.lit(1)).alias("many"), F.count("key").alias("known"))
    most = write_table(most.where("first is not null and (low <> first or known < many)").select(F.col("sha1").alias("s"), "first"), "warc_firsts")
    later = write_table(ids.where("long").join(most, F.col("sha1") == F.col("s")).where(~F.col("key").eqNullSafe(F.col("first"))).select(F.col("row").alias("r"), "first"), "warc_revisits")
    few = later.count() <= BROADCAST
    joined = source.join(F.broadcast(later) if few else later.hint("merge"), F.col("row") == F.col("r"), "left").drop("r").withColumn("nth", F.lit(1).cast("long"))
    again = write_table(ids.where("n > 1").select(F.col("row").alias("r")), "warc_repeated")
    if not again.isEmpty():  # rows alike are told apart by a written number
        alike = write_table(joined.join(again, F.col("row") == F.col("r"), "left_semi").withColumn("id", F.monotonically_increasing_id()), "warc_alike")
        heads = alike.groupBy("row").agg(F.min("id").alias("head")).select(F.col("row").alias("r"), "head")
        numbered = alike.join(heads, F.col("row") == F.col("r")).withColumn("nth", F.when(F.col("id") == F.col("head"), 1).otherwise(F.col("id") + 2).cast("long"))
        joined = joined.join(again, F.col("row") == F.col("r"), "left_anti").unionByName(numbered.select(*joined.columns))
    return joined.drop("row")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html") -> None:
    """Write request, response (or revisit) and metadata records of every row as gzipped archive files under ``path``."""
    rows = payload_plan(pages, key, url, body)
    me, sha1, nth = F.col("key"), F.col("sha1"), F.col("nth")
    ids = {kind: uuid_of(F.lit(kind), me, sha1, nth) for kind in ("request", "capture", "metadata")}
    # header values are one line
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "%20")
    target = F.when(uri != "", uri)
    size = _octets(F.col("body"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), size, F.lit(END + END))
    digest = F.concat(F.lit("sha1:"), sha1)
    request = _record("request", ids["request"], [("WARC-Target-URI", target), ("WARC-Concurrent-To", ids["capture"]), ("Content-Type", F.lit("application/http; msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(target, F.lit("/")), F.lit(f" HTTP/1.1{END}{END}")))
    named = [("WARC-Target-URI", target), ("WARC-Payload-Digest", digest), ("Content-Type", F.lit("application/http; msgtype=response"))]
    response = _record("response", ids["capture"], named, F.concat(http, F.col("body")))
    first = uuid_of(F.lit("capture"), F.col("first"), sha1, F.lit(1))
    revisit = _record("revisit", ids["capture"], [("WARC-Refers-To", first), ("WARC-Profile", F.lit(PROFILE)), *named], http)
    note = F.concat(F.lit("page-id: "), F.coalesce(me.cast("string"), F.lit("")), F.lit(END))
    metadata = _record("metadata", ids["metadata"], [("WARC-Concurrent-To", ids["request"]), ("Content-Type", F.lit("application/warc-fields"))], note)
    records = F.array(request, F.when(F.col("first").isNull(), response).otherwise(revisit), metadata)
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END + END).option("maxRecordsPerFile", FILE_RECORDS).option("compression", "gzip").text(path)


class Parser:
    """Records of one archive, fed piece by piece; it holds one record and one piece at most."""

    def __init__(self):
        self.held, self.headers, self.need = bytearray(), None, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        """(headers with lower-case names, block) of the records that end here."""
        self.held += data
        while True:
            if self.headers is None:
                begin = 0
                while self.held[begin : begin + 2] == b"\r\n":
                    begin += 2
                stop = self.held.find(b"\r\n\r\n", begin)
                if stop < 0:
                    return
                version, *lines = self.held[begin:stop].decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError("the archive holds something else than records")
                self.headers = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
                if "content-length" not in self.headers:
                    raise ValueError("a record has no length, or the archive ends within a record")
                self.need = int(self.headers["content-length"])
                del self.held[: stop + 4]
            if len(self.held) < self.need:
                return
            headers, block = self.headers, bytes(self.held[: self.need])
            del self.held[: self.need]
            self.headers = None
            yield headers, block

    def close(self) -> None:
        if self.headers is not None or self.held.strip(b"\r\n"):
            raise ValueError("the archive ends within a record")


def _row(headers: dict[str, str], block: bytes, content: bool) -> tuple:
    kind, payload, said = headers.get("warc-type", ""), block, None
    if headers.get("content-type", "").startswith("application/http"):
        head, _, payload = block.partition(b"\r\n\r\n")
        told = [line.partition(b":")[2] for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:")]
        said = int(told[0]) if told else None
    shown = payload if content or kind in ("metadata", "warcinfo") else None
    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
    return headers.get("warc-record-id"), kind, headers.get("warc-concurrent-to"), headers.get("warc-refers-to"), headers.get("warc-target-uri"), digest, said, len(payload), hashlib.sha1(payload).hexdigest(), shown


def read(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """One row per record (FIELDS) of all archives under ``path``; ``content`` off leaves response payloads out.

    payload_bytes and payload_sha1 are those of the payload as stored, digest and http_length what the
    headers say. Gzipped archives (of one member or many, by the name's end in .gz) are streamed, so
    memory holds a record at a time; plain ones are read whole, up to the 2 GB of a row. Empty archives
    have no records; broken ones raise an error.
    """
    zipped = spark.read.option("lineSep", END + END).option("pathGlobFilter", "*.gz").text(path).select(F.col("value").cast("binary").alias("data"), F.col("_metadata.file_path").alias("path"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*[^z]").load(path).select(F.col("content").alias("data"), "path")

    def parse(batches: Iterator[pa.RecordBatch], behind: bytes = b"") -> Iterator[pa.RecordBatch]:
        parser, now, rows, size = Parser(), None, [], 0
        for batch in batches:
            for data, path in zip(batch.column(0), batch.column(1).to_pylist()):
                if path != now:
                    parser.close()
                    parser, now = Parser(), path
                piece = data.as_buffer().to_pybytes()
                for headers, block in parser.feed(piece + behind):
                    rows.append(_row(headers, block, content))
                    size += len(block)
                    if size > BATCH_BYTES or len(rows) == 1000:
                        yield _batch(rows)
                        rows, size = [], 0
        parser.close()
        if rows:
            yield _batch(rows)

    # the text source has taken the line separators
    return zipped.mapInArrow(lambda batches: parse(batches, (END + END).encode()), FIELDS).union(plain.mapInArrow(parse, FIELDS))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    fields = [f.split() for f in FIELDS.split(", ")]
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], names=[n for n, _ in fields])


def captures(records: DataFrame, whole: DataFrame | None = None) -> DataFrame:
    """One nested row per response or revisit: ``capture_id, type, target_uri, digest, payload_bytes, refers_to,
    payload, requests, metadata``.

    Requests and metadata belong to a capture if a chain of concurrent-to identifiers (of one or two
    steps, in either direction) leads to it. digest and payload_bytes are of the full payload: as
    stored for responses, as the headers say for revisits. Records that name no known record are left out.
    Where ``records`` lacks the payloads (read() without content, written once for all joins), ``whole``
    is the same with them, so that they are shuffled once.
    """
    is_capture = F.col("type").isin("response", "revisit")
    side = records.where(F.col("type").isin("request", "metadata"))
    links = records.where("concurrent_to is not null").select(F.col("record_id").alias("a"), F.col("concurrent_to").alias("b"))
    both = links.union(links.select("b", "a")).distinct()
    heads = records.where(is_capture).select(F.col("record_id").alias("capture_id"))
    near = both.join(heads, both["a"] == heads["capture_id"]).select("capture_id", F.col("b").alias("record_id"))
    far = near.alias("n").join(both.alias("l"), F.col("n.record_id") == F.col("l.a")).select("n.capture_id", F.col("l.b").alias("record_id"))
    reached = near.union(far).distinct()
    told = side.select("record_id", "type", F.struct("record_id", "target_uri", "content").alias("r"))
    sides = reached.join(told, "record_id").groupBy("capture_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("type") == "request", F.col("r")))).alias("requests"),
        F.array_sort(F.collect_list(F.when(F.col("type") == "metadata", F.col("r")))).alias("metadata"),
    )
    main = (records if whole is None else whole).where(is_capture)
    stored = F.col("type") == "response"
    return main.join(sides, main["record_id"] == sides["capture_id"], "left").select(
        F.col("record_id").alias("capture_id"),
        "type",
        "target_uri",
        F.when(stored, F.col("payload_sha1")).otherwise(F.col("digest")).alias("digest"),
        F.when(stored, F.col("payload_bytes")).otherwise(F.col("http_length")).alias("payload_bytes"),
        "refers_to",
        F.col("content").alias("payload"),
        "requests",
        "metadata",
    )
