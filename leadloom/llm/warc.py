"""WARC archives: write captures, read records back, and assemble them into one nested row per capture.

Writing: every page gives a request, a response or revisit, and a metadata record; request and metadata name the
capture in WARC-Concurrent-To. Records are UTF-8 text built by Spark and written by its text sink with the blank lines
between records as line separator, gzip per file, to any file system Spark writes to. Of pages with equal payloads of at least
REVISIT_BYTES, the one with the largest (page_id, url) is written as response; the others are revisits naming it.

Reading: files are read as binary rows (the writer keeps them to MAX_RECORDS records) and cut by Content-Length,
so payloads may hold anything, also text that looks like a record. Other writers' archives, plain or gzip, read the same.

Assembly: request and metadata records meet their response or revisit through concurrent-to identifiers, named on
either side; a revisit meets the response it refers to.

Defined results: null html is an empty payload; a null url leaves WARC-Target-URI out, control characters and spaces in
it are percent-encoded; a null page_id leaves the metadata's page-id out and comes back as null; rows repeated as a whole
(page_id, url and html) are written as often as they occur and come back as often; an empty table gives an archive without
records; extra columns are not archived. Satellites that name no capture in the archive are left out of the captures.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm.common import join_hot, keep, register, table
from leadloom.session import work_path

REVISIT_BYTES, MAX_RECORDS = 1000, 30_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURES = ("response", "revisit")

RECORD = ("record_id string, record_type string, target_uri string, date string, concurrent_to array<string>, refers_to string, "
          "content_type string, block_bytes long, payload_bytes long, payload_digest string, header_digest string, fields map<string,string>")


def _urn(*parts: Column | str) -> Column:
    """Record id from the parts: equal parts, equal id."""
    name = F.md5(F.concat_ws("|", *[F.coalesce(p, F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(name, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(kind: Column | str, record_id: Column, date: str, url: Column, content_type: str, block: Column, **headers: Column) -> Column:
    """A record without the two line ends that close it; headers that are null are left out."""
    lines = {"WARC-Type": kind if isinstance(kind, Column) else F.lit(kind), "WARC-Record-ID": record_id, "WARC-Date": F.lit(date),
             "WARC-Target-URI": url, **{k.replace("_", "-"): v for k, v in headers.items()},
             "Content-Type": F.lit(content_type), "Content-Length": F.octet_length(block).cast("string")}
    text = F.concat_ws("\r\n", F.lit("WARC/1.1"), *[F.concat(F.lit(f"{k}: "), v) for k, v in lines.items()])
    return F.concat(text, F.lit("\r\n\r\n"), block)


def write(pages: DataFrame, path: str, date: str = DATE, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Archive `page_id`, `url` and `html` of all pages below `path`."""
    url = F.col("url")
    for char, code in (("%", None), (" ", "%20"), ("\t", "%09"), ("\n", "%0A"), ("\r", "%0D")):
        url = F.replace(url, F.lit(char), F.lit(code)) if code else url
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("string").alias("page"), "page_id", "url", F.regexp_replace(url, "[\\x00-\\x1f\\x7f]", "%7F").alias("uri"),
                        payload.alias("payload"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(F.encode(payload, "utf-8")).alias("digest"))
    long_digest = F.when(F.col("bytes") >= revisit_bytes, F.col("digest"))
    equal = rows.select(long_digest.alias("same"), "page_id", "url").where("same IS NOT NULL").groupBy("same").agg(
        F.max(F.struct("page_id", "url")).alias("keeper"), F.count(F.lit(1)).alias("times")).where("times > 1")
    rows = join_hot(rows.withColumn("same", long_digest), keep(equal, "equal"), "same", "times", "left")

    mine, other = F.struct("page_id", "url"), F.col("keeper")
    revisit = other.isNotNull() & ~mine.eqNullSafe(other)
    capture = _urn("capture", F.col("page"), F.col("url"), F.col("digest"))
    rows = rows.select("*", capture.alias("capture"), revisit.alias("revisit"),
                       F.when(revisit, _urn("capture", F.col("keeper.page_id").cast("string"), F.col("keeper.url"), F.col("digest"))).alias("origin"))
    host = F.regexp_extract("uri", "://([^/?#]*)", 1)
    target = F.regexp_extract("uri", "://[^/?#]*([^#]*)", 1)
    asked = F.concat(F.lit("GET "), F.when(target == "", F.lit("/")).otherwise(F.coalesce(target, F.lit("/"))), F.lit(" HTTP/1.1\r\nHost: "),
                     F.coalesce(host, F.lit("")), F.lit("\r\n\r\n"))
    answer = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"),
                      F.when(F.col("revisit"), F.lit("")).otherwise(F.col("payload")))
    notes = F.concat(F.coalesce(F.concat(F.lit("page-id: "), F.col("page"), F.lit("\r\n")), F.lit("")), F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit("\r\n"))
    to_capture = {"WARC_Concurrent_To": F.col("capture")}
    own = {kind: _urn(F.lit(kind), F.col("capture")) for kind in ("request", "metadata")}
    records = F.array(
        _record("request", own["request"], date, F.col("uri"), "application/http; msgtype=request", asked, **to_capture),
        _record(F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), F.col("capture"), date, F.col("uri"), "application/http; msgtype=response", answer,
                WARC_Payload_Digest=F.concat(F.lit("sha1:"), F.col("digest")), WARC_Refers_To=F.col("origin"), WARC_Profile=F.when(F.col("revisit"), F.lit(PROFILE))),
        _record("metadata", own["metadata"], date, F.col("uri"), "application/warc-fields", notes, **to_capture))
    (rows.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", MAX_RECORDS).text(path))


def records(content: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Headers (lower-case names) and block of every record of a plain or gzip file."""
    data = memoryview(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content)
    whole, at = data.obj, 0
    while (at := whole.find(b"WARC/1.", at)) >= 0:
        end = whole.find(b"\r\n\r\n", at)
        if end < 0:
            raise ValueError("a record's header does not end")
        headers: dict[str, list[str]] = {}
        for line in whole[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(headers["content-length"][0])
        if end + 4 + size > len(whole):
            raise ValueError("a record is cut off")
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size


def _row(headers: dict[str, list[str]], block: memoryview, with_payload: bool) -> tuple:
    first = {k: v[0] for k, v in headers.items()}
    kind, content_type = first.get("warc-type"), first.get("content-type", "")
    fields, payload = None, block
    if content_type.startswith("application/http"):
        end = bytes(block[:65536]).find(b"\r\n\r\n")
        end = end if end >= 0 else bytes(block).find(b"\r\n\r\n")
        payload = block[end + 4:] if end >= 0 else block[:0]
    elif content_type.startswith("application/warc-fields"):
        lines = bytes(block).decode("utf-8", "replace").split("\r\n")
        fields = [(k.strip().lower(), v.strip()) for k, sep, v in (x.partition(":") for x in lines) if sep]
    row = (first.get("warc-record-id"), kind, first.get("warc-target-uri"), first.get("warc-date"), headers.get("warc-concurrent-to"), first.get("warc-refers-to"),
           content_type, len(block), len(payload), hashlib.sha1(payload).hexdigest(), first.get("warc-payload-digest", "").removeprefix("sha1:").lower() or None, dict(fields) if fields else None)
    return (*row, bytes(payload)) if with_payload else row


def read(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record: RECORD, and `payload` if asked for."""
    names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload

    def parse(batches):
        for batch in batches:
            for content in batch.content:
                rows = []
                for headers, block in records(content):
                    rows.append(_row(headers, block, with_payload))
                    if len(rows) >= 2000 or with_payload and len(rows) >= 100:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path).select("content")
    return files.mapInPandas(parse, RECORD + ", payload binary" * with_payload)


def assemble(rows: DataFrame) -> DataFrame:
    """One nested row per capture: its record, the request and metadata records that belong to it, and what a revisit refers to.

    `rows` is read more than once: pass a written table. Records with one id are one capture with `copies` occurrences.
    """
    capture = rows.where(F.col("record_type").isin(*CAPTURES))
    satellite = rows.where(F.col("record_type").isin("request", "metadata"))
    named = satellite.select(F.col("record_id").alias("sat"), F.explode("concurrent_to").alias("capture_id")).unionByName(
        capture.where("concurrent_to IS NOT NULL").select(F.explode("concurrent_to").alias("sat"), F.col("record_id").alias("capture_id"))).distinct()
    body = [c for c in rows.columns if c not in ("concurrent_to",)]
    held = satellite.groupBy("record_id").agg(F.first(F.struct(*body)).alias("record"))
    parts = named.join(held, F.col("sat") == F.col("record_id")).groupBy("capture_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("record.record_type") == kind, F.struct(
            *[F.col(f"record.{c}") for c in ("record_id", "target_uri", "date", "content_type", "block_bytes")],
            F.map_entries("record.fields").alias("fields"))))).alias(f"{kind}s") for kind in ("request", "metadata")])
    parts = parts.withColumns({c: F.transform(c, lambda x: F.struct(
        x["record_id"], x["target_uri"], x["date"], x["content_type"], x["block_bytes"], F.map_from_entries(x["fields"]).alias("fields"))) for c in ("requests", "metadatas")})
    whole = capture.groupBy("record_id").agg(F.first(F.struct(*[c for c in body if c != "record_id"])).alias("r"), F.count(F.lit(1)).alias("copies"))
    whole = whole.join(parts, F.col("record_id") == F.col("capture_id"), "left").select("record_id", "r.*", "copies", "requests", F.col("metadatas").alias("metadata"))
    whole = keep(whole, "captures")
    named = whole.where("refers_to IS NOT NULL").groupBy(F.col("refers_to").alias("origin_id")).agg(F.sum("copies").alias("times"))
    origin = named.join(whole.where("record_type = 'response'"), F.col("origin_id") == F.col("record_id")).select(
        "origin_id", "times", F.struct("record_id", "target_uri", "date", "payload_bytes", "payload_digest", "metadata").alias("referred"))
    return join_hot(whole, keep(origin.withColumnRenamed("origin_id", "refers_to"), "origins"), "refers_to", "times", "left")


def op4_warc(spark, folder):
    path = work_path(spark, "warc")
    write(table(spark, folder, "pages").select("page_id", "url", "html"), path)
    captures = assemble(keep(read(spark, path), "records"))
    noted = lambda where, name: F.element_at(F.try_element_at(where, F.lit(1))["fields"], name).cast("long")
    own = F.col("record_type") == "response"
    out = captures.select(
        noted(F.col("metadata"), "page-id").alias("page_id"),
        F.when(own, F.col("payload_bytes")).otherwise(F.col("referred.payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("payload_digest")).otherwise(F.col("header_digest")).alias("payload_digest"), "record_type",
        noted(F.col("referred.metadata"), "page-id").alias("refers_to"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return out.drop("copy")


ORACLE = r"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS bytes FROM pages
), k AS (
  SELECT html, max(page_id) AS keeper FROM p WHERE bytes >= 1000 GROUP BY html
)
SELECT p.page_id, CAST(p.bytes AS BIGINT) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN k.keeper <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN k.keeper <> p.page_id THEN k.keeper END AS refers_to
FROM p LEFT JOIN k ON k.html = p.html AND p.bytes >= 1000
"""
register("op4_warc", ORACLE)(op4_warc)
