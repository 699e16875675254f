"""WARC archives of pages: written by Spark's text writer, read back, and assembled to captures.

Every record ends with two line breaks, which serve as the writer's separator, so an archive is
a valid file of WARC records whatever the payloads hold. A reader cuts records by their
Content-Length. Request, response (or revisit) and metadata records of a capture are joined by
their WARC-Concurrent-To identifiers and emitted as one nested row.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.shared import cut, discard, scratch_path

CRLF = "\r\n"
LEAST_BYTES = 1000
#: Pages of up to LONG bytes share a file, FILE_BYTES / LONG of them; of longer ones as many as keep a file below FILE_BYTES.
FILE_BYTES, LONG = 64 << 20, 64 << 10
DATE = "2024-01-01T00:00:00Z"
RECORD = "record_id string, type string, target_uri string, date string, concurrent_to string, refers_to string, payload_digest string, payload_bytes long, fields string"


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], mime: str, block: Column) -> Column:
    """Header lines whose value is null are left out."""
    lines = [F.concat(F.lit(f"{CRLF}{name}: "), value) for name, value in headers]
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), kind, F.lit(f"{CRLF}WARC-Record-ID: "), record_id, F.lit(f"{CRLF}WARC-Date: {DATE}"),
        *(F.coalesce(x, F.lit("")) for x in lines),
        F.lit(f"{CRLF}Content-Type: {mime}{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF * 2), block,
    )


def _captures(pages: DataFrame, least_bytes: int, wanted: Column, shared: DataFrame, part: str) -> DataFrame:
    """(page_id, url, html, digest, octets, capture, target): the rows of pages that are wanted, each with a capture identifier.

    target is null for a response, and else the identifier of the response that is revisited.
    shared has the payloads that occur more than once: (digest, top, url_top, ties), see _shared. part
    is another one for each call.
    """
    source = _hashed(pages).filter(wanted)
    number = F.monotonically_increasing_id().cast("string")
    columns = ("page_id", "url", "html", "digest", "octets")
    none = F.lit(None).cast("string")
    first = _record_id(F.lit("shared"), F.col("digest"))
    small = source.filter(F.col("octets") < least_bytes).select(*columns, _record_id(F.lit("small"), F.lit(part), number).alias("capture"), none.alias("target"))
    known = source.filter(F.col("octets") >= least_bytes).join(shared, "digest", "left")
    is_top = F.col("page_id").eqNullSafe(F.col("top")) & (F.col("url") == F.col("url_top"))
    alone = F.col("ties").isNull()
    plain = known.filter(alone | ~is_top | (F.col("ties") == 1)).select(
        *columns,
        F.when(~alone & is_top, first).otherwise(_record_id(F.lit("large"), F.lit(part), number)).alias("capture"),
        F.when(~alone & ~is_top, first).alias("target"),
    )
    tied = shared.filter("ties > 1")
    if tied.isEmpty():
        return small.unionByName(plain)
    # equal rows that all stand first: one of them is the response
    tied = source.filter(F.col("octets") >= least_bytes).join(tied, "digest").filter(is_top).groupBy("page_id", "url", "digest", "octets").agg(F.first("html").alias("html"), F.count("*").alias("n"))
    each = tied.withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    again = each.select(*columns, F.when(F.col("k") == 1, first).otherwise(_record_id(F.lit("tied"), F.col("digest"), F.col("k").cast("string"))).alias("capture"), F.when(F.col("k") > 1, first).alias("target"))
    return small.unionByName(plain).unionByName(again)


def _hashed(pages: DataFrame) -> DataFrame:
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]+", " ").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    return source.withColumn("octets", F.octet_length("html").cast("long")).withColumn("digest", F.sha1(F.col("html").cast("binary")))


def _shared(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(digest, top, url_top, ties) of payloads that occur more than once: the page that stands first, and in how many equal rows.

    That is the largest page_id, and of several the smallest url; a null page_id comes last.
    """
    counted = _hashed(pages).filter(F.col("octets") >= least_bytes).groupBy("digest", "page_id", "url").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), (-F.col("page_id")).alias("falling"), "url")
    return counted.groupBy("digest").agg(F.min_by(F.struct("page_id", "url", "n"), rank).alias("t"), F.sum("n").alias("n")).filter("n > 1").select("digest", F.col("t.page_id").alias("top"), F.col("t.url").alias("url_top"), F.col("t.n").alias("ties"))


def _lines(known: DataFrame) -> DataFrame:
    """The text of a capture's request, response or revisit, and metadata records."""
    page, digest, own, url, revisit = (F.col(c) for c in ("page_id", "digest", "capture", "url", "target"))
    again = revisit.isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("octets").cast("string"), F.lit(CRLF * 2))
    response = _record(
        F.when(again, "revisit").otherwise("response"),
        own,
        [
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
            ("WARC-Profile", F.when(again, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", revisit),
        ],
        "application/http;msgtype=response",
        F.when(again, http).otherwise(F.concat(http, "html")),
    )
    request = _record(F.lit("request"), _record_id(F.lit("request"), own), [("WARC-Target-URI", url), ("WARC-Concurrent-To", own)], "application/http;msgtype=request", F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{CRLF}{CRLF}")))
    fields = F.concat(F.coalesce(F.concat(F.lit("pageId: "), page.cast("string"), F.lit(CRLF)), F.lit("")), F.lit("payloadBytes: "), F.col("octets").cast("string"), F.lit(CRLF))
    metadata = _record(F.lit("metadata"), _record_id(F.lit("metadata"), own), [("WARC-Target-URI", url), ("WARC-Concurrent-To", own)], "application/warc-fields", fields)
    return known.select(F.concat_ws(CRLF * 2, request, response, metadata).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, long: int = LONG) -> None:
    """Write request, response or revisit, and metadata records for each row of pages(page_id, url, html).

    Of rows with equal payloads of least_bytes or more, the one with the largest page_id is the
    response and the others revisit it; of several with that page_id the one with the smallest url
    is, and of equal rows any one. A null page_id comes after all others, a null html counts as empty
    and a null url as an empty one. A file holds about file_bytes, or one page if that is longer.
    """
    shared = cut(_shared(pages, least_bytes))
    longest = pages.agg(F.max(F.octet_length("html"))).first()[0] or 0
    octets = F.octet_length("html")
    for mode, wanted, most in (("errorifexists", octets <= long, file_bytes // long), ("append", octets > long, max(1, file_bytes // max(1, longest)))):
        if mode == "errorifexists" or longest > long:
            lines = _lines(_captures(pages, least_bytes, wanted, shared, mode))
            lines.write.mode(mode).option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def unzipped(data: bytes) -> bytes:
    """An archive's bytes; of gzip, all members, of which many archives have one a record."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        if not member.eof:
            raise ValueError("a gzip member is cut short")
        data = member.unused_data.lstrip(b"\x00")
    if out and data:
        raise ValueError("bytes after the last gzip member")
    return b"".join(out) if out else data


def parse_records(data: bytes):
    """Records of one archive, cut by their lengths: (headers by lower-cased name, block). One that is cut short is an error."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at : end if end >= 0 else at + 64].decode("utf-8", "replace").split(CRLF)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        if end < 0:
            raise ValueError(f"the header at byte {at} is cut short")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        n = int(headers["content-length"])
        if end + 4 + n > len(data):
            raise ValueError(f"the block of the record at byte {at} is cut short")
        yield headers, data[end + 4 : end + 4 + n]
        at = end + 4 + n
        while data[at : at + 2] == b"\r\n":
            at += 2


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row per record. With payloads, the payload of responses comes along as bytes.

    The digest and the size of a response are computed from its payload as read; those of a
    revisit are as declared. One file at a time is held by a task.
    """
    schema = RECORD + (", payload binary" if payloads else "")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                data = unzipped(content.as_py())
                out: list[list] = [[] for _ in range(9 + payloads)]
                for h, block in parse_records(data):
                    kind, payload, fields = h["warc-type"], None, None
                    digest, octets = (h.get("warc-payload-digest") or ":").partition(":")[2] or None, None
                    if kind == "response":
                        payload = block.partition(b"\r\n\r\n")[2]
                        digest, octets = hashlib.sha1(payload).hexdigest(), len(payload)
                    elif kind == "metadata":
                        fields = block.decode("utf-8", "replace")
                    row = (h["warc-record-id"], kind, h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-concurrent-to"), h.get("warc-refers-to"), digest, octets, fields)
                    for column, value in zip(out, row + ((payload,) if payloads else ()), strict=True):
                        column.append(value)
                kinds = [pa.string()] * 7 + [pa.int64(), pa.string()] + [pa.binary()] * payloads
                names = [x.split()[0] for x in schema.split(", ")]
                for start in range(0, len(out[0]), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[start : start + 1000], k) for c, k in zip(out, kinds, strict=True)], names)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(run, schema)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: its response or revisit with the request and metadata records
    that are concurrent to it, null where there is none.

    All records meet by the capture's identifier in one pass. Records of one identifier that repeat
    are taken once, and of several requests (or metadata records) of a capture the smallest.
    """
    whole = F.struct(*(c for c in records.columns if c not in ("type", "concurrent_to")))
    own = F.col("type").isin("response", "revisit")
    keyed = records.withColumn("capture_id", F.when(own, F.col("record_id")).when(F.col("type").isin("request", "metadata"), F.col("concurrent_to"))).filter("capture_id is not null")
    one = lambda which, name: F.min(F.when(which, whole)).alias(name)
    met = keyed.groupBy("capture_id").agg(F.min(F.when(own, F.col("type"))).alias("record_type"), one(own, "response"), one(F.col("type") == "request", "request"), one(F.col("type") == "metadata", "metadata"))
    return met.filter("record_type is not null")


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write pages to archives in the shared folder, read them back, and describe each capture.

    The archives stay if a path is given. A row for each row of pages, repeated ones and those without a page_id included; other columns are
    ignored, and an empty table gives an empty result.
    """
    spark = pages.sparkSession
    own, path = path is None, path or scratch_path(spark, "warc")
    write_archives(pages, path)
    field = lambda name: F.regexp_extract("metadata.fields", rf"(?m)^{name}: (-?\d+)\r?$", 1).try_cast("long")
    described = cut(
        assemble(read_archives(spark, path)).select(
            "capture_id",
            field("pageId").alias("page_id"),
            F.coalesce("response.payload_bytes", field("payloadBytes")).alias("payload_bytes"),
            F.col("response.payload_digest").alias("payload_digest"),
            "record_type",
            F.col("response.refers_to").alias("target"),
            F.col("response.target_uri").alias("url"),
        )
    )
    if own:  # archives that nobody named a place for go once they are described
        discard(spark, path)
    wanted = described.filter("record_type = 'revisit'")
    named = described.filter("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")).join(wanted.select("target").distinct(), "target", "left_semi")
    last = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    return wanted.join(named, "target", "left").select(last).unionByName(described.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(last))


WARC_SQL = """
with p as (select page_id, regexp_replace(coalesce(url, ''), '[\r\n]+', ' ', 'g') as url, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
r as (select *, payload_bytes >= 1000 and row_number() over (partition by payload_digest order by page_id desc nulls last, url) > 1 as again,
             first_value(page_id) over (partition by payload_digest order by page_id desc nulls last, url) as first from p)
select page_id, payload_bytes, payload_digest, case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to, url from r
"""
