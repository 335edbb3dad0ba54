"""WARC archives: written by Spark, read back, and assembled into one nested row per capture.

**Writing.**  A capture is three records: request, response (or revisit) and metadata, tied to the
response by WARC-Concurrent-To.  The archives are WARC/1.1 files (gzip by default), written by
Spark's own writer to any store it can write to; record bodies carry their Content-Length, and the
blank line that ends a record is the writer's line separator.  Of captures with equal payloads of
at least ``least`` bytes the one with the largest page_id is the response; the others are revisits
that refer to it and carry no payload.

**Reading.**  Files are bounded by the bytes they hold (``FILE_BYTES``, or one capture if that is larger), since
one task unpacks a file; captures of more than ``LARGE_BYTES`` are written to files of their own.  They
are parsed by Content-Length, plain or gzip, in one or many members, into flat records.  ``captures`` then joins requests and metadata to their
response through the concurrent-to identifiers, in whichever of the two records these stand, and
looks up the payload that a revisit refers to.

Defined results: a null payload is empty.  A null or unusable URL is left out of the record.  A null
page_id never is the largest one; captures with equal payloads and no page_id at all are all
responses, and so are captures that share the largest page_id.  Captures repeated in every column
give as many rows.  An empty table gives archives without records and no rows.  Other columns are
not written.  A record that ends before its Content-Length, or a request or metadata record whose
capture is in no archive, is left out of the captures.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridloom.llm.registry import query, table
from gridloom.session import scratch_path, stage

LEAST_BYTES = 1000
#: Payload bytes of a file, and from how many on a capture counts as large.
FILE_BYTES, LARGE_BYTES = 64 << 20, 32 << 10
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n\r\n"

RECORD = (
    "record_id string, record_type string, concurrent_to array<string>, refers_to string, target_uri string, date string,"
    " page_id string, payload_digest string, payload_bytes long, http_headers string, payload binary"
)


def _urn(*parts: Column | str) -> Column:
    text = F.concat_ws("|", *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("?")) for p in parts))
    h = F.md5(text.cast("binary"))
    dashed = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.concat(F.lit("<urn:uuid:"), dashed, F.lit(">"))


def _record(kind: str | Column, body: Column, *headers: tuple[str, Column | str]) -> Column:
    """Head and body of one record, without the blank line that ends it; a null header is left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), F.lit(kind) if isinstance(kind, str) else kind)]
    lines += [F.concat(F.lit(f"{name}: "), F.lit(v) if isinstance(v, str) else v) for name, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(_END), body)


def write(pages: DataFrame, path: str, payload: str = "html", url: str = "url", key: str = "page_id", least: int = LEAST_BYTES, compression: str = "gzip") -> None:
    """Write the archives of ``pages`` under ``path``."""
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("page_id"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).alias("html"),
    )
    rows = rows.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # Payloads that occur again: written out, so the join below knows the size of what it broadcasts or not.
    again = rows.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
    again = stage(again.where("n > 1 AND keeper IS NOT NULL").select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "keeper"), "again")
    rows = rows.join(again, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")), "left")
    is_revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id"))
    uri = F.when(F.length(F.trim("url")) > 0, F.regexp_replace(F.trim("url"), r"[\x00-\x20\x7F]", "%20"))
    request, response, metadata = (_urn(kind, F.col("page_id"), uri, F.col("digest"), F.col("bytes")) for kind in ("request", "response", "metadata"))
    page = F.col("page_id").cast("string")
    about = (("WARC-Date", DATE), ("WARC-Target-URI", uri))
    path_of = F.coalesce(F.nullif(F.regexp_extract(uri, r"^[a-zA-Z]+://[^/]*(/[^#]*)", 1), F.lit("")), F.lit("/"))
    asked = F.concat(F.lit("GET "), path_of, F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(F.regexp_extract(uri, r"^[a-zA-Z]+://([^/]*)", 1), F.lit("")), F.lit(_END))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit(_END))
    answer = F.when(is_revisit, head).otherwise(F.concat(head, F.col("html")))
    facts = F.concat(F.lit("fetchedBytes: "), F.col("bytes").cast("string"), F.lit("\r\npageId: "), F.coalesce(page, F.lit("")), F.lit("\r\n"))
    # The keeper has the same digest and length; its URL is not known here, so a response is named without it.
    named = _urn("payload", F.coalesce("keeper", "page_id"), F.col("digest"), F.col("bytes"))
    response = F.when(is_revisit, response).otherwise(named)
    three = F.concat_ws(
        _END,
        _record("request", asked, ("WARC-Record-ID", request), ("WARC-Concurrent-To", response), *about, ("Content-Type", "application/http; msgtype=request")),
        _record(
            F.when(is_revisit, "revisit").otherwise("response"), answer, ("WARC-Record-ID", response), *about,
            ("WARC-Profile", F.when(is_revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            ("WARC-Refers-To", F.when(is_revisit, named)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            ("WARC-Page-ID", page),
            ("Content-Type", "application/http; msgtype=response"),
        ),
        _record("metadata", facts, ("WARC-Record-ID", metadata), ("WARC-Concurrent-To", response), *about, ("Content-Type", "application/warc-fields")),
    )
    small = F.col("bytes") <= LARGE_BYTES
    largest = pages.agg(F.max(F.octet_length(F.col(f"`{payload}`").cast("string")))).first()[0] or 0
    for some, most, mode in ((small, LARGE_BYTES, "overwrite"), (~small, largest, "append")):
        if mode == "overwrite" or largest > LARGE_BYTES:
            out = rows.where(some).select(three.alias("value")).write.option("lineSep", _END).option("maxRecordsPerFile", max(1, FILE_BYTES // most))
            out.option("compression", compression).mode(mode).text(path)


def unpacked(data: bytes) -> bytes:
    """Contents of a plain or gzip file of any number of members."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def parse(data: bytes):
    """Records of an archive as (headers, body); header names in lower case, each with all its values."""
    at = 0
    view = memoryview(data)
    while True:
        at = data.find(b"WARC/", at)
        end = data.find(b"\r\n\r\n", at)
        if at < 0 or end < 0:
            return
        headers: dict[str, list[str]] = {}
        last = None
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and last:
                headers[last][-1] += " " + line.strip()
            elif ":" in line:
                name, _, value = line.partition(":")
                last = name.strip().lower()
                headers.setdefault(last, []).append(value.strip())
        length = headers.get("content-length", ["0"])[0]
        length = int(length) if length.isdigit() else 0
        at = end + 4
        if at + length > len(data):
            return
        yield headers, view[at : at + length]
        at += length


def read(spark: SparkSession, path: str) -> DataFrame:
    """Flat records (RECORD) of all archives under ``path``."""

    def rows(batches):
        for batch in batches:
            for content in batch.column(0):
                found: list[tuple] = []
                size = 0
                for headers, body in parse(unpacked(content.as_py())):
                    one = lambda name: headers.get(name, [None])[0]  # noqa: B023, E731
                    kind, head, payload = one("warc-type"), None, bytes(body)
                    if "application/http" in (one("content-type") or ""):
                        cut = payload.find(b"\r\n\r\n")
                        head, payload = payload[: max(cut, 0)].decode("latin-1"), payload[cut + 4 :] if cut >= 0 else b""
                    full = kind == "response"
                    page = one("warc-page-id")
                    found.append((
                        one("warc-record-id"), kind, headers.get("warc-concurrent-to", []), one("warc-refers-to"), one("warc-target-uri"), one("warc-date"),
                        page, hashlib.sha1(payload).hexdigest() if full else (one("warc-payload-digest") or "").removeprefix("sha1:") or None,
                        len(payload) if full else None, head, None if kind == "revisit" else payload,
                    ))
                    size += len(payload)
                    if size > 8 << 20:
                        yield _batch(found)
                        found, size = [], 0
                if found:
                    yield _batch(found)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(rows, RECORD)


_TYPES = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.strip().split(" ")[0] for part in RECORD.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names)


def captures(records: DataFrame) -> DataFrame:
    """One row per response or revisit: its fields, ``request`` and ``metadata`` (array) nested, the payload's facts in full.

    Requests and metadata are first brought together by the capture they name (or that names
    them), so captures that were recorded twice do not multiply.
    """
    main = records.where(F.col("record_type").isin("response", "revisit"))
    others = records.where(F.col("record_type").isin("request", "metadata"))
    named = F.explode("concurrent_to").alias("capture")
    forth = others.select(named, F.col("record_id").alias("other"))
    back = main.select(F.col("record_id").alias("capture"), F.explode("concurrent_to").alias("other"))
    pairs = forth.union(back).distinct()
    part = F.struct("record_id", "date", "target_uri", "http_headers", F.col("payload").alias("body"))
    sides = pairs.join(others.select(F.col("record_id").alias("o"), "record_type", part.alias("part")), F.col("other") == F.col("o"))
    request = F.min(F.when(F.col("record_type") == "request", F.col("part")))
    metadata = F.array_sort(F.collect_set(F.when(F.col("record_type") == "metadata", F.col("part"))))
    sides = sides.groupBy("capture").agg(request.alias("request"), metadata.alias("metadata"))
    sources = main.where("record_type = 'response'").groupBy(F.col("record_id").alias("source")).agg(
        F.min("page_id").alias("source_page"), F.min("payload_bytes").alias("source_bytes")
    )
    # A record that refers to none looks itself up: nulls would all meet in one task.
    wanted = F.coalesce("refers_to", "record_id")
    out = main.join(sides, F.col("record_id") == F.col("capture"), "left").join(sources, wanted == F.col("source"), "left")
    return out.select(
        F.col("page_id").cast("long").alias("page_id"), "record_id", "record_type", "target_uri", "date", "http_headers",
        F.coalesce("payload_bytes", "source_bytes").alias("payload_bytes"), "payload_digest", "payload", "request", "metadata",
        F.when(F.col("record_type") == "revisit", F.col("source_page").cast("long")).alias("refers_to"),
    )


def facts(of: DataFrame) -> DataFrame:
    """Captures with what their nested records say: the URI asked for, the bytes fetched (of any metadata record) and how many metadata records there are."""
    told = F.regexp_extract(F.decode(F.col("metadata")[0]["body"], "UTF-8"), r"(?m)^fetchedBytes: (\d+)", 1)
    return of.withColumns(
        {
            "request_uri": F.col("request.target_uri"),
            "fetched_bytes": F.when(told != "", told.cast("long")),
            "n_metadata": F.coalesce(F.size("metadata"), F.lit(0)).cast("long"),
        }
    )


@query(
    "op3_warc",
    r"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, trim(url) AS url FROM pages),
       q AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN length(url) > 0 THEN regexp_replace(url, '[\x00-\x20\x7F]', '%20', 'g') END AS uri,
                    strlen(html) >= 1000 AND max(page_id) OVER (PARTITION BY html) IS DISTINCT FROM page_id AS again,
                    max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
       SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
              CASE WHEN again THEN keeper END AS refers_to, uri AS request_uri, payload_bytes AS fetched_bytes, 1::BIGINT AS n_metadata FROM q""",
)
def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write(table(spark, sf_dir, "pages"), path)
    # The archives are parsed once; of the bodies the result needs those of metadata records only.
    records = read(spark, path).withColumn("payload", F.when(F.col("record_type") == "metadata", F.col("payload")))
    found = facts(captures(stage(records, "records")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "request_uri", "fetched_bytes", "n_metadata")
