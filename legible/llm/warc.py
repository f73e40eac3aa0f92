"""WARC archives: writing captures, reading records, assembling transactions.

*Writing.*  Every page becomes a request, a response (or revisit) and a metadata record; request and metadata
name the response in ``WARC-Concurrent-To``.  Of pages with equal payloads of at least ``least`` bytes the one with
the smallest id is the response, the others revisit it (``WARC-Refers-To``, no payload).  Spark's text writer writes
the records, ``CRLF CRLF`` after each, as gzip files to any store.

*Reading.*  Spark's text reader cuts gzip files (which are not split, so records come in order) at the version line
and a task joins pieces again until a record has its ``Content-Length``: a payload that holds a version line is safe.
A task holds one record.

*Assembly.*  Records are joined through their identifiers: each response or revisit with its request and metadata
records, one nested row per capture.  A revisit finds its response's row by ``WARC-Refers-To``.

Edge cases: null payload is the empty payload, null url an empty target; a null id is never referred to and
comes back null; rows that repeat an id and payload are captures of their own with one record identifier (each a
response if its id is the smallest); empty payloads are equal payloads; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from legible.llm.common import shared_dir, stage, text_batches

#: Fixed values of the format.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Repeated payloads (60 bytes a row) up to which their table is broadcast instead of joined by shuffle.
BROADCAST_ROWS = 100_000


def base32(digits: Column) -> Column:
    """Upper-case base32 of 40 hex digits (five hex digits are four base32 digits)."""

    def four(i: Column) -> Column:
        v = F.conv(F.substring(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def _urn(*parts: Column) -> Column:
    """A record identifier made from its parts."""
    h = F.md5(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, s, n) for s, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _record(kind: Column, record_id: Column, uri: Column, date: str, content: str, block: Column, *more: Column) -> Column:
    """A whole record without its closing line ends.  ``more``: header lines (null: left out)."""
    head = F.concat_ws("\r\n", F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id),
                       F.lit(f"WARC-Date: {date}"), F.concat(F.lit("WARC-Target-URI: "), uri), *more,
                       F.lit(f"Content-Type: {content}"), F.concat(F.lit("Content-Length: "), F.octet_length(block)))
    return F.concat(F.lit(VERSION), head, F.lit("\r\n\r\n"), block)


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Three records per row to gzip files below ``path``."""
    src = pages.select(F.col(id_col).alias("_id"), F.regexp_replace(F.coalesce(url_col, F.lit("")), r"[\r\n]", "").alias("uri"),
                       F.coalesce(payload_col, F.lit("")).alias("payload"))
    src = src.withColumn("hex", F.sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    again = (src.filter(F.col("size") >= least).groupBy("hex").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("m"))
             .filter("m > 1 and first is not null").select(F.col("hex").alias("_d"), "first"))
    again = stage(again, "warc-again")
    if again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        again = F.broadcast(again)
    src = src.join(again, src["hex"] == again["_d"], "left").withColumn("digest", base32(F.col("hex")))
    revisit = F.col("first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("first"))
    uri, rid = F.col("uri"), _urn(F.lit("response"), F.col("_id"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    concurrent = F.concat(F.lit("WARC-Concurrent-To: "), rid)
    host = F.regexp_extract(uri, r"://([^/?#]*)", 1)
    path_ = F.regexp_extract(uri, r"://[^/?#]*([^#]*)", 1)
    ask = F.concat(F.lit("GET "), F.when(path_ == "", F.lit("/")).otherwise(path_), F.lit(" HTTP/1.1\r\nHost: "), host, F.lit("\r\n\r\n"))
    about = F.coalesce(F.concat(F.lit("page-id: "), F.col("_id").cast("string"), F.lit("\r\n")), F.lit("page-id-is-null: true\r\n"))
    records = F.array(
        _record(F.lit("request"), _urn(F.lit("request"), F.col("_id"), F.col("digest")), uri, date, "application/http;msgtype=request", ask, concurrent),
        _record(F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")), rid, uri, date, "application/http;msgtype=response",
                F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
                F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
                F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
                F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _urn(F.lit("response"), F.col("first"), F.col("digest"))))),
        _record(F.lit("metadata"), _urn(F.lit("metadata"), F.col("_id"), F.col("digest")), uri, date, "application/warc-fields", about, concurrent))
    src.select(F.explode(records).alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def _parsed(piece: bytes) -> tuple[dict[str, str], bytes, int] | None:
    """Headers, the rest and its due length of a record that follows its version line; None if its head is incomplete."""
    head, gap, rest = piece.partition(b"\r\n\r\n")
    if not gap:
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    return headers, rest, int(headers.get("content-length") or 0)


def read_warc(spark: SparkSession, path: str, version: str = VERSION) -> DataFrame:
    """One row per record: ``type, record_id, concurrent_to, refers_to, target_uri, payload_digest, block``."""
    text_batches(spark, 500)
    raw = spark.read.option("lineSep", version).text(path).select(
        F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    names = ["type", "record_id", "concurrent_to", "refers_to", "target_uri", "payload_digest"]
    fields = ["warc-type", "warc-record-id", "warc-concurrent-to", "warc-refers-to", "warc-target-uri", "warc-payload-digest"]
    mark = version.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_parts: list[bytes] = []
        at, need = None, 0
        for b in batches:
            out = []
            for piece, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != at:
                    open_parts, at, need = [], file, 0
                if not open_parts and not piece.strip():
                    continue  # before the first version line
                open_parts.append(piece)
                if sum(map(len, open_parts)) + len(mark) * (len(open_parts) - 1) < need:
                    continue
                whole = mark.join(open_parts)
                got = _parsed(whole)
                if got is None or len(got[1]) < got[2]:
                    need = len(whole) - len(got[1]) + got[2] if got else 0
                    continue
                out.append((*(got[0].get(f) for f in fields), got[1][:got[2]]))
                open_parts, need = [], 0
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([o[k] for o in out], pa.string()) for k in range(6)), pa.array([o[6] for o in out], pa.binary())],
                [*names, "block"])

    return raw.mapInArrow(run, ", ".join(f"{n} string" for n in names) + ", block binary")


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``record_id, type, target_uri, refers_to, payload_digest, http`` (headers),
    ``payload, request`` and ``metadata`` (structs of record_id and block as text; null if the archive lacks them)."""
    def side(kind: str) -> DataFrame:
        return (records.filter(F.col("type") == kind).groupBy(F.col("concurrent_to").alias(f"_{kind}"))
                .agg(F.min(F.struct("record_id", F.col("block").cast("string").alias("block"))).alias(kind)))

    gap = F.instr(F.col("block").cast("string"), "\r\n\r\n")
    head = F.when(gap > 0, F.substring(F.col("block").cast("string"), F.lit(1), gap - 1)).otherwise(F.lit(""))
    main = records.filter(F.col("type").isin("response", "revisit")).select(
        "record_id", "type", "target_uri", "refers_to", F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"),
        head.alias("http"), F.when(gap > 0, F.substring("block", F.octet_length(head) + 5, F.octet_length("block")))
        .otherwise(F.col("block")).alias("payload"))
    for kind in ("request", "metadata"):
        s = side(kind)
        main = main.join(s, main["record_id"] == s[f"_{kind}"], "left").drop(f"_{kind}")
    return main


def captured_pages(captures: DataFrame) -> DataFrame:
    """Per capture: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` (the response's page_id)."""
    page = F.regexp_extract(F.col("metadata.block"), r"(?m)^page-id: (.*?)\r?$", 1)
    rows = captures.select(
        "record_id", F.when(page != "", page).cast("long").alias("page_id"), F.col("type").alias("record_type"), F.col("refers_to").alias("_to"),
        F.when(F.col("type") == "revisit", F.regexp_extract("http", r"(?im)^content-length:\s*(\d+)", 1).cast("long"))
        .otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(F.col("type") == "revisit", F.col("payload_digest")).otherwise(base32(F.sha1("payload"))).alias("payload_digest"))
    rows = stage(rows, "warc-rows")  # numbers only; the archives are read and assembled once
    heads = rows.filter("record_type = 'response'").select(F.col("record_id").alias("_rid"), F.col("page_id").alias("refers_to")).dropDuplicates(["_rid"])
    later = rows.filter("record_type = 'revisit'")
    cols = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return rows.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*cols).union(
        later.join(heads, later["_to"] == heads["_rid"], "left").select(*cols))


def new_archive_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/llm/warc-{uuid.uuid4().hex}"
