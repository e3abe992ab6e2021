"""WARC archives: writing captures, reading records, and assembling transactions.

A capture is three records: the response (or a revisit, when an earlier capture has the same
payload), the request, and metadata, the latter two naming the first through
WARC-Concurrent-To. Each record is a gzip member of its own. Executors write the archives to
the shared folder under names that no other attempt uses, and only those that a finished
task reports are read. Assembly brings the records of a capture together through these
identifiers and emits one nested row per capture.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lean, partitions, rank_in_groups, require, shared_path

#: Payloads below this size are never revisits.
LEAST_REVISIT = 100
BROADCAST_ROWS = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
RECORD_FIELDS = "file string, record_offset bigint, warc_type string, record_id string, concurrent_to string, refers_to string, target_uri string, warc_date string, payload_digest string, http_headers string, payload binary"


def record_id(*parts: object) -> str:
    """An identifier fixed by its parts."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16], version=4)}>"


def warc_record(kind: str, rid: str, headers: list[tuple[str, str | None]], block: bytes) -> bytes:
    """One record, compressed as a gzip member."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", _DATE), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines if v is not None) + "\r\n"
    gz = zlib.compressobj(3, zlib.DEFLATED, 31)
    return gz.compress(head.encode() + block + b"\r\n\r\n") + gz.flush()


def read_records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(data):
        gz = zlib.decompressobj(31)
        record = gz.decompress(memoryview(data)[at : at + 65536])
        end = at + 65536
        while not gz.eof:
            if end >= len(data):
                raise ValueError(f"a record is cut off at {at}")
            record += gz.decompress(memoryview(data)[end : end + 1048576])
            end += 1048576
        head, _, rest = record.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        yield at, headers, rest[: int(headers["content-length"])]
        at = min(end, len(data)) - len(gz.unused_data)


def _uri(url: str | None) -> str | None:
    return None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")


def write_captures(captures: DataFrame, folder: str) -> DataFrame:
    """Write captures (page_id, url, html, digest, ordinal, first_id) to archives; returns (file, records).

    ``first_id`` is null for a response, else the page whose response a revisit refers to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        name, out, n = f"captures-{uuid.uuid4().hex}.warc.gz", None, 0
        for batch in batches:
            for page, url, html, digest, ordinal, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    where.create_dir(base, recursive=True)
                    out = where.open_output_stream(f"{base}/{name}")
                payload, uri, rid = (html or "").encode(), _uri(url), record_id("capture", page, digest, ordinal)
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                common = [("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if first is None:
                    out.write(warc_record("response", rid, common, http + payload))
                else:
                    out.write(warc_record("revisit", rid, [*common, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("capture", first, digest, 0))], http))
                path = (uri or "/").partition("://")[2].partition("/")[2]
                out.write(warc_record("request", record_id("request", page, digest, ordinal), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/http; msgtype=request")], f"GET /{path} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()))
                fields = "" if page is None else f"page_id: {page}\r\n"
                out.write(warc_record("metadata", record_id("metadata", page, digest, ordinal), [("WARC-Target-URI", uri), ("WARC-Concurrent-To", rid), ("Content-Type", "application/warc-fields")], fields.encode()))
                n += 3
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [n]})

    return cut(captures.mapInArrow(lean(write), "file string, records bigint"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """All records of the archives, one row each; HTTP headers are split from the payload."""
    names = [x.split()[0] for x in RECORD_FIELDS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = pafs.FileSystem.from_uri(folder)
        kinds = (pa.string(), pa.int64(), *[pa.string()] * 8, pa.binary())
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with where.open_input_stream(f"{base}/{name}") as source:
                    data = source.read()
                rows, size = [], 0
                for at, h, block in read_records(data):
                    http = None
                    if h.get("content-type", "").startswith("application/http"):
                        head, _, block = block.partition(b"\r\n\r\n")
                        http = head.decode("utf-8", "replace")
                    rows.append((name, at, h["warc-type"], h["warc-record-id"], h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-payload-digest"), http, block))
                    size += len(block) + 500
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = manifest.select("file").repartition(partitions(manifest.sparkSession), "file")
    return files.mapInArrow(lean(read), RECORD_FIELDS)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One row per capture: (capture_id, warc_type, target_uri, warc_date, response, request, metadata).

    ``response`` is the response's or revisit's struct (http_headers, payload, payload_digest,
    refers_to), ``request`` the request's HTTP headers, ``metadata`` its text. A request or
    metadata record whose capture is missing is kept with a null response. Of several
    records of one kind for a capture, one with the least place in the archives counts.
    """
    main = F.col("warc_type").isin("response", "revisit", "resource")
    kept = records.where(main | F.col("warc_type").isin("request", "metadata"))
    key = F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id"))
    answer = F.when(main, F.struct("file", "record_offset", "warc_type", "target_uri", "warc_date", "http_headers", "payload", "payload_digest", "refers_to"))
    request = F.when(F.col("warc_type") == "request", F.struct("file", "record_offset", "http_headers"))
    metadata = F.when(F.col("warc_type") == "metadata", F.struct("file", "record_offset", F.decode("payload", "UTF-8").alias("text")))
    grouped = kept.select(key.alias("capture_id"), answer.alias("a"), request.alias("q"), metadata.alias("m")).groupBy("capture_id").agg(F.min("a").alias("a"), F.min("q").alias("q"), F.min("m").alias("m"))
    response = F.when(F.col("a").isNotNull(), F.struct("a.http_headers", "a.payload", "a.payload_digest", "a.refers_to"))
    return grouped.select("capture_id", "a.warc_type", "a.target_uri", "a.warc_date", response.alias("response"), F.col("q.http_headers").alias("request"), F.col("m.text").alias("metadata"))


def plan_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Decide which pages are responses: (page_id, url, html, digest, ordinal, first_id).

    Null payloads are empty. Of equal payloads of at least ``least`` bytes the one with the
    smallest id is the response; among rows with that same id, numbered by ``ordinal``, the
    first. Null ids never are another page's response while a page with an id exists. Ids are integers;
    others are an error.
    """
    require(pages, id_col, url_col, html_col)
    html = F.coalesce(html_col, F.lit(""))
    base = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(F.encode(html, "UTF-8"), 256).alias("digest"))
    large = F.octet_length("html") >= least
    firsts = base.where(large).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    firsts = cut(firsts.select(F.col("digest").alias("d"), "least"), "payloads")
    same = base.groupBy("page_id", "digest").count().where("count > 1")
    if same.isEmpty():
        numbered = base.withColumn("ordinal", F.lit(0).cast("bigint"))
    else:
        told_apart = cut(base.withColumn("_row", F.monotonically_increasing_id()), "pages")  # written, so that numbers stay
        numbered = rank_in_groups(told_apart, ["page_id", "digest"], [F.col("_row")], "ordinal")
    few = firsts.count() <= BROADCAST_ROWS
    joined = numbered.join(F.broadcast(firsts) if few else firsts, F.col("digest") == F.col("d"), "left")
    is_first = F.col("least").isNull() | (F.col("page_id").eqNullSafe(F.col("least")) & (F.col("ordinal") == 0))
    return joined.select("page_id", "url", "html", "digest", "ordinal", F.when(~(is_first & large | ~large), F.col("least")).alias("first_id"))


def op7_warc_transactions(spark, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC captures, reads the archives back and assembles the transactions."""
    folder = shared_path(spark, "warc")
    manifest = write_captures(plan_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")), folder)
    captures = assemble_transactions(read_archives(manifest, folder))
    page = F.regexp_extract("metadata", r"page_id: (-?\d+)", 1)
    flat = captures.select("capture_id", F.when(page != "", page.cast("bigint")).alias("page_id"), F.col("warc_type").alias("record_type"), "response.refers_to", F.octet_length("response.payload").cast("bigint").alias("payload_bytes"), F.sha2("response.payload", 256).alias("payload_digest"))
    flat = cut(flat, "captures")
    originals = flat.where("record_type = 'response'").select(F.col("capture_id").alias("refers_to"), F.col("page_id").alias("of_page"), F.col("payload_bytes").alias("of_bytes"), F.col("payload_digest").alias("of_digest"))
    # responses refer to nothing, and stay out of the join
    linked = flat.where("refers_to is not null").join(originals, "refers_to", "left")
    joined = linked.unionByName(flat.where("refers_to is null"), allowMissingColumns=True)
    own = F.col("record_type") == "response"
    return joined.select("page_id", F.when(own, F.col("payload_bytes")).otherwise(F.col("of_bytes")).alias("payload_bytes"), F.when(own, F.col("payload_digest")).otherwise(F.col("of_digest")).alias("payload_digest"), "record_type", F.when(~own, F.col("of_page")).alias("refers_to"))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_page FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first_page THEN first_page END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
